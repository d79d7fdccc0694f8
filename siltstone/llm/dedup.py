"""Exact duplicates: fingerprints counted in quotient filters, byte by byte comparison of what they send on.

Every task counts the 64-bit fingerprints of its texts in counting quotient filters, one for each segment (the leading bits
of the fingerprint, about 2**16 rows each). The filters of a segment are merged by their sorted remainders, so that a text
held by a third of all rows is one counter of each task. Only texts whose fingerprint was counted more than once are read
again and compared as bytes: they are grouped by the bytes themselves, combined before the shuffle, so that at most one copy
of a text leaves a task. The rows of a class then learn their class through one row for each class and part of the input.

Texts are equal when they are identical after lower-casing A-Z only. A null text counts as empty; empty texts are equal to
each other. Of a class the row with the largest doc_id stays, a null id being the smallest; of rows with that same id one
stays. Empty tables give empty results; columns other than doc_id and text are not read by `classes` and kept by `deduplicated`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, quotient

BITS = 64  # of a fingerprint
SEGMENT_ROWS = 1 << 16
FILTER_ROWS = 1 << 20  # fingerprints a task holds before it writes its filters
_DIGESTS = "doc_id long, fingerprint long, sha binary, part int, copy long"
_TEXTS = "fingerprint long, sha binary, text binary"


def _texts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[pa.RecordBatch, list[memoryview], np.ndarray]]:
    """Blocks of a batch with the normalised texts and their fingerprints."""
    for batch in batches:
        for block, buf, off in common.blocks(batch, "text"):
            data = memoryview(common._LOWER[buf])
            texts = [data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            hashes = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64)
            yield block, texts, (hashes >> np.uint64(64 - bits) << np.uint64(64 - bits)).view(np.int64)


def digests(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Per row its fingerprint, the SHA-256 of the normalised text, the task that read it and a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for block, texts, prints in _texts(batches, bits):
            n = len(texts)
            shas = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            columns = [block.column("doc_id"), pa.array(prints), shas, pa.array(np.full(n, part, np.int32)), pa.array((part << 33) + k + np.arange(n))]
            k += n
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _DIGESTS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _DIGESTS)


def counted(prints: DataFrame, rows: int) -> DataFrame:
    """segment, filter: the merged counting quotient filters of a column of fingerprints."""
    top = max(0, (max(rows, 1) - 1).bit_length() - SEGMENT_ROWS.bit_length() + 1)

    def filters(held: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = quotient.summed(*(lambda x: (x, np.ones(len(x), np.int64)))(np.concatenate(held).view(np.uint64)))
        segment = (found >> np.uint64(64 - top)).astype(np.int64) if top else np.zeros(len(found), np.int64)
        cuts = np.flatnonzero(np.diff(segment, prepend=-1)).tolist() + [len(found)]
        made = [quotient.encode(found[a:b], counts[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(segment[cuts[:-1]]), pa.array(made, pa.binary())], ["segment", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(common.ints(batch.column(0)))
            n += batch.num_rows
            if n >= FILTER_ROWS:
                yield filters(held)
                held, n = [], 0
        if n:
            yield filters(held)

    def merged(table: pa.Table) -> pa.Table:
        whole = quotient.merge(table.column("filter").to_pylist())
        return pa.table({"segment": table.column("segment")[:1], "filter": pa.array([whole], pa.binary())})

    schema = "segment long, filter binary"
    return prints.mapInArrow(run, schema).groupBy("segment").applyInArrow(merged, schema)


def repeated(filters: DataFrame) -> DataFrame:
    """fingerprint: those that the filters counted more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("filter").to_pylist():
                found, counts = quotient.decode(data)
                yield pa.RecordBatch.from_arrays([pa.array(found[counts > 1].view(np.int64))], ["fingerprint"])

    return filters.mapInArrow(run, "fingerprint long")


def _compared(docs: DataFrame, passing, bits: int) -> DataFrame:
    """fingerprint, sha, texts: how many different byte strings stand behind a digest (one, or the digest is no identity)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, prints in _texts(batches, bits):
            through = np.flatnonzero(common.lets_through(passing.value, prints)).tolist()
            shas = [hashlib.sha256(texts[i]).digest() for i in through]
            kept = pa.array([texts[i].tobytes() for i in through], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(prints[through]), pa.array(shas, pa.binary()), kept], ["fingerprint", "sha", "text"])

    routed = docs.select(F.col("text").cast("string")).mapInArrow(run, _TEXTS)
    return routed.groupBy("fingerprint", "sha", "text").agg(F.count("*").alias("n")).groupBy("fingerprint", "sha").agg(F.count("*").alias("texts"))


def classes(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row. bits: how many of a fingerprint's bits count (fewer only cost time)."""
    spark = docs.sparkSession
    key = ["fingerprint", "sha"]
    with common.scratch(spark):
        rows = common.stored(digests(docs, bits), "dedup-digests")
        again = common.bit_map(common.stored(repeated(counted(rows.select("fingerprint"), rows.count())), "dedup-repeated"))
        routed, alone = common.passing(rows, "fingerprint", again), common.passing(rows, "fingerprint", again, through=False)
        compared = common.stored(_compared(docs, again, bits), "dedup-compared")
        # Null ids are the smallest: nulls come first in the order of structs.
        own = common.stored(routed.groupBy("part", *key).agg(F.max(F.struct("doc_id", "copy")).alias("top"), F.count("*").alias("n")), "dedup-own")
        whole = own.groupBy(*key).agg(F.max("top").alias("keep"), F.sum("n").alias("group_size")).join(compared, key)
        one = F.when(F.col("texts") == 1, F.col("keep")).otherwise(F.raise_error(F.lit("two different texts have one SHA-256 digest")))
        of_part = own.select("part", *key).join(whole.select(*key, one.alias("keep"), "group_size"), key)
        met = routed.join(of_part, ["part", *key]).select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("copy") == F.col("keep.copy")).alias("kept"), "sha")
        single = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
        out = met.unionByName(single).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
        return common.stored(out, "dedup-classes", keep=True)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows with equal ids and texts any one."""
    stay = classes(docs).where("kept").select(F.col("doc_id").alias("siltstone_id"), F.col("text_sha256").alias("siltstone_sha")).distinct()
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    named = docs.withColumns({"siltstone_key": F.col("doc_id").cast("long"), "siltstone_text": F.sha2(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), upper, low), 256)})
    met = named.join(stay, F.col("siltstone_key").eqNullSafe(F.col("siltstone_id")) & (F.col("siltstone_text") == F.col("siltstone_sha")), "left_semi")
    return met.dropDuplicates(["siltstone_key", "siltstone_text"]).drop("siltstone_key", "siltstone_text")
