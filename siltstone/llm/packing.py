"""Best-fit packing of token pieces into fixed-size sequences by large-item matching over a size histogram.

Only the number of pieces of each size decides which sizes share a sequence, so the plan is made from at most
`capacity` counts, however many documents there are. Pieces above a third of the capacity ("large") are matched
greedily, at most two to a sequence, the largest with the largest that still fits; smaller ones then best-fit the
remaining gap, and what is left of them is packed by itself. A pattern of sizes is used as often as the counts allow,
so the plan has a bounded number of rows, and every piece finds its place by its rank among the pieces of its size.

Defined results: a null or empty text is the single end token; rows with a null or repeated doc_id are packed like
any other; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import functools
import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 1024
END_ID = 2
SPECIAL = "<|endoftext|>"
TOKENIZER = "byte_bpe_50k"

_loaded: dict[str, object] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str = TOKENIZER):
    """A function text -> uint32 ids with exactly the ids of the tokenizers file `<name>.json`.

    The same vocabulary in rank form gives the same ids several times faster (a test holds whole tables against the
    library); a text holding the special token's string, which the tokenizers file maps to one id, goes to that library itself.
    """
    if name not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        with open(tokenizer_path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        @functools.cache
        def library():
            from tokenizers import Tokenizer

            return Tokenizer.from_file(tokenizer_path(f"{name}.json"))

        def encode(text: str) -> np.ndarray:
            if SPECIAL in text:
                return np.array(library().encode(text, add_special_tokens=False).ids, np.uint32)
            return np.asarray(fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()), np.uint32)

        _loaded[name] = encode
    return _loaded[name]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full pieces at the end, the first one may be shorter."""
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Tokenises whole texts and cuts them; part and local_rank number the pieces of a size within their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for block, _, _ in common.blocks(batch, "text"):
                out: list[tuple] = []
                for doc, text in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist()):
                    ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        out.append((doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, int(seen[length])))
                        seen[length] += 1
                columns = list(zip(*out))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """({size: [(first rank, first sequence, offset)]}, number of sequences) for a histogram of sizes."""
    left = {s: n for s, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    slots: dict[int, list[tuple[int, int, int]]] = {s: [] for s in left}
    large = sorted(s for s in left if 3 * s > capacity)
    small = sorted(s for s in left if 3 * s <= capacity)
    made = 0

    def best(sizes: list[int], gap: int, taken: dict[int, int]) -> int | None:
        k = bisect_right(sizes, gap) - 1
        while k >= 0 and left[sizes[k]] <= taken.get(sizes[k], 0):
            k -= 1
        return sizes[k] if k >= 0 else None

    while large or small:
        first = (large or small)[-1]
        pattern, taken, gap = [first], {first: 1}, capacity - first
        if large and (mate := best(large, gap, taken)):
            pattern.append(mate)
            taken[mate] = taken.get(mate, 0) + 1
            gap -= mate
        while gap and (filler := best(small, gap, taken)):
            pattern.append(filler)
            taken[filler] = taken.get(filler, 0) + 1
            gap -= filler
        times = min(left[s] // n for s, n in taken.items())
        offset, at = 0, dict(used)
        for s in pattern:
            slots[s].append((at[s], made, offset))
            at[s] += times
            offset += s
        for s, n in taken.items():
            used[s] += n * times
            left[s] -= n * times
            if not left[s]:
                (large if 3 * s > capacity else small).remove(s)
        made += times
    return slots, made


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    kept = common.stored(pieces(docs, capacity, tokenizer), "packing-pieces")
    each = kept.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots, _ = plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = each.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    table = {s: tuple(np.array(x, np.int64) for x in zip(*rows)) for s, rows in slots.items()}
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = common.ints(batch.column("length")), common.ints(batch.column("rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length):
                here = np.flatnonzero(length == s)
                first, base, at = table[int(s)]
                k = np.searchsorted(first, rank[here], side="right") - 1
                sequence[here], offset[here] = base[k] + rank[here] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)], [c.split()[0] for c in schema.split(", ")])

    ranked = kept.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    return ranked.mapInArrow(place, schema)
