"""Shared helpers: table access, scratch tables in the shared folder, Arrow blocks and word hashing.

Texts are handled as UTF-8 bytes straight from the Arrow buffers. Work arrays are bounded: a batch is cut into
blocks of a few megabytes (one longer text makes a block of its own), never by dropping part of a text.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only a local session may go without: a temporary folder is named there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_open_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("open_scratch", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end, but for those stored with keep=True, which belong to the scratch around it, if there is one."""
    paths: list[str] = []
    token = _open_scratch.set((*_open_scratch.get(), paths))
    try:
        yield
    finally:
        _open_scratch.reset(token)
        for path in paths:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends at files every executor can read."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = scratch_path(spark, name)
    owners = _open_scratch.get()[: -1 if keep else None]
    if owners:
        owners[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES for this session's jobs, whatever the length of its texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(BATCH_BYTES + 1))) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls count as empty texts."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def lowered(column: pa.Array) -> pa.Array:
    """The texts in lower case, in any script."""
    return pc.utf8_lower(column)


def blocks(batch: pa.RecordBatch, column: str, size: int = BLOCK_BYTES, lower: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most `size` bytes of text each (or one text), with their bytes (lower: in lower case) and offsets."""
    buf, off = text_arrays(lowered(batch.column(column)) if lower else batch.column(column))
    n, at = batch.num_rows, 0
    while at < n:
        end = int(np.searchsorted(off, off[at] + size, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield batch.slice(at, end - at), buf[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def ints(column: pa.Array) -> np.ndarray:
    """An integer Arrow column as int64 (nulls as the smallest value)."""
    return column.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


# --- word hashing -------------------------------------------------------------------------------------------------

_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_VALUE = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK_BYTES + 1)
        inverse = _U(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, element by element."""
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def word_spans(buf: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ and, for each text, the index of its first word (n+1 values).

    space: for each byte value whether it separates words.
    """
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~space[buf]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    edge = off[(off > 0) & (off < n)]
    begin[edge] = solid[edge]
    finish = solid.copy()
    finish[:-1] &= ~solid[1:]
    finish[edge - 1] = solid[edge - 1]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, off, side="left")


_sums: list = [None, None]


def _prefix_sums(buf: np.ndarray, up: np.ndarray) -> np.ndarray:
    if _sums[0] is not buf:  # the same block is often hashed several times
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_LOWER_VALUE[buf] * up[: len(buf)], out=total[1:])
        _sums[:] = buf, total
    return _sums[1]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word after lower-casing A-Z, from prefix sums of a polynomial modulo 2**64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power(len(buf) + 1)
    total = _prefix_sums(buf, up)
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words of one array (len - k + 1 values; shorter arrays as one whole run)."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        k = n
    out = np.full(n - k + 1, _U(k))
    for j in range(k):
        out = out * BASE + words[j : n - k + 1 + j]
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


# --- bit maps -----------------------------------------------------------------------------------------------------


LEAST_BITS, MOST_BITS = 20, 27  # of a bit map, as a power of two


def _slot(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (mix(h.view(np.uint64) ^ BASE) & np.uint64(len(bits) * 64 - 1)).astype(np.int64)


def lets_through(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slot = _slot(ids, bits)
    return bits[slot >> 6] >> (slot & 63) & 1 == 1


def bit_map(ids: DataFrame):
    """A broadcast bit map that lets through all ids of a one-column table and few others; its size has a fixed limit."""
    words = 1 << (min(MOST_BITS, max(LEAST_BITS, (16 * ids.count()).bit_length())) - 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(words, np.int64)
        for batch in batches:
            slot = _slot(ints(batch.column(0)), bits)
            np.bitwise_or.at(bits, slot >> 6, np.int64(1) << (slot & 63))
        at = np.flatnonzero(bits)
        for a in range(0, len(at), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[a : a + 10_000]), pa.array(bits[at[a : a + 10_000]])], ["word", "bits"])

    found = ids.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return ids.sparkSession.sparkContext.broadcast(out)


def passing(df: DataFrame, column: str, bits, through: bool = True) -> DataFrame:
    """The rows whose number in `column` may be in the bit map, or (through=False) those whose number is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(lets_through(bits.value, ints(batch.column(column))) == through))

    return df.mapInArrow(run, df.schema)
