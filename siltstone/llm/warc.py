"""WARC archives: a writer with one gzip member per record, and a splittable reader.

The reader's tasks get byte ranges. A task looks for the gzip magic from the start of its range, validates each
candidate member by decoding its head (a deflate stream whose first bytes are a WARC version line), and owns the
records whose member starts inside its range, reading past the end of the range where the last one does.

Records with equal payloads of at least `min_bytes` bytes are stored once: the one with the smallest page_id is a
response, the others are revisit records that name it. Payloads are compressed where they are read. Only heads (digest,
length, page_id) meet by digest to find the first of equal payloads; records whose payload may occur again (by a bit map of
fixed size) then meet that decision by a number of their own, the rest are written where they are.

Archives are written through pyarrow's file systems under the shared folder, each by a temporary name and a rename,
so that a task that runs again replaces its own file. Defined results: null html is an empty payload; null and
repeated page_ids are kept (of equal rows one is the response, the others revisit it); an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = b"\x1f\x8b\x08"
HEAD = b"WARC/1."
SPLIT_BYTES = 8 << 20
CHUNK = 1 << 20  # read from a file at once
PROBE = 1 << 14  # decoded at once


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _gzip(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(kind: str, page_id: int | None, url: str, digest: str, n: int, refers_to: int | None, body: bytes) -> bytes:
    """One WARC/1.1 record. The target is percent-encoded, so no header line can be broken by it."""
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:page:%s>" % str(page_id).encode()]
    target = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    head += [b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Target-URI: " + target.encode(), b"WARC-Payload-Digest: sha1:" + digest.encode(), b"X-Payload-Length: %d" % n]
    if kind == "revisit":
        head += [b"WARC-Refers-To: <urn:page:%s>" % str(refers_to).encode(), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [b"Content-Type: application/octet-stream", b"Content-Length: %d" % len(body)]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


MEMBERS = "page_id long, url string, digest string, n long, member binary, copy long"


def members(pages: DataFrame) -> DataFrame:
    """Per page: the digest of its payload and its response record as a gzip member; copy tells equal rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for block, buf, off in common.blocks(batch, "html"):
                data, rows = memoryview(np.ascontiguousarray(buf)), []
                for i, (page, url) in enumerate(zip(block.column("page_id").to_pylist(), block.column("url").to_pylist())):
                    payload = bytes(data[off[i] : off[i + 1]])
                    digest = _digest(payload)
                    rows.append((page, url or "", digest, len(payload), _gzip(record("response", page, url or "", digest, len(payload), None, payload)), (part << 33) + k))
                    k += 1
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in MEMBERS.split(", ")])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, MEMBERS)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes the archives; returns (path, size) of each file."""
    made = common.stored(members(pages).withColumn("payload", F.xxhash64("digest", "n")), "warc-members")
    heads = made.select("payload", "digest", "n", "page_id", "copy").where(F.col("n") >= min_bytes)
    # A page without an id is a response only where no page of the payload has one.
    smallest = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "copy"))
    first = heads.groupBy("digest", "n").agg(smallest.alias("first"), F.count("*").alias("copies")).where("copies > 1")
    first = common.stored(first.select("digest", "n", F.col("first.page_id").alias("refers_to"), F.col("first.copy").alias("first_copy")), "warc-first")
    again = common.bit_map(first.select(F.xxhash64("digest", "n")))
    # Heads alone meet by digest; what is decided goes back to the records by their own numbers, so copies of a page spread evenly.
    revisits = common.passing(heads, "payload", again).join(first, ["digest", "n"]).where("copy <> first_copy").select("copy", "refers_to", F.lit(True).alias("revisit"))
    shared = common.passing(made, "payload", again).join(revisits, "copy", "left")
    alone = common.passing(made, "payload", again, through=False)
    columns = ["page_id", "url", "digest", "n"]
    rows = shared.select(*columns, F.when(F.col("revisit"), F.lit(None)).otherwise(F.col("member")).alias("member"), "refers_to")
    return _written(alone.select(*columns, "member", F.lit(None).cast("long").alias("refers_to")), folder, "alone").union(_written(rows, folder, "shared"))


def _written(rows: DataFrame, folder: str, name: str) -> DataFrame:
    """(path, size) of one archive for each task, under a temporary name until it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        path = f"{base}/{name}-{TaskContext.get().partitionId():06d}.warc.gz"
        temporary, size, out = f"{path}.{uuid.uuid4().hex}.tmp", 0, None
        for batch in batches:
            for page, url, digest, n, member, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "n", "member", "refers_to"))):
                out = out or fs.open_output_stream(temporary)
                data = member if member is not None else _gzip(record("revisit", page, url, digest, n, refers, b""))
                out.write(data)
                size += len(data)
        if out:
            out.close()
            fs.move(temporary, path)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size])], ["path", "size"])

    return rows.mapInArrow(run, "path string, size long")


# --- reader -------------------------------------------------------------------------------------------------------


def _is_member(data: memoryview | bytes) -> bool:
    """Whether a gzip member that holds a WARC record begins here, judged from the first bytes it decodes to."""
    try:
        return zlib.decompressobj(31).decompress(data, len(HEAD)) == HEAD
    except zlib.error:
        return False


class _Window:
    """The part of a file that is at hand; asking for bytes moves it forward."""

    def __init__(self, file) -> None:
        self.file, self.base, self.data = file, 0, b""

    def at(self, pos: int, n: int) -> tuple[bytes, int]:
        """(data, k): data[k:] is the file from pos on, n bytes at least unless the file ends before."""
        if not self.base <= pos <= self.base + len(self.data):
            self.base, self.data = pos, b""
        if self.base + len(self.data) - pos < n:
            self.data, self.base = self.data[pos - self.base :], pos
            self.file.seek(pos + len(self.data))
            self.data += self.file.read(max(n, CHUNK) - len(self.data))
        return self.data, pos - self.base


def read_range(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """The decoded records whose member starts in [start, end) of an open file of `size` bytes."""
    pos, window = start, _Window(file)
    while pos < end:
        data, k = window.at(pos, PROBE)
        found = data.find(MAGIC, k)
        if found < 0:
            reached = pos + len(data) - k
            if reached >= size:
                return
            pos = reached - len(MAGIC) + 1
            continue
        pos += found - k
        if pos >= end:
            return
        data, k = window.at(pos, PROBE)
        if not _is_member(data[k : k + PROBE]):
            pos += 1
            continue
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            data, k = window.at(pos, PROBE)
            chunk = data[k : k + PROBE]
            if not chunk:
                raise EOFError("a gzip member ends early")
            parts.append(z.decompress(chunk))
            pos += len(chunk) - len(z.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.decode().split(": ", 1) for line in head.split(b"\r\n")[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return fields, rest[:n]


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string, path string"


def _urn(value: str | None) -> int | None:
    return None if value is None or value == "<urn:page:None>" else int(value[len("<urn:page:") : -1])


def splits(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, size, start, end) byte ranges, dealt out evenly."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long")))
    return files.where("size > 0").select("path", "size", starts.alias("start")).withColumn("end", F.least(F.col("size"), F.col("start") + split_bytes))


def read_archives(ranges: DataFrame, folder: str) -> DataFrame:
    """One row per record; the digest of a response is computed from the payload that was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, size, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "start", "end"))):
                rows = []
                with fs.open_input_file(path) as file:
                    for data in read_range(file, size, start, end):
                        fields, body = parse(data)
                        page = _urn(fields["WARC-Record-ID"])
                        if fields["WARC-Type"] == "response":
                            row = (page, len(body), _digest(body), "response", None)
                            if f"sha1:{row[2]}" != fields["WARC-Payload-Digest"]:
                                raise ValueError("a payload does not match its digest")
                        else:
                            row = (page, int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"][5:], "revisit", _urn(fields.get("WARC-Refers-To")))
                        rows.append((*row, fields["WARC-Target-URI"], path))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in RECORDS.split(", ")])

    return ranges.mapInArrow(run, RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back through byte ranges."""
    folder = common.scratch_path(spark, "warc")
    with common.scratch(spark):
        files = common.stored(write_archives(pages, folder, min_bytes), "warc-files", keep=True)
    ranges = splits(files, split_bytes)
    return read_archives(ranges.repartition(max(1, min(ranges.count(), 4096))), folder)
