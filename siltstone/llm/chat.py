"""Chat formatting by columnar byte assembly, and the reader that recovers turns and the loss mask.

Template, per turn: ``<|im_start|>`` role, a line break, text, ``<|im_end|>`` and a line break. Inside texts and roles
every ``<`` + n backslashes + ``|`` gets one backslash more, so no control string can appear there and the change can be
undone; in roles a line break is written as the two characters ``<n``, and ``<`` + n backslashes + ``n`` likewise gets one
backslash more.

Assembly works on whole Arrow batches: segment lengths, their cumulative offsets and numpy scatter indices copy
headers and contents into one preallocated buffer that becomes an Arrow column without further copies; escapes are found
and written by array operations as well. Beside the bytes every piece keeps its loss mask, the byte ranges of the texts
to learn. Turns are dealt by ranges of (conversation, turn), so a long conversation is formatted and parsed by many
tasks; only its two digests, chains by definition, run through one task, as a stream of pieces.

Defined results: null texts and roles are empty; repeated rows and equal turn numbers are all kept, ordered by turn,
role, text; null conv_id rows make one conversation of their own; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

START, END = b"<|im_start|>", b"<|im_end|>\n"
LEARNED_ROLE = "assistant"
_BREAK = re.compile(rb"<(\\*)n")
_UNBREAK = re.compile(rb"<(\\+)n")
LESS, SLASH, PIPE = b"<\\|"


def _guarded(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places of each ``|`` that follows a ``<`` and any number of backslashes in the same text."""
    pipes = np.flatnonzero(buf == PIPE)
    if not len(pipes):
        return pipes
    other = np.maximum.accumulate(np.where(buf != SLASH, np.arange(len(buf)), -1))
    before = np.where(pipes > 0, other[pipes - 1], -1)
    begin = off[np.searchsorted(off, pipes, side="right") - 1]
    return pipes[(before >= begin) & (buf[before] == LESS)]


def escape_all(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts with one backslash more before each guarded ``|``."""
    at = _guarded(buf, off)
    return (np.insert(buf, at, SLASH), off + np.searchsorted(at, off)) if len(at) else (buf, off)


def _one(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(text, np.uint8), np.array([0, len(text)])


def escape(text: bytes) -> bytes:
    return escape_all(*_one(text))[0].tobytes()


def unescape(text: bytes) -> bytes:
    if b"\\|" not in text:
        return text
    buf, off = _one(text)
    at = _guarded(buf, off)
    return np.delete(buf, at[buf[at - 1] == SLASH] - 1).tobytes()


def escape_role(role: bytes) -> bytes:
    return escape(_BREAK.sub(rb"<\1\\n", role).replace(b"\n", b"<n"))


def unescape_role(role: bytes) -> bytes:
    return _UNBREAK.sub(lambda m: b"<" + m[1][1:] + b"n", unescape(role).replace(b"<n", b"\n"))


def _roles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, whether learned) of the roles; each different role of the batch is escaped once."""
    coded = column.dictionary_encode()
    names = [x.encode() for x in coded.dictionary.to_pylist()]
    number = coded.indices.to_numpy()
    written = [escape_role(x) for x in names]
    off = np.concatenate([[0], np.cumsum(np.array([len(x) for x in written], np.int64)[number])]).astype(np.int64)
    learned = np.array([x == LEARNED_ROLE.encode() for x in names], bool)[number]
    return np.frombuffer(b"".join([written[k] for k in number]), np.uint8), off, learned


def assemble(roles: tuple[np.ndarray, np.ndarray], texts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns in order, the offsets of the turns in it, and where their texts begin."""
    n = len(roles[1]) - 1
    role_len, text_len = np.diff(roles[1]), np.diff(texts[1])
    sizes = np.empty((n, 5), np.int64)  # header, role, line break, text, footer
    sizes[:, 0], sizes[:, 1], sizes[:, 2], sizes[:, 3], sizes[:, 4] = len(START), role_len, 1, text_len, len(END)
    ends = np.cumsum(sizes.ravel()).reshape(n, 5)
    begins = ends - sizes
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, fixed in ((0, START), (2, b"\n"), (4, END)):
        out[begins[:, k, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    for k, (buf, off), length in ((1, roles, role_len), (3, texts, text_len)):
        out[np.arange(len(buf)) + np.repeat(begins[:, k] - off[:-1], length)] = buf
    return out, np.append(begins[:, 0], len(out)) if n else np.zeros(1, np.int64), begins[:, 3]


FORMATTED = "conv_id long, part int, k long, n_turns long, formatted binary, loss_start array<long>, loss_end array<long>"


def format_chat(turns: DataFrame) -> DataFrame:
    """Pieces of conversations: runs of consecutive turns, in the order of part and k, with the byte ranges under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for block, buf, off in common.blocks(batch, "text"):
                role_buf, role_off, learned = _roles(block.column("role"))
                texts = escape_all(buf, off)
                out, off, text_at = assemble((role_buf, role_off), texts)
                conv = common.ints(block.column("conv_id"))
                first = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
                last = np.append(first[1:], len(conv))
                cuts = np.append(off[first], off[-1]).astype(np.int64)
                body = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(cuts), pa.py_buffer(out)]).cast(pa.binary())
                taken = np.flatnonzero(learned)
                ends = pa.array(np.append(np.searchsorted(taken, first), len(taken)).astype(np.int32))
                begin = text_at[taken] - cuts[np.searchsorted(first, taken, side="right") - 1]
                masks = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int64))) for x in (begin, begin + np.diff(texts[1])[taken])]
                numbers = [pa.array(np.full(len(first), part, np.int32)), pa.array(k + np.arange(len(first))), pa.array(last - first)]
                yield pa.RecordBatch.from_arrays([block.column("conv_id").take(pa.array(first)), *numbers, body, *masks], [c.split()[0] for c in FORMATTED.split(", ")])
                k += len(first)

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


PARSED = "conv_id long, part int, k long, n_turns long, turns binary, learned binary, loss_chars long, formatted_chars long"


def parse_chat(formatted: DataFrame) -> DataFrame:
    """Per piece: role, line break, text, line break of its turns, and what lies under its loss mask, both unescaped."""

    def parsed(formatted: bytes, starts: list[int], ends: list[int]) -> tuple:
        at, n, said = 0, 0, []
        while at < len(formatted):
            if not formatted.startswith(START, at):
                raise ValueError("a turn does not begin with its control string")
            line = formatted.index(b"\n", at)
            stop = formatted.index(END, line)
            said += [unescape_role(formatted[at + len(START) : line]), b"\n", unescape(formatted[line + 1 : stop]), b"\n"]
            at = stop + len(END)
            n += 1
        learned = b"".join([unescape(formatted[a:b]) for a, b in zip(starts, ends)])
        return n, b"".join(said), learned, len(learned.decode()), len(formatted.decode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FORMATTED.split(", ")]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        for batch in batches:
            rows = [(conv, part, k, *parsed(body, starts, ends)) for conv, part, k, _, body, starts, ends in zip(*(batch.column(c).to_pylist() for c in names))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in PARSED.split(", ")])

    return formatted.mapInArrow(run, PARSED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_chat(formatted: DataFrame) -> DataFrame:
    """Parses formatted conversations back: the digest of the turns, and what lies under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, digests = None, [0, 0, 0], ()
        row = lambda: (now[0], sums[0], digests[0].hexdigest(), sums[1], digests[1].hexdigest(), sums[2])
        for batch in batches:
            done = []
            for conv, n, turns, learned, *chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_turns", "turns", "learned", "loss_chars", "formatted_chars"))):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(row())
                    now, sums, digests = (conv,), [0, 0, 0], (hashlib.sha256(), hashlib.sha256())
                sums = [a + b for a, b in zip(sums, (n, *chars))]
                digests[0].update(turns), digests[1].update(learned)
            if done:
                yield _rows(done)
        if now is not None:
            yield _rows([row()])

    pieces = parse_chat(formatted).repartition("conv_id").sortWithinPartitions("conv_id", "part", "k")
    return pieces.mapInArrow(run, DIGEST)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in DIGEST.split(", ")])
