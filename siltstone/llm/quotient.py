"""Counting quotient filters over 64-bit fingerprints, in numpy.

A fingerprint is cut into a quotient, which names the slot its run would start at, and a remainder, which is stored. Runs
of one quotient stand in the order of their quotients, each as near behind its own slot as the runs before it allow; two bit
vectors say which quotients have a run and where each run ends. Remainders of a run ascend. A count is written in the slots
behind its remainder: once again for two, beyond that as digits between two copies of it, which a reader tells from other
remainders because the first digit is smaller than what stands before it. Filters hold whole fingerprints, so they can be
read back in order and merged without loss, whatever their quotients' sizes.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<BBBQ")  # bits of the fingerprint, of the quotient, of the remainder; slots
LOAD = 0.9
_U = np.uint64


def _digits(value: int, base: int) -> list[int]:
    out = [value % base]
    while value := value // base:
        out.append(value % base)
    return out[::-1]


def counter_slots(x: int, count: int, bits: int) -> list[int]:
    """The slots of remainder x seen `count` times."""
    if count <= 2 or (x == 0 and count == 3):
        return [x] * count
    if x == 0:
        return [0, *(d + 1 for d in _digits(count - 4, (1 << bits) - 1)), 0, 0]
    digits = [d + 1 + (d + 1 >= x) for d in _digits(count - 3, (1 << bits) - 2)]
    return [x, *([0] if digits[0] > x else []), *digits, x]


def run_counts(run: list[int], bits: int) -> list[tuple[int, int]]:
    """(remainder, count) of the slots of a run."""
    out, i, n = [], 0, len(run)
    while i < n:
        x = run[i]
        following = run[i + 1] if i + 1 < n else None
        if x == 0:
            if following == 0:
                count = 3 if i + 2 < n and run[i + 2] == 0 else 2
                used = count
            else:
                end = next((j for j in range(i + 2, n - 1) if run[j] == 0 and run[j + 1] == 0), None)
                value, used, count = 0, 1, 1
                if end is not None:
                    for d in run[i + 1 : end]:
                        value = value * ((1 << bits) - 1) + d - 1
                    count, used = value + 4, end + 2 - i
        elif following == x:
            count, used = 2, 2
        elif following is not None and following < x:
            end = run.index(x, i + 1)
            value = 0
            for d in run[i + 1 + (following == 0) : end]:
                value = value * ((1 << bits) - 2) + d - 1 - (d > x)
            count, used = value + 3, end + 1 - i
        else:
            count, used = 1, 1
        out.append((x, count))
        i += used
    return out


def encode(fingerprints: np.ndarray, counts: np.ndarray, bits: int = 64) -> bytes:
    """A filter of distinct fingerprints (uint64 below 2**bits, ascending) and their counts."""
    n = len(fingerprints)
    room = int((np.minimum(counts, 2).sum() + 3 * (counts > 2).sum()) / LOAD) + 1
    q = min(max(room - 1, 1).bit_length(), bits - 2)
    r = bits - q
    quotient, remainder = (fingerprints >> _U(r)).astype(np.int64), fingerprints & _U((1 << r) - 1)
    many = np.flatnonzero(counts > 2)
    coded = [counter_slots(int(remainder[i]), int(counts[i]), r) for i in many]
    width = np.minimum(counts, 2).astype(np.int64)
    width[many] = [len(c) for c in coded]
    ends = np.cumsum(width)
    values = np.repeat(remainder, width)
    for i, c in zip(many, coded):
        values[ends[i] - len(c) : ends[i]] = c
    heads = np.flatnonzero(np.diff(quotient, prepend=-1)) if n else np.zeros(0, np.int64)
    runs, before = quotient[heads], (ends - width)[heads]
    shift = np.maximum.accumulate(runs - before) if n else runs
    length = np.diff(np.append(before, len(values)))
    slots = max(1 << q, int(shift[-1]) + len(values)) if n else 1 << q
    occupied, run_ends = np.zeros(1 << q, bool), np.zeros(slots, bool)
    occupied[runs] = True
    run_ends[before + shift + length - 1] = True
    stored = np.zeros(slots, np.uint64)
    stored[np.arange(len(values)) + np.repeat(shift, length)] = values
    size = (r + 7) // 8
    body = np.ascontiguousarray(stored.astype("<u8").view(np.uint8).reshape(slots, 8)[:, :size])
    return _HEAD.pack(bits, q, r, slots) + np.packbits(occupied).tobytes() + np.packbits(run_ends).tobytes() + body.tobytes()


def _opened(data: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bits of the remainder, of the fingerprint, quotients with a run, starts and ends of the runs, slots)."""
    bits, q, r, slots = _HEAD.unpack_from(data)
    at, size = _HEAD.size, (r + 7) // 8
    raw = np.frombuffer(data, np.uint8)
    a, b = -(-(1 << q) // 8), -(-slots // 8)
    runs = np.flatnonzero(np.unpackbits(raw[at : at + a])[: 1 << q])
    ends = np.flatnonzero(np.unpackbits(raw[at + a : at + a + b])[:slots])
    wide = np.zeros((slots, 8), np.uint8)
    wide[:, :size] = raw[at + a + b :].reshape(slots, size)
    starts = np.maximum(runs, np.concatenate([[0], ends[:-1] + 1])) if len(runs) else runs
    return r, bits, runs, starts, ends, wide.view("<u8").ravel().astype(np.uint64)


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, ascending; counts) of a filter."""
    r, _, runs, starts, ends, slots = _opened(data)
    if not len(runs):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    length = ends - starts + 1
    own = np.repeat(np.arange(len(runs)), length)
    before = np.cumsum(length) - length
    values = slots[np.arange(len(own)) + np.repeat(starts - before, length)]
    falls = np.zeros(len(values), bool)
    falls[1:] = (values[1:] <= values[:-1]) & (own[1:] == own[:-1])
    mixed = np.bincount(own[falls], minlength=len(runs)) > 0  # runs with a count other than one
    plain = ~mixed[own]
    found = [(runs[own[plain]].astype(np.uint64) << _U(r)) | values[plain]]
    counts = [np.ones(len(found[0]), np.int64)]
    for k in np.flatnonzero(mixed):
        pairs = run_counts(values[before[k] : before[k] + length[k]].tolist(), r)
        found.append(np.array([(int(runs[k]) << r) | x for x, _ in pairs], np.uint64))
        counts.append(np.array([c for _, c in pairs], np.int64))
    fingerprints, counts = np.concatenate(found), np.concatenate(counts)
    order = np.argsort(fingerprints, kind="stable")
    return fingerprints[order], counts[order]


def count_of(data: bytes, fingerprint: int) -> int:
    """How often a filter has seen a fingerprint: one run is read."""
    r, _, runs, starts, ends, slots = _opened(data)
    k = int(np.searchsorted(runs, fingerprint >> r))
    if k == len(runs) or runs[k] != fingerprint >> r:
        return 0
    return dict(run_counts(slots[starts[k] : ends[k] + 1].tolist(), r)).get(fingerprint & ((1 << r) - 1), 0)


def summed(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints, ascending, with the sums of their counts. Sorted runs after one another are merged, not sorted anew."""
    if not len(fingerprints):
        return fingerprints, counts
    order = np.argsort(fingerprints, kind="stable")
    ordered = fingerprints[order]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[heads], np.add.reduceat(counts[order], heads)


def merge(filters: list[bytes], bits: int = 64) -> bytes:
    """One filter with all that the given ones have counted."""
    parts = [decode(f) for f in filters]
    return encode(*summed(np.concatenate([f for f, _ in parts]), np.concatenate([c for _, c in parts])), bits)
