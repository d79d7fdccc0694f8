"""Identities: content, symbol, snapshot and module hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUL = "\0"


def _joined(*parts: Column) -> Column:
    return F.concat_ws(_NUL, *parts)


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def prompt_hash(version: Column, content: Column) -> Column:
    return F.sha2(_joined(version, content).cast("binary"), 256)


def symbol_id(root: Column, path: Column, fq_name: Column, kind: Column) -> Column:
    return F.substring(F.sha2(_joined(root, path, fq_name, kind).cast("binary"), 256), 1, 32)


def symbol_content_hash(fq_name: Column, body: Column) -> Column:
    return F.substring(F.sha2(_joined(fq_name, body).cast("binary"), 256), 1, 16)


def snapshot_id(root: Column, tag: Column, sha: Column) -> Column:
    return F.substring(F.sha2(_joined(root, tag, sha).cast("binary"), 256), 1, 32)


def checksum(ids: Column) -> Column:
    """Over the sorted ids, each followed by a NUL; no ids hash the empty string."""
    joined = F.array_join(F.transform(F.array_sort(ids), lambda x: F.concat(x, F.lit(_NUL))), "")
    return F.sha2(joined.cast("binary"), 256)


def module_hash(hashes: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(hashes), "").cast("binary"), 256)
