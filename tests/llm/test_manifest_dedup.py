"""Exact duplicates and Merkle manifests: the data structures against plain ones, the operators against their SQL on odd rows."""

from __future__ import annotations

import hashlib
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import dedup, merkle, queries, quotient

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Word " * 40_000


def odd(spark):
    rows = [(i, f"text {i % 23}", ["en", "de", None, "éé", ""][i % 5], "s" if i % 3 else None, i) for i in range(60)]
    rows += [(60, None, "en", "s", None), (61, "", "en", "s", 0), (62, LONG, "de", "s", 7), (63, LONG.upper(), "de", "s", 7), (64, "É", "en", None, 1), (65, "é", "en", None, 1), (66, "a:1-", "x", "-", 1)]
    rows += [(7, "text 7", "fr", "s", 7), (7, "text 7", "fr", "s", 7), (None, "no id", "fr", "s", 1), (None, "No ID", "fr", "s", 1), (None, "text 9", None, None, None), (-5, "text 9", "en", "s", 3)]
    return spark.createDataFrame(rows, DOCS)


def by_sql(spark, df, sql):
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return sorted((tuple(v for _, v in sorted(zip(names, row))) for row in found.fetchall()), key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def clashing(df):
    return df.withColumns({"tree": F.lit("x"), "leaf": F.lit(1), "idx": F.lit(2), "path": F.lit("p"), "fingerprint": F.lit("f"), "sha": F.lit(0), "part": F.lit("q"), "kept": F.lit("k")})


# --- quotient filters -------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 6), st.lists(st.tuples(st.integers(0, 63), st.integers(1, 10**6)), max_size=12))
def test_counters_of_a_run_are_read_back(bits, pairs):
    want = sorted(dict((x % (1 << bits), c) for x, c in pairs).items())
    slots = [s for x, c in want for s in quotient.counter_slots(x, c, bits)]
    assert all(0 <= s < 1 << bits for s in slots)
    assert quotient.run_counts(slots, bits) == want


@pytest.mark.parametrize("bits,n", [(8, 150), (10, 700), (16, 3000), (64, 5000), (64, 1), (64, 0)])
def test_filters_keep_all_counts_and_merge_without_loss(bits, n):
    rng = np.random.default_rng(n + bits)
    parts = [rng.integers(0, 1 << bits if bits < 64 else 1 << 63, n // k, dtype=np.uint64) for k in (1, 2, 3)]
    parts[0] = np.concatenate([parts[0], np.repeat(parts[0][:5], [1, 2, 3, 1000, 70_000][: len(parts[0][:5])])])
    filters = [quotient.encode(*quotient.summed(p, np.ones(len(p), np.int64)), bits) for p in parts]
    for p, data in zip(parts, filters):
        want, counts = np.unique(p, return_counts=True)
        got = quotient.decode(data)
        assert got[0].tolist() == want.tolist() and got[1].tolist() == counts.tolist()
    want, counts = np.unique(np.concatenate(parts), return_counts=True)
    whole = quotient.merge(filters, bits)
    got = quotient.decode(whole)
    assert got[0].tolist() == want.tolist() and got[1].tolist() == counts.tolist()
    assert [quotient.count_of(whole, int(x)) for x in want[:40]] == counts[:40].tolist()
    absent = next((x for x in range(1 << min(bits, 16)) if x not in set(want.tolist())), None)
    assert absent is None or quotient.count_of(whole, absent) == 0


# --- exact duplicates -------------------------------------------------------------------------------------------------


def test_duplicates_of_odd_rows(spark):
    table = odd(spark)
    want = by_sql(spark, table, queries.ORACLES["op11_dedup"])
    assert rows_of(dedup.classes(table)) == want
    assert rows_of(dedup.classes(clashing(table))) == want
    assert dedup.classes(table.limit(0)).collect() == []


@pytest.mark.parametrize("bits", [3, 8])
def test_texts_that_share_a_fingerprint_stay_apart(spark, bits):
    table = odd(spark)
    assert rows_of(dedup.classes(table, bits)) == by_sql(spark, table, queries.ORACLES["op11_dedup"])


def test_a_hot_text_is_one_class(spark):
    table = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Copy").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text")).repartition(7)
    rows = dedup.classes(table).collect()
    assert len(rows) == 3000 and sum(r["kept"] for r in rows) == 2001
    assert {(r["keep_id"], r["group_size"]) for r in rows if r["doc_id"] % 3 == 0} == {(2997, 1000)}
    assert all(r["keep_id"] == r["doc_id"] and r["group_size"] == 1 for r in rows if r["doc_id"] % 3)


def test_deduplicated_rows_keep_their_columns(spark):
    table = clashing(odd(spark))
    got = dedup.deduplicated(table)
    assert got.columns == table.columns
    want = [r["doc_id"] for r in dedup.classes(table).where("kept").collect()]
    assert sorted(map(repr, (r["doc_id"] for r in got.collect()))) == sorted(map(repr, want))


def test_filters_are_merged_by_segment(spark, monkeypatch):
    monkeypatch.setattr(dedup, "SEGMENT_ROWS", 64)
    prints = spark.range(4000).select(F.xxhash64(F.col("id") % 1500).alias("fingerprint")).repartition(5)
    filters = dedup.counted(prints, 4000)
    assert filters.count() == 64
    assert dedup.repeated(filters).count() == 1500
    total = sum(int(quotient.decode(r["filter"])[1].sum()) for r in filters.collect())
    assert total == 4000


# --- manifests --------------------------------------------------------------------------------------------------------


def plain_proofs(leaves):
    """(root, siblings of each leaf from the bottom up) by keeping the whole tree."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([hashlib.sha256(b"".join(levels[-1][i : i + 2])).hexdigest().encode() for i in range(0, len(levels[-1]), 2)])
    return levels[-1][0], [[level[(i >> k) ^ 1] if (i >> k) ^ 1 < len(level) else None for k, level in enumerate(levels[:-1])] for i in range(len(leaves))]


@pytest.mark.parametrize("subtree", [1, 2, 3])
@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 31, 32, 33, 64, 100, 255, 256])
def test_traversal_emits_the_paths_of_a_plain_tree(n, subtree):
    leaves = [hashlib.sha256(bytes([i])).hexdigest().encode() for i in range(n)]
    root, paths = plain_proofs(leaves)
    *got, last = merkle.traversal(leaves, (n - 1).bit_length(), subtree)
    assert got == paths and last == [root]


def test_traversal_holds_a_bounded_number_of_nodes():
    leaves = [hashlib.sha256(str(i).encode()).hexdigest().encode() for i in range(4096)]
    import gc

    run = merkle.traversal(leaves, 12, 3)
    most = 0
    for i, _ in enumerate(run):
        if i % 97 == 0:
            most = max(most, sum(len(t.nodes) + len(t._stack) for t in gc.get_objects() if isinstance(t, merkle.Growing)))
    assert most <= 2 * 4 * 15 + 3 * 13


def test_manifest_of_odd_rows(spark):
    table = odd(spark)
    want = by_sql(spark, table, queries.ORACLES["op12_merkle"])
    assert rows_of(merkle.proven(table)) == want
    assert rows_of(merkle.proven(clashing(table).repartition(5))) == want
    assert merkle.proven(table.limit(0)).collect() == []
    assert rows_of(merkle.proven(table.where("doc_id = 61"))) == by_sql(spark, table.where("doc_id = 61"), queries.ORACLES["op12_merkle"])


def test_manifest_of_many_levels_and_trees(spark, monkeypatch):
    """Blocks of four leaves: five levels of blocks, and trees enough for two levels of roots."""
    monkeypatch.setattr(merkle, "BLOCK_BITS", 2)
    rng = random.Random(3)
    rows = [(i, f"t{i}", "hot" if i % 3 else rng.choice([f"l{k}" for k in range(25)] + [None]), "s", i) for i in range(700)]
    table = spark.createDataFrame(rows, DOCS).repartition(6)
    got = rows_of(merkle.proven(table))
    assert got == by_sql(spark, table, queries.ORACLES["op12_merkle"])
    assert 50 < sum(not r[-1] for r in got) < 150
