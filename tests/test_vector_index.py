"""The inverted file of vectors against a scan: recall, changes, deletions, odd rows; values carried across ranges."""

from __future__ import annotations

import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.operators import evaluation, vector_index
from siltstone.operators.vector_index import VectorIndex

ROWS = "key long, project string, embedding array<float>"


def exact(rows, query, k):
    scores = []
    for key, _, v in rows:
        v, q = np.array(v, float), np.array(query, float)
        norm = np.linalg.norm(v) * np.linalg.norm(q)
        scores.append((-round(float(v @ q / norm) if norm else 0.0, 6), key))
    return [(key, -s) for s, key in sorted(scores)[:k]]


def test_recall_on_the_embeddings(spark, sf, tmp_path):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("key"), F.col("label").cast("string").alias("project"), "embedding")
    index = VectorIndex.build(vectors, f"file://{tmp_path}/i")
    queries = vectors.where("key % 10 = 0").select(F.col("key").alias("query_id"), "embedding")
    assert index.recall(queries) >= 0.95
    assert index.recall(queries, probes=1) < 1.0  # less is read, and something missed


def test_changes_answer_like_the_rows_that_are_left(spark, tmp_path):
    rng = np.random.default_rng(3)
    make = lambda ids, project: [(int(i), project, rng.normal(size=6).round(3).tolist()) for i in ids]
    rows = make(range(120), "a") + make(range(120, 160), "b") + make(range(160, 170), None)
    frame = lambda r: spark.createDataFrame(r, ROWS)
    index = VectorIndex.build(frame(rows + [(None, "a", [1.0] * 6), (999, "a", None)]), f"file://{tmp_path}/i", cells=8)
    queries = spark.createDataFrame([(f"q{i}", v) for i, (_, _, v) in enumerate(rows[:3])] + [("zero", [0.0] * 6)], "query_id string, embedding array<double>")

    def check(left):
        got = {}
        for r in index.scan(queries, 7).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["key"], r["score"]))
        for r in queries.collect():
            want = exact(left, r["embedding"], 7)
            assert [k for k, _ in got[r["query_id"]]] == [k for k, _ in want] and np.allclose([s for _, s in got[r["query_id"]]], [s for _, s in want], atol=2e-6)

    check(rows)
    changed = make([0, 5, 150], "a") + make([500], "c")
    index.upsert(frame(changed))
    left = [r for r in rows if r[0] not in (0, 5, 150)] + changed
    check(left)
    index.delete_project("b")
    left = [r for r in left if r[1] != "b"]
    check(left)
    again = make([121], "b")
    index.upsert(frame(again))
    check(left + again)
    own = index.search(queries.withColumn("project", F.lit("c")), 7, 8)
    assert {r["key"] for r in own.collect()} == {500}


def test_an_empty_index_finds_nothing(spark, tmp_path):
    index = VectorIndex.build(spark.createDataFrame([], ROWS), f"file://{tmp_path}/i")
    assert index.search(spark.createDataFrame([("q", [1.0, 2.0])], "query_id string, embedding array<double>")).collect() == []


@pytest.mark.parametrize("ranges", [1, 7])
def test_values_are_carried_across_ranges(spark, ranges):
    rows = [("r" if i % 5 else None, i, f"h{i}" if i % 37 == 4 or i == 90 else None) for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["n"]: r["header"] for r in evaluation.sticky(spark.createDataFrame(rows, "repo string, n int, v string").repartition(3), "n", F.col("v"), "repo").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, last = {}, {}
    for repo, n, v in rows:
        last[repo] = v or last.get(repo)
        want[n] = last[repo]
    assert got == want


def test_cells_of_a_batch_are_found_in_bounded_memory():
    """A batch of 10,000 rows against 1,800 cells; the same cells as by one product."""
    rng = np.random.default_rng(2)
    rows, centres = rng.normal(size=(10_000, 16)), rng.normal(size=(1_800, 16))
    units = pd.Series(list(rows))
    tracemalloc.start()
    got = vector_index.nearest_cells(units, centres, 12)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    near = rows[:700] @ centres.T
    places = np.take_along_axis(near, np.stack(got[:700]), axis=1)
    assert len(got) == 10_000 and np.allclose(places, -np.sort(-near, axis=1)[:, :12])
    assert peak < 60e6
    print("peak MB", peak / 1e6)
    assert not vector_index.nearest_cells(units[:0], centres, 12)


def plan_rows(df):
    """The most rows that a node of the plan made, once it has run."""
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plan.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plan.append(node.plan())
        else:
            plan += [node.children().apply(i) for i in range(node.children().size())]
        if node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
    return most


def test_pairs_of_queries_and_rows_never_become_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, "a", v) for i, v in enumerate(rng.normal(size=(3000, 8)).tolist())]
    vectors = spark.createDataFrame(rows, ROWS).repartition(6)
    index = VectorIndex.build(vectors, f"file://{tmp_path}/i")
    assert len(list((tmp_path / "i/vectors").rglob("*.parquet"))) < 80  # 54 cells
    queries = vectors.where("key % 10 = 0").select(F.col("key").alias("query_id"), "embedding")
    found = index.scan(queries, 5)
    got = sorted((r["query_id"], r["rank"], r["key"], r["score"]) for r in found.collect())
    assert plan_rows(found) <= 20_000  # not 900,000
    assert "hashpartitioning(key" not in found._jdf.queryExecution().executedPlan().toString()  # the index is not dealt out for deletions that are not there
    units = np.array([v for _, _, v in rows], np.float32).astype(float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    scores = np.round(units[::10] @ units.T, 6)
    want = [(q * 10, n + 1, int(key)) for q in range(300) for n, key in enumerate(np.lexsort((np.arange(3000), -scores[q]))[:5])]
    assert [g[:3] for g in got] == want and np.allclose([g[3] for g in got], [scores[q // 10, key] for q, _, key in want], atol=2e-6)


def test_large_cells_and_many_queries_are_cut(spark, tmp_path, monkeypatch):
    """One vector fills most of a cell that is cut into parts, queries are cut into blocks; ties go by key, odd vectors and projects as ever."""
    rng = np.random.default_rng(6)
    vectors = [[1.0, 2.0, 3.0, 0.0]] * 150 + rng.integers(-3, 4, size=(90, 4)).astype(float).tolist() + [[0.0] * 4]
    rows = [(f"k{i * 7 % 241:03d}", "abc"[i % 3] if i % 10 else None, v) for i, v in enumerate(vectors)]
    index = VectorIndex.build(spark.createDataFrame(rows, "key string, project string, embedding array<float>"), f"file://{tmp_path}/i", cells=5)
    for name, n in (("PART_ROWS", 20), ("LEAST_ROWS", 4), ("KEPT", 60), ("TILE", 50)):
        monkeypatch.setattr(vector_index, name, n)
    asked = [(i, rows[i * 9][1], rows[i * 9][2]) for i in range(26)]
    queries = spark.createDataFrame([*asked, (99, "a", None)], "query_id int, project string, embedding array<float>")
    for frame, left in ((queries.drop("project"), lambda p: rows), (queries, lambda p: [r for r in rows if r[1] == p])):
        for k in (1, 6, 500):
            got = {}
            for r in index.scan(frame, k).orderBy("query_id", "rank").collect():
                got.setdefault(r["query_id"], []).append((r["key"], r["score"]))
            assert set(got) == set(range(26))
            for i, project, v in asked:
                want = exact(left(project), v, k)
                assert [x for x, _ in got[i]] == [x for x, _ in want] and np.allclose([s for _, s in got[i]], [s for _, s in want], atol=2e-6)


def test_vectors_with_nan_come_first_and_spoil_no_cell(spark, tmp_path):
    nan = float("nan")
    rows = [(i, "a", [nan, 1.0, 2.0] if i in (3, 8) else [float(i % 5), 1.0, float(i % 3)]) for i in range(40)]
    index = VectorIndex.build(spark.createDataFrame(rows, ROWS), f"file://{tmp_path}/i", cells=6)
    assert all(x == x for r in spark.read.parquet(f"{tmp_path}/i/centroids").collect() for x in r["centroid"])
    found = index.scan(spark.createDataFrame([(0, [1.0, 1.0, 1.0])], "query_id int, embedding array<float>"), 4).orderBy("rank").collect()
    assert [r["key"] for r in found] == [3, 8, *(key for key, _ in exact([r for r in rows if r[0] not in (3, 8)], [1.0, 1.0, 1.0], 2))]
    assert [r["score"] != r["score"] for r in found] == [True, True, False, False]


def test_the_length_of_a_vector_is_taken_once(spark):
    """Time grows with the number of elements, not with its square."""
    for n in (40, 4000):  # the first run warms up
        wide = spark.range(8).coalesce(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("float")).alias("v"))
        began = time.time()
        got = [r["u"] for r in wide.select(vector_index.unit(F.col("v")).alias("u")).collect()]
        took = time.time() - began
    assert took < 10
    want = np.arange(1, 4001) / np.linalg.norm(np.arange(1, 4001))
    assert all(np.allclose(u, want, rtol=1e-12) for u in got)
    odd = spark.createDataFrame([([0.0, 0.0],), ([3.0, None],), ([],)], "v array<float>")
    assert [r["u"] for r in odd.select(vector_index.unit(F.col("v")).alias("u")).collect()] == [[0.0, 0.0], [0.0, 0.0], []]


def test_parts_hold_neighbouring_cells_or_a_piece_of_one():
    places = vector_index.laid_out({0: 3, 1: 4, 2: 4, 4: 25, 5: 1}, 10)
    assert places == [(0, 0, 1), (1, 0, 1), (2, 1, 1), (4, 2, 3), (5, 5, 1)]
    assert vector_index.parts_of(places) == 6 and vector_index.parts_of([]) == 1


def test_nearest_rows_against_all_pairs():
    rng = np.random.default_rng(8)
    units, asked = rng.integers(-2, 3, size=(500, 3)) / 4.0, rng.integers(-2, 3, size=(60, 3)) / 4.0
    cells, places = rng.integers(0, 7, 500), rng.permutation(500)
    looks = [np.sort(rng.choice(9, 4, replace=False)) for _ in asked]
    groups = rng.integers(0, 3, 500), rng.integers(-1, 3, 60)
    for own in (None, groups):
        query, row, score = vector_index.nearest_rows(units, cells, places, asked, np.repeat(np.arange(60), 4), np.concatenate(looks), 9, own)
        for q in range(60):
            met = [i for i in range(500) if cells[i] in looks[q] and (own is None or groups[0][i] == groups[1][q])]
            want = sorted(met, key=lambda i: (-round(float(units[i] @ asked[q]), 6), places[i]))[:9]
            assert row[query == q].tolist() == want and np.allclose(score[query == q], units[want] @ asked[q])
