"""Many queries in one plan against the retrieval of one query after another."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import batch_retrieval, code_graph, evaluation, graph, retrieval
from siltstone.operators.batch_retrieval import retrieve_many, symbol_hits
from siltstone.operators.retrieval import retrieve, symbol_scores

ASKED = {"a": ("login session config", "navigate"), "b": ("login session config", "edit"), "c": ("the of", "navigate"), "d": ("readme parser", "navigate"), "e": ("nothing like that", "edit"), "f": ("parser parser Parser", "edit"), "g": ("", "navigate"), "h": ("pa", "navigate")}


def project(spark):
    rng = random.Random(7)
    names = ["login", "session", "parser", "config", "store", "getUser", "Parser", "sessionParser"]
    paths = [f"{d}/{n.lower()}{i}.py" for i, n in enumerate(names * 3) for d in [rng.choice(["src/auth", "lib", "tests", "docs/readme", "config"])]]
    role = lambda p: {"tests": "test", "docs": "docs", "config": "config"}.get(p.split("/")[0], "source")
    files = spark.createDataFrame([(p, role(p)) for p in paths], "path string, role string")
    symbols = spark.createDataFrame([(rng.choice(names), f"{p[:-3].replace('/', '.')}.{rng.choice(names)}", p) for p in paths for _ in range(2)] + [("h", "docs#h", paths[0]), (None, "lib.none.x", paths[1])], "name string, fq_name string, file_path string")
    edges = spark.createDataFrame([(rng.choice(paths), rng.choice(paths)) for _ in range(60)] + [(p, f"{p[:-3].replace('/', '.')}.run") for p in paths[:5]] + [(paths[9], f"{paths[0][:-3].replace('/', '.')}.run")], "src string, dst string").where("src <> dst").distinct()
    git = spark.createDataFrame([(p, rng.randrange(3), rng.choice([1, 90])) for p in paths[::2]], "file_path string, churn_30d int, age_days int")
    texts = spark.createDataFrame([(q, p, float(rng.randrange(1, 9))) for q in "abdf" for p in rng.sample(paths, 8)], "query_id string, path string, score double")
    vectors = spark.createDataFrame([(q, p, round(rng.random(), 3)) for q in "abce" for p in rng.sample(paths, 15)], "query_id string, path string, score double")
    asked = spark.createDataFrame([(q, t, m) for q, (t, m) in ASKED.items()], "query_id string, text string, mode string")
    return files, symbols, edges, git, texts, vectors, asked


def test_symbols_score_as_for_one_query(spark):
    _, symbols, *_, asked = project(spark)
    got = {}
    for r in symbol_hits(symbols, asked, 1000).collect():
        got.setdefault(r["query_id"], []).append((r["fq_name"], r["file_path"], r["name"] or "", r["score"]))
    for q, (text, _) in ASKED.items():
        want = {(r["fq_name"], r["file_path"], r["name"] or "", r["score"]) for r in symbol_scores(symbols, text).collect()}
        assert sorted(got.get(q, [])) == sorted(want), q


@pytest.mark.parametrize("whole", [True, False])
def test_answers_are_those_of_one_query_after_another(spark, whole):
    files, symbols, edges, git, texts, vectors, asked = project(spark)
    if not whole:
        edges = git = vectors = None
    many = retrieve_many(files, symbols, texts, asked, 5, edges, git, vectors)
    got, names = {q: [] for q in ASKED}, {q: [] for q in ASKED}
    for r in many.files.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["path"], round(r["score"], 5)))
    for r in many.symbols.orderBy("query_id", "rank").collect():
        names[r["query_id"]].append(r["fq_name"])
    coverage = {r["query_id"]: r["coverage"] for r in many.coverage.collect()}
    for q in ["a", "b", "e", "f"] if whole else ["a", "g"]:
        text, mode = ASKED[q]
        own = lambda df: df.where(F.col("query_id") == q).select("path", "score")
        near = None if vectors is None or q not in "abce" else own(vectors)
        one = retrieve(files, symbols, own(texts), text, mode, 5, edges, git, near)
        assert got[q] == [(r["path"], round(r["score"], 5)) for r in one.files.collect()], q
        assert names[q] == [r["fq_name"] for r in one.symbols.orderBy("priority", F.desc("score"), "fq_name").collect()] and coverage[q] == one.coverage, q


def test_results_of_a_batch(spark):
    files, symbols, edges, git, texts, vectors, asked = project(spark)
    answers = retrieve_many(files, symbols, texts, asked, 5)
    first = {r["query_id"]: r["path"] for r in answers.files.where("rank = 1").collect()}
    expected = asked.select("query_id", "mode", (F.col("mode") == "edit").alias("impact"), F.when(F.col("query_id") == "a", F.array(F.lit(first["a"]))).alias("expected_files"), F.lit(None).cast("array<string>").alias("expected_symbols"))
    rows = {r["query_id"]: r for r in evaluation.scored(evaluation.results(answers, expected)).collect()}
    assert len(rows) == len(ASKED) and rows["a"]["recall_at_5_files"] == 1.0 and rows["a"]["rr_files"] == 1.0 and rows["g"]["retrieved_files"] == []
    assert evaluation.means(evaluation.results(answers, expected)).first()["queries"] == len(ASKED)


def test_no_join_broadcasts_a_table_of_all_files(spark, tmp_path, monkeypatch):
    """Queries and what they reach are broadcast, not files, symbols or edges, though these are below the threshold."""
    n = 2000
    path = F.concat(F.lit("app/m"), (F.col("id") % 7).cast("string"), F.lit("/parser_"), F.col("id").cast("string"), F.lit(".py"))
    names = {"name": F.concat(F.lit("parser"), F.col("id").cast("string")), "fq_name": F.concat(F.lit("app.parser"), F.col("id").cast("string"))}
    ids = spark.range(n).withColumns({"path": path, "file_path": path, "role": F.lit("source"), "churn_30d": F.lit(1), "age_days": F.lit(5), **names})
    ids.write.parquet(f"{tmp_path}/large-files")
    files = spark.read.parquet(f"{tmp_path}/large-files")
    to = files.select(F.col("path").alias("dst"), (F.col("id") * 3 % n).alias("to"))
    files.select(F.col("path").alias("src"), F.col("id").alias("to")).join(to, "to").select("src", "dst").write.parquet(f"{tmp_path}/large-edges")
    edges = spark.read.parquet(f"{tmp_path}/large-edges")
    queries = spark.createDataFrame([("a", "parser7 m3", "navigate"), ("b", "where is parser1900", "edit")], "query_id string, text string, mode string")
    texts = files.where("id % 400 = 1").select(F.lit("a").alias("query_id"), "path", (F.col("id") / 10).alias("score"))
    vectors = files.select(F.lit("b").alias("query_id"), "path", (F.col("id") / n).alias("score"))
    plans, write = [], graph.kept

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    for module in (batch_retrieval, retrieval, code_graph):
        monkeypatch.setattr(module, "kept", seen)
    monkeypatch.setattr(batch_retrieval, "pagerank", lambda edges, teleport: edges.select(F.col("src").alias("node"), F.lit(0.5).alias("rank")).distinct())
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        answers = batch_retrieval.retrieve_many(files, files, texts, queries, edges=edges, git=files, vectors=vectors)
        assert answers.files.count() > 4
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", before)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)"))
    whole = 0
    for lines in (plan.splitlines() for plan in plans):
        for i, line in enumerate(lines):
            if "BroadcastExchange" in line:
                below = list(itertools.takewhile(lambda x: depth(x) > depth(line), lines[i + 1 :]))
                whole += any("/large-" in x for x in below) and not any("Join" in x or "Aggregate" in x and "count" in x for x in below)
    assert plans and not whole
