"""The jobs: two runs over growing input, reruns, replays of a batch that was cut off, and their command lines."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import module_articles, queries, scan_corpus
from jobs.common import configured, read_or_empty

ROOT = Path(__file__).resolve().parents[2]
DOCS = "doc_id long, text string, source string, lang string"


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def parts_of(spark, path):
    return {r["f"]: r["m"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select(F.col("path").alias("f"), F.col("modificationTime").alias("m")).collect()}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_jobs_match_their_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    found = con.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df) == sorted((tuple(v for _, v in sorted(zip(names, row))) for row in found.fetchall()), key=repr)


def test_scan_takes_only_what_is_new(spark, tmp_path):
    source, output, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "mark"))
    config = scan_corpus.Config(files_per_batch=1)
    first = [(1, "one", "a", "en"), (2, "two", "a", "de"), (3, None, None, None), (None, "lost", "a", "en"), (4, "same", "b", ""), (4, "same", "b", "")]
    spark.createDataFrame(first, DOCS).coalesce(1).write.mode("append").parquet(source)
    assert scan_corpus.scan(spark, source, output, checkpoint, config) == {"batches": 1, "read": 6, "rejected": 1, "added": 4, "modified": 0}
    before = parts_of(spark, output)
    assert scan_corpus.scan(spark, source, output, checkpoint, config)["batches"] == 0
    second = [(1, "one", "a", "en"), (2, "TWO", "a", "de"), (5, "five", "c", "fr")]
    spark.createDataFrame(second, DOCS).coalesce(1).write.mode("append").parquet(source)
    assert scan_corpus.scan(spark, source, output, checkpoint, config) == {"batches": 1, "read": 3, "rejected": 0, "added": 1, "modified": 1}
    after = parts_of(spark, output)
    assert before.items() <= after.items()  # nothing written before was touched
    got = scan_corpus.versions(spark, source, output, config)
    assert sorted((r["doc_id"], r["batch"], r["event"], r["part"]) for r in got.collect()) == [(1, 0, "added", "en"), (2, 0, "added", "de"), (2, 1, "modified", "de"), (3, 0, "added", "none"), (4, 0, "added", "none"), (5, 1, "added", "fr")]
    last = {r["doc_id"]: r["content_hash"] for r in scan_corpus.known(got, config).collect()}
    assert last == {r["doc_id"]: r["h"] for r in spark.createDataFrame([(1, "one"), (2, "TWO"), (3, ""), (4, "same"), (5, "five")], "doc_id long, t string").select("doc_id", F.sha2("t", 256).alias("h")).collect()}


def test_a_batch_that_was_cut_off_is_written_once(spark, tmp_path, monkeypatch):
    """The output of batch 1 is there but its commit is not: the run fails after the write, and the next one repeats the batch."""
    source, output, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "mark"))
    config = scan_corpus.Config(files_per_batch=1)
    spark.createDataFrame([(1, "one", "a", "en")], DOCS).coalesce(1).write.parquet(source)
    scan_corpus.scan(spark, source, output, checkpoint, config)
    spark.createDataFrame([(1, "ONE", "a", "en"), (2, "two", "a", "en")], DOCS).coalesce(1).write.mode("append").parquet(source)
    calls = []

    def broken(*args):
        calls.append(args)
        raise RuntimeError("cut off")

    monkeypatch.setattr(scan_corpus.log, "info", broken)
    with pytest.raises(Exception, match="cut off"):
        scan_corpus.scan(spark, source, output, checkpoint, config)
    monkeypatch.undo()
    assert len(calls) == 1
    half = rows_of(scan_corpus.versions(spark, source, output, config))
    assert scan_corpus.scan(spark, source, output, checkpoint, config) == {"batches": 1, "read": 2, "rejected": 0, "added": 1, "modified": 1}
    assert rows_of(scan_corpus.versions(spark, source, output, config)) == half and len(half) == 3


def test_any_cut_of_files_into_batches_gives_the_same_last_versions(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    source = f"file://{tmp_path}/in"
    docs.repartition(5, "doc_id").write.parquet(source)
    seen = []
    for n in (0, 1, 3):
        config = scan_corpus.Config(files_per_batch=n)
        total = scan_corpus.scan(spark, source, f"file://{tmp_path}/out{n}", f"file://{tmp_path}/mark{n}", config)
        assert total["added"] == docs.count() and total["modified"] == 0 and total["batches"] == {0: 1, 1: 5, 3: 2}[n]
        seen.append(rows_of(scan_corpus.versions(spark, source, f"file://{tmp_path}/out{n}", config).drop("batch")))
    assert seen[0] == seen[1] == seen[2]


def test_articles_are_refreshed_where_modules_changed(spark, tmp_path):
    output, config = f"file://{tmp_path}/out", module_articles.Config(words=3)
    table = lambda: read_or_empty(spark, output, module_articles.ARTICLES)

    def run(rows, name):
        path = f"file://{tmp_path}/{name}"
        spark.createDataFrame(rows, DOCS).write.parquet(path)
        return module_articles.refresh(spark, path, output, config)

    first = [(1, "Alpha beta alpha the", "m", "en"), (2, "beta ghp_" + "a" * 36, "m", "de"), (3, None, "n/x y", None), (4, "solo word", None, "en"), (5, "solo", "", "en")]
    assert run(first, "one") == {"read": 5, "modules": 3, "dirty": 3, "gone": 0}
    got = {r["name"]: r for r in table().collect()}
    assert got["m"]["words"] == "alpha:2, beta:2, aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa:1" and got["m"]["languages"] == "de:1, en:1" and got["m"]["secrets"] == 1
    assert got["n/x y"]["words"] == "" and got["n/x y"]["bytes"] == 0 and got["none"]["words"] == "solo:2, word:1"
    before, rows = parts_of(spark, output), rows_of(table())
    assert run(first[::-1], "again") == {"read": 5, "modules": 3, "dirty": 0, "gone": 0}
    assert parts_of(spark, output) == before
    assert run([*first[:2], (3, "new", "n/x y", None)], "changed") == {"read": 3, "modules": 2, "dirty": 1, "gone": 1}
    got = {r["name"]: r for r in table().collect()}
    assert got["n/x y"]["words"] == "new:1" and (got["none"]["status"], got["none"]["files"]) == ("gone", 0) and len(got) == 3
    assert run([*first[:2], (3, "new", "n/x y", None)], "still") == {"read": 3, "modules": 2, "dirty": 0, "gone": 0}
    assert run(first, "back") == {"read": 5, "modules": 3, "dirty": 2, "gone": 0}
    assert rows_of(table()) == rows  # as a whole run gives
    assert module_articles.refresh(spark, f"file://{tmp_path}/one", f"file://{tmp_path}/fresh", config)["dirty"] == 3
    assert rows_of(read_or_empty(spark, f"file://{tmp_path}/fresh", module_articles.ARTICLES)) == rows


def test_texts_are_not_dealt_out_by_module(spark, tmp_path, monkeypatch):
    """A module may be a large part of the table: only counts of its words are shuffled. Sending no names gives the same articles."""
    rows = spark.createDataFrame([(i, f"word{i % 7} common", "ab"[i % 2], "en") for i in range(40)] + [(99, "other", "c", "de")], DOCS)
    dirty = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, hash string").repartition(2)
    seen = []
    for most in (module_articles.MOST_SENT, 0):
        monkeypatch.setattr(module_articles, "MOST_SENT", most)
        out = module_articles.articles(rows, dirty, module_articles.Config(), 2)
        plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        moved = [part for part in plan.split("\n\n") if " Exchange" in part.split("\n")[0]]
        assert moved and not [part for part in moved if "text#" in part]
        seen.append(rows_of(out))
    assert seen[0] == seen[1] and [dict(zip(sorted(out.columns), r))["files"] for r in seen[0]] == [20, 20]


def test_articles_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"file://{tmp_path}/in")
    assert module_articles.refresh(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", module_articles.Config()) == {"read": 0, "modules": 0, "dirty": 0, "gone": 0}


def test_configs_are_checked(spark):
    for module, name in ((scan_corpus, "scan_corpus"), (module_articles, "module_articles")):
        assert configured(module.Config, (ROOT / "jobs" / f"{name}.json").read_text())
    with pytest.raises(ValueError, match="unknown settings: colour"):
        configured(scan_corpus.Config, '{"colour": 1}')


@pytest.mark.parametrize("name", ["scan_corpus", "module_articles"])
def test_command_lines(sf, tmp_path, name):
    paths = {"source": f"{sf}/documents.parquet", "output": f"{tmp_path}/out"} | ({"checkpoint": f"{tmp_path}/mark"} if name == "scan_corpus" else {})
    args = [x for k, v in paths.items() for x in (f"--{k}", v)]
    env = os.environ | {"PYTHONPATH": str(ROOT), "SPARK_CONF_DIR": str(tmp_path)}
    (tmp_path / "spark-defaults.conf").write_text("spark.master local[2]\nspark.ui.enabled false\nspark.sql.shuffle.partitions 2\n")
    runs = [subprocess.run([sys.executable, "-m", f"jobs.{name}", *args, "--config", str(ROOT / "jobs" / f"{name}.json")], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300) for _ in range(2)]
    assert [r.returncode for r in runs] == [0, 0], runs[0].stderr[-2000:]
    first, second = (json.loads(r.stdout.strip().splitlines()[-1]) for r in runs)
    assert first["read"] == 200 and sum(second.get(k, 0) for k in ("added", "modified", "dirty", "gone")) == 0
    assert name in runs[0].stderr and "wrote" in runs[0].stderr
