"""Versions and schema versions of many projects: migration, torn and unknown versions, pruning, writes that were cut off."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltstone.operators import analytics
from siltstone.sources.project_store import ProjectStore, Schema

IMPORTS = {
    1: Schema("src string, dst string", lambda rows: rows.withColumn("kind", F.lit("imports"))),
    2: Schema("src string, dst string, kind string", lambda rows: rows.withColumnRenamed("dst", "target")),
    3: Schema("src string, target string, kind string"),
}


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def store(spark, tmp_path, schemas=IMPORTS):
    return ProjectStore(spark, f"file://{tmp_path}/store", {"imports": schemas})


def add(spark, own, version, *rows):
    columns = {1: "project string, src string, dst string", 2: "project string, src string, dst string, kind string", 3: "project string, src string, target string, kind string"}
    return own.write("imports", spark.createDataFrame(rows, columns[version]), version)


def test_versions_are_migrated_and_the_newest_counts(spark, tmp_path):
    own = store(spark, tmp_path)
    assert own.read("imports").collect() == [] and own.problems("imports").collect() == []
    add(spark, own, 1, ("a/b", "x.py", "os"), ("a/b", "y.py", "re"), ("old", "z.py", "os"))
    add(spark, own, 2, ("two", "m.py", "os", "from"))
    add(spark, own, 3, ("a/b", "x.py", "json", "imports"), (None, "lost", "lost", "lost"))
    assert rows_of(own.read("imports")) == sorted([("imports", "a/b", "x.py", "json"), ("imports", "old", "z.py", "os"), ("from", "two", "m.py", "os")])
    assert rows_of(own.read("imports", ["two", "none"])) == [("from", "two", "m.py", "os")]
    shared = analytics.shared_patterns(own.read("imports"), "project", F.col("target"), 2).collect()
    assert [(r["pattern"], r["projects"]) for r in shared] == [("os", 2)]


def test_only_the_wanted_partitions_are_read(spark, tmp_path):
    own = store(spark, tmp_path)
    for k in range(3):
        add(spark, own, 3, *((f"p{i}", f"v{k}", "os", "imports") for i in range(6)))
    read = own.read("imports", ["p2"])
    assert rows_of(read) == [("imports", "p2", "v2", "os")]
    assert "PartitionFilters: [isnotnull" in read._jdf.queryExecution().executedPlan().toString()
    assert {f.rsplit("project=", 1)[1].split("/")[0] for f in (r[0] for r in read.select(F.input_file_name()).collect())} == {"p2"}


def test_broken_projects_are_refused_and_the_others_read(spark, tmp_path):
    add(spark, store(spark, tmp_path), 3, ("good", "a", "os", "imports"), ("torn", "a", "os", "imports"), ("torn", "b", "re", "imports"))
    add(spark, store(spark, tmp_path), 3, ("new", "a", "os", "imports"))
    later = ProjectStore(spark, f"file://{tmp_path}/store", {"imports": IMPORTS | {4: Schema("src string, target string, kind string, line int")}})
    later.write("imports", spark.createDataFrame([("new", "a", "os", "imports", 7)], "project string, src string, target string, kind string, line int"))
    (row,) = (tmp_path / "store" / "imports").glob("version=*/schema=3/project=torn")
    for f in row.glob("*.parquet"):
        f.unlink()
    spark.createDataFrame([("a", "os", "imports")], "src string, target string, kind string").coalesce(1).write.mode("append").parquet(f"file://{row}")
    own = store(spark, tmp_path)
    assert sorted(map(tuple, own.problems("imports").collect())) == [("new", "unknown schema 4"), ("torn", "torn")]
    assert rows_of(own.read("imports")) == [("imports", "good", "a", "os")]


def test_a_write_that_was_cut_off_does_not_count(spark, tmp_path, monkeypatch):
    own = store(spark, tmp_path)
    add(spark, own, 3, ("p", "a", "os", "imports"))

    def broken(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(ProjectStore, "_enter", broken)
    with pytest.raises(RuntimeError, match="lost"):
        add(spark, own, 3, ("p", "b", "re", "imports"), ("q", "c", "re", "imports"))
    monkeypatch.undo()
    assert rows_of(own.read("imports")) == [("imports", "p", "a", "os")]
    add(spark, own, 3, ("p", "d", "io", "imports"))
    assert rows_of(own.read("imports")) == [("imports", "p", "d", "io")]


def test_many_projects_are_joined(spark, tmp_path, monkeypatch):
    from siltstone.sources import project_store

    own = store(spark, tmp_path)
    add(spark, own, 3, *((f"p{i}", "a", "os", "imports") for i in range(5)))
    add(spark, own, 3, ("p1", "b", "os", "imports"))
    want = rows_of(own.read("imports"))
    monkeypatch.setattr(project_store, "PRUNED_PROJECTS", 2)
    assert rows_of(own.read("imports")) == want and len(want) == 5
