"""Streams that keep state: bursts and their timers, tags over polls, the sink that writes once."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siltstone.streaming import streams

CHANGES = "project string, path string, op string, ts timestamp, id long"
START = dt.datetime(2024, 1, 1)


def changes(n, seed=1):
    rng = random.Random(seed)
    return [("p", f"f{rng.randrange(4)}", rng.choice(["modified", "deleted", "created"]), START + dt.timedelta(seconds=rng.randrange(0, 3000, 7)), i) for i in range(n)]


def bursts(rows, pause):
    """(path, op, ts, changes) of bursts by sorting; those that end after the watermark are left out by the caller."""
    out, by_path = [], {}
    for _, path, op, ts, id_ in sorted(rows, key=lambda r: (r[3], r[4])):
        own = by_path.setdefault(path, [])
        if own and ts < own[-1][1] + dt.timedelta(seconds=pause):
            own[-1] = (op, ts, own[-1][2] + 1)
        else:
            own.append((op, ts, 1))
    for path, own in by_path.items():
        out += [(path, *b) for b in own]
    return sorted(out)


@pytest.mark.parametrize("files", [1, 2, 7])
def test_bursts_are_written_once_and_leave_no_state(spark, tmp_path, files):
    """Any batching gives the bursts of a sort, the last operation of each; an event far later flushes all, and the state is empty."""
    rows = changes(60)
    end = ("p", "end", "modified", START + dt.timedelta(days=9), 999)
    for k in range(files):
        spark.createDataFrame(rows[k::files], CHANGES).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    for later in (end, ("p", "end", "modified", START + dt.timedelta(days=19), 1000)):
        spark.createDataFrame([later], CHANGES).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = streams.debounced(streams.event_stream(spark, f"file://{tmp_path}/in", 1), ("project", "path"), "op", "ts", "id", "20 seconds")
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/mark").option("path", f"file://{tmp_path}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r["path"], r["op"], r["ts"], r["changes"]) for r in spark.read.parquet(f"file://{tmp_path}/out").where("path <> 'end'").collect())
    assert got == bursts(rows, 20)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held[-1] == 1 and max(held) > 1  # only the event that flushed the rest


def test_bursts_in_batch_are_the_same(spark):
    rows = changes(80, 2)
    got = streams.debounced(spark.createDataFrame(rows, CHANGES), ("project", "path"), "op", "ts", "id", "20 seconds")
    assert sorted((r["path"], r["op"], r["ts"], r["changes"]) for r in got.collect()) == bursts(rows, 20)


@pytest.mark.parametrize("per_batch", [1, 4])
def test_tags_are_events_once(spark, tmp_path, per_batch):
    polls = [{"v1": "a", "v2": "b"}, {"v1": "a", "v2": "c"}, {"v1": "a", "v3": "d"}, {"v1": "e", "v2": "c", "v3": "d"}]
    for k, tags in enumerate(polls):
        spark.createDataFrame([("p", k, t, s) for t, s in tags.items()] + [("q", k, "x", "1")], "project string, poll long, tag string, sha string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    rows = streams.drain(streams.tag_events(streams.event_stream(spark, f"file://{tmp_path}/in", per_batch)), name="tags").collect()
    want = [("p", "v1", "created", "a", None, 0), ("p", "v1", "moved", "e", "a", 3), ("p", "v2", "created", "b", None, 0), ("p", "v2", "moved", "c", "b", 1), ("p", "v2", "created", "c", None, 3), ("p", "v3", "created", "d", None, 2), ("q", "x", "created", "1", None, 0)]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_a_replayed_batch_leaves_no_duplicates(spark, tmp_path, monkeypatch):
    """The second batch is written, then its query is cut off before the commit; the next start runs it again."""
    schema = "symbol_id string, commit_sha string, event_type string, n int"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    run = lambda: streams.timeline_sink(streams.event_stream(spark, f"file://{tmp_path}/in", 1), f"file://{tmp_path}/out", f"file://{tmp_path}/mark").awaitTermination()
    table = lambda: sorted((r["symbol_id"], r["commit_sha"] or "", r["event_type"], r["n"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    add([("a", "c1", "added", 1), ("a", "c1", "added", 1), ("b", None, "added", 2)])
    run()
    add([("a", "c1", "added", 1), ("a", "c2", "modified", 3), ("b", None, "added", 2)])
    from pyspark.sql.readwriter import DataFrameWriter

    plain = DataFrameWriter.parquet

    def cut(self, *args, **kwargs):
        plain(self, *args, **kwargs)
        raise RuntimeError("killed after the write")

    monkeypatch.setattr(DataFrameWriter, "parquet", cut)
    with pytest.raises(Exception, match="killed after the write"):
        run()
    monkeypatch.undo()
    want = [("a", "c1", "added", 1), ("a", "c2", "modified", 3), ("b", "", "added", 2)]
    assert table() == want
    run()
    assert table() == want
    add([("a", "c2", "modified", 3)])
    run()
    assert table() == want


def test_the_sink_writes_each_key_once_in_any_batching(spark, tmp_path):
    rows = [(f"k{random.Random(i).randrange(30)}", i) for i in range(200)]
    spark.createDataFrame(rows, "k string, v int").repartition(6).write.parquet(f"file://{tmp_path}/in")
    for n in (1, 4):
        streams.write_once(streams.event_stream(spark, f"file://{tmp_path}/in", n), f"file://{tmp_path}/out{n}", f"file://{tmp_path}/mark{n}", "k").awaitTermination()
        got = [r["k"] for r in spark.read.parquet(f"file://{tmp_path}/out{n}").collect()]
        assert sorted(got) == sorted({k for k, _ in rows})
