"""Structured Streaming versions of the incremental paths."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.graph import shared_folder

LATENESS = "1 day"


def event_stream(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """A file stream over a Parquet table; time-zone-free timestamps become UTC timestamps, which watermarks need.

    The files that are there make one batch, so that none of a stored table's rows comes behind the watermark, whatever
    the order of its files. per_batch: at most so many files to a batch, for tables whose files are in time order.
    """
    table = spark.read.parquet(path)
    schema, files = table.schema, table.inputFiles()
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    if len(files) == 1 and files[0].rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1]:  # a single file is read through its folder
        folder, name = path.rsplit("/", 1)
        raw = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        raw = reader.parquet(path)
    naive = [f.name for f in schema if f.dataType.typeName() == "timestamp_ntz"]
    return raw.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else raw


def drain(stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote: exactly-once Parquet files in the shared folder."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{root}-checkpoint").option("path", f"{root}-out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}-out")


def drain_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], name: str = "stream") -> None:
    """Runs a stream over all that is there, one call of `handle` per micro-batch."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{root}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def tumbling(events: DataFrame, ts: str, width: str, *keys: str) -> DataFrame:
    return windowed(events, ts, F.window(ts, width), *keys)


def sliding(events: DataFrame, ts: str, width: str, slide: str, *keys: str) -> DataFrame:
    return windowed(events, ts, F.window(ts, width, slide), *keys)


def sessions(events: DataFrame, ts: str, gap: str, *keys: str) -> DataFrame:
    return windowed(events, ts, F.session_window(ts, gap), *keys)


def windowed(events: DataFrame, ts: str, window: Column, *keys: str) -> DataFrame:
    """start, end, keys, n, total of `value`; on a stream state is dropped once the watermark has passed."""
    source = events.withWatermark(ts, LATENESS) if events.isStreaming else events
    out = source.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def deduplicated(events: DataFrame, ts: str, *keys: str) -> DataFrame:
    """The first event of each key; a stream forgets keys that are older than the watermark."""
    return events.withWatermark(ts, LATENESS).dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))


def last_operations(changes: DataFrame, keys: tuple[str, ...], op: str, ts: str, id_: str) -> DataFrame:
    """A debounced batch: the last operation of each key."""
    return changes.groupBy(*keys).agg(F.max_by(op, F.struct(ts, id_)).alias(op), F.max(ts).alias(ts))


def debounced(changes: DataFrame, keys: tuple[str, ...], op: str, ts: str, id_: str, pause: str) -> DataFrame:
    """keys, op, ts, changes: bursts of changes of one key, each with its last operation, once nothing has come for `pause`.

    A burst is a session: every change pushes its end by the pause. On a stream it is held in state until the watermark
    passes that end, which is the timer; it is then written once and its state is dropped. Changes may come in any order
    and in any batches, as long as they are not later than the lateness.
    """
    source = changes.withWatermark(ts, LATENESS) if changes.isStreaming else changes
    last = F.max(F.struct(ts, id_, op)).alias("last")
    bursts = source.groupBy(*keys, F.session_window(ts, pause).alias("burst")).agg(last, F.count("*").alias("changes"))
    return bursts.select(*keys, F.col(f"last.{op}").alias(op), F.col(f"last.{ts}").alias(ts), "changes")


TAG_EVENTS = "project string, tag string, kind string, sha string, previous string, poll long"


def tag_events(polls: DataFrame) -> DataFrame:
    """project, tag, kind, sha, previous, poll: tags that a poll shows for the first time (created) or at another commit (moved).

    polls: a stream of (project, poll, tag, sha), the tags of a project at its polls, which are numbered without gaps and come
    in order. The state of a tag is the commit and the poll it was last seen at; a tag that a poll did not show is created
    when it comes back. Vanished tags are no events: what was recorded under them stays valid.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sha, last = state.get if state.exists else (None, None)
        out = []
        rows = pd.concat(list(frames))[["poll", "sha"]].drop_duplicates().sort_values(["poll", "sha"])  # one tag's polls of a batch
        for poll, now in rows.itertuples(index=False):
            kind = "created" if last is None or poll > last + 1 else "moved" if now != sha else None
            if kind:
                out.append((*key, kind, now, sha if kind == "moved" else None, int(poll)))
            sha, last = now, int(poll)
        state.update((sha, last))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TAG_EVENTS.split(", ")])

    return polls.groupBy("project", "tag").applyInPandasWithState(run, TAG_EVENTS, "sha string, poll long", "append", GroupStateTimeout.NoTimeout)


def write_once(stream: DataFrame, path: str, checkpoint: str, *keys: str) -> StreamingQuery:
    """Starts a sink that writes each key once, however often it comes and however often a batch is run.

    A batch writes the rows whose key no batch before it has written (of equal keys in a batch any one), into a partition of
    its own that a rerun overwrites: a batch that was written but not committed leaves no duplicates. The keys are looked up
    in the table itself, so nothing is forgotten as state behind a watermark is. Ends when all that is there is written.
    """
    columns = [f for f in stream.schema if f.name != "batch"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", batch long"

    def handle(rows: DataFrame, number: int) -> None:
        before = written(rows.sparkSession, path, schema).where(F.col("batch") < number).select(*keys)
        new = rows.dropDuplicates(list(keys))
        met = new.join(before.select(*(F.col(k).alias(f"old_{k}") for k in keys)), reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"old_{k}")) for k in keys)), "left_anti")
        met.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that streams write, empty before the first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:  # noqa: BLE001 - Spark has one class for all analysis errors
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


# --- the change loop ----------------------------------------------------------------------------------------------


class ChangeLoop:
    """Handles a stream of file changes (project, path, op, ts, id) batch by batch, project by project.

    Of each path the last operation of a batch counts. A project whose handler raises goes to the quarantine table with
    the error and the batch, and does not hold up the others. After a batch, hooks get the number of dirty modules of its
    projects: `job` once `threshold` of them are reached, `sync` at most every `pause` seconds.
    """

    def __init__(self, handle: Callable[[str, DataFrame], int], quarantine: str, threshold: int = 3, pause: float = 60.0, job: Callable[[str, int], None] | None = None, sync: Callable[[str], None] | None = None, clock: Callable[[], float] = time.monotonic) -> None:
        self.handle, self.quarantine, self.threshold, self.pause, self.job, self.sync, self.clock = handle, quarantine, threshold, pause, job, sync, clock
        self.synced: dict[str, float] = {}

    def __call__(self, batch: DataFrame, number: int) -> None:
        changes = last_operations(batch, ("project", "path"), "op", "ts", "id").persist()
        try:
            for project in sorted(r["project"] for r in changes.select("project").distinct().collect()):  # projects of a batch are few
                self.one(project, changes.where(F.col("project") == project), number)
        finally:
            changes.unpersist()

    def one(self, project: str, changes: DataFrame, number: int) -> None:
        try:
            dirty = self.handle(project, changes)
        except Exception as error:  # noqa: BLE001 - whatever a project's handler raises must not stop the others
            row = [(project, number, type(error).__name__, str(error).split("\n")[0])]
            changes.sparkSession.createDataFrame(row, "project string, batch long, error string, detail string").write.mode("append").parquet(self.quarantine)
            return
        if self.job and dirty >= self.threshold:
            self.job(project, dirty)
        now = self.clock()
        if self.sync and now - self.synced.get(project, -self.pause) >= self.pause:
            self.synced[project] = now
            self.sync(project)


def run_loop(changes: DataFrame, loop: ChangeLoop, checkpoint: str, every: str | None = "2 seconds") -> StreamingQuery:
    """Starts the loop on a stream; every=None handles what is there and ends."""
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return changes.writeStream.foreachBatch(loop).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def watched(query: StreamingQuery, seconds: float, interval: float = 1.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> list[dict]:
    """The progress of a query, one entry for each batch seen, until it ends or the time is over."""
    seen: dict[int, dict] = {}
    end = clock() + seconds
    while True:
        for p in query.recentProgress:
            seen[p["batchId"]] = {"batch": p["batchId"], "rows": p["numInputRows"]}
        if not query.isActive or clock() >= end:
            return [seen[k] for k in sorted(seen)]
        sleep(interval)


def timeline_sink(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Timeline events, each symbol, commit and kind once."""
    return write_once(events, path, checkpoint, "symbol_id", "commit_sha", "event_type")
