"""Table sinks: appends, inserts that ignore known keys, versioned tables, retention, Markdown artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timeline import keep_newest
from ..schemas import EVENT_TYPES

TRACE_DAYS, TRACES_KEPT, SCAN_DAYS = 30, 2000, 90


def valid_events(events: DataFrame) -> DataFrame:
    """Timeline events of known types; others fail the write."""
    return events.withColumn("event_type", F.when(F.col("event_type").isin(*EVENT_TYPES), F.col("event_type")).otherwise(F.raise_error(F.concat(F.lit("unknown event type "), F.coalesce("event_type", F.lit("null"))))))


def append(rows: DataFrame, path: str, *partitions: str) -> None:
    rows.write.mode("append").partitionBy(*partitions).parquet(path)


def insert_new(table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose key the table lacks, each key once."""
    return rows.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti")


def write_version(rows: DataFrame, root: str, version: int) -> str:
    """A version of a table in a folder of its own, so that no reader sees a half-written one."""
    path = f"{root}/v={version:08d}"
    rows.write.mode("errorifexists").parquet(path)
    return path


def read_version(spark: SparkSession, root: str, version: int, schema: str) -> DataFrame:
    """A version, or an empty table where there is none."""
    try:
        return spark.read.schema(schema).parquet(f"{root}/v={version:08d}")
    except Exception as error:  # noqa: BLE001 - Spark has one class for all analysis errors
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def retained_traces(traces: DataFrame, now: Column) -> DataFrame:
    """Traces of the last days, at most the newest two thousand of a project."""
    return keep_newest(traces, "project", "timestamp", "trace_id", TRACES_KEPT, now - TRACE_DAYS * 86400)


def retained_scans(scans: DataFrame, now: Column) -> DataFrame:
    return scans.where(F.col("timestamp") >= now - SCAN_DAYS * 86400)


def symbol_index(symbols: DataFrame) -> DataFrame:
    """file_path, section: one Markdown section for each file, its symbols by their first line."""
    line = F.struct("start_line", F.concat(F.lit("- "), F.col("symbol_type"), F.lit(" `"), F.col("name"), F.lit("`")).alias("text"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["text"]), "\n")
    return symbols.groupBy("file_path").agg(F.concat(F.lit("## "), F.col("file_path"), F.lit("\n"), lines).alias("section"))


def metrics_text(rows: DataFrame) -> str:
    """Metrics (name, label, value) in the text form that scrapers read. The table is a handful of aggregates."""
    return "".join(f'{r["name"]}{{label="{r["label"]}"}} {r["value"]}\n' for r in rows.orderBy("name", "label").collect())


def publish(notes: DataFrame, folder: str) -> list[str]:
    """Writes notes (path, text) as files below a folder that all executors share, and deletes Markdown files that are no note any more.

    Each file is written beside its place and moved there. Returns the paths that were deleted.
    """
    import pyarrow.fs as pafs

    def write(rows) -> None:
        fs, base = pafs.FileSystem.from_uri(folder)
        for r in rows:
            path = f"{base}/{r['path']}"
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(path + ".part") as out:
                out.write((r["text"] or "").encode())
            fs.move(path + ".part", path)

    notes.select("path", "text").foreachPartition(write)
    fs, base = pafs.FileSystem.from_uri(folder)
    there = [f.path[len(base) :].lstrip("/") for f in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if f.path.endswith(".md")]
    spark = notes.sparkSession
    gone = [r["path"] for r in spark.createDataFrame([(p,) for p in there], "path string").join(notes.select("path"), "path", "left_anti").collect()] if there else []
    for path in gone:
        fs.delete_file(f"{base}/{path}")
    return sorted(gone)


def wiki_links(text: Column) -> Column:
    """Markdown links to other notes as [[target|label]]; code fences, inline code, images and web addresses stay as they are."""
    link = r"(?<!!)(?<!`)\[([^\]\n`]+)\]\((?![a-z][a-z0-9+.-]*:)([^)\s#]+?)(?:\.md)?\)(?!`)"
    rewritten = F.transform(F.split(text, "```"), lambda part, i: F.when(i % 2 == 1, part).otherwise(F.regexp_replace(part, link, r"[[$2|$1]]")))
    return F.array_join(rewritten, "```")


def scan_states(states: DataFrame, new: DataFrame) -> DataFrame:
    """The last scan of each project (project_root, commit_sha, timestamp) after new ones; the latest counts."""
    both = states.unionByName(new)
    return both.groupBy("project_root").agg(F.max_by(F.struct("commit_sha", "timestamp"), "timestamp").alias("x")).select("project_root", "x.*")


def deleted_files(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """Files, symbols and relations without those of deleted files (path), each table by its own column."""
    column = {"files": "path", "symbols": "file_path", "relations": "origin_file", "git_stats": "file_path"}
    return {name: t.join(paths.select(F.col("path").alias(column[name])), column[name], "left_anti") for name, t in tables.items()}
