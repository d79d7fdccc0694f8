"""Scans what is new in a corpus into a table of versions: what was added, what was changed, in which run.

    python -m jobs.scan_corpus --source DOCUMENTS --output VERSIONS --checkpoint FOLDER --config jobs/scan_corpus.json

The source is a Parquet table that grows by files. A file stream with a checkpoint takes the files no run has seen, at most
`files_per_batch` to a batch, and ends when there are none left. A document is known by its key. Of each batch a row is
written for every document that is new (`added`) or whose text is not the one last written (`modified`); what is unchanged
writes nothing. Rows hold facts of the text, never the text, so looking back reads little.

Output is partitioned by batch and `partition`, and a batch overwrites its own partitions only: a batch that was cut off is
run again from the same files with the same result. Within a batch, of different texts of one document the one with the
largest hash is its version. Rows without a key are counted as rejected; a null text counts as empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, log, read_or_empty
from siltstone.functions import hashing, paths
from siltstone.functions.text import word_tokens
from siltstone.operators import timeline
from siltstone.sources.code import changed_files
from siltstone.streaming.streams import event_stream


@dataclass(frozen=True)
class Config:
    """key, text: columns of the source; columns: what else of it is kept; partition: the column that partitions the output; files_per_batch: 0 for all."""

    key: str = "doc_id"
    text: str = "text"
    columns: tuple[str, ...] = ("source", "lang")
    partition: str = "lang"
    files_per_batch: int = 0


FACTS = "event string, content_hash string, size_bytes long, words long, has_secret boolean"


def schema_of(source: DataFrame, config: Config) -> str:
    """The schema of the versions of a source, partition columns last."""
    own = [f"`{c}` {source.schema[c].dataType.simpleString()}" for c in (config.key, *config.columns)]
    return ", ".join([*own, FACTS, "batch long", "part string"])


def facts(rows: DataFrame, config: Config) -> DataFrame:
    """One row for each key of some rows: the kept columns, and what a scan knows of a text."""
    text = F.coalesce(F.col(config.text), F.lit(""))
    found = rows.select(
        config.key, *config.columns, hashing.content_hash(text).alias("content_hash"), F.octet_length(text).cast("long").alias("size_bytes"),
        F.size(word_tokens(text)).cast("long").alias("words"), paths.has_secret(text).alias("has_secret"),
    )
    others = [*config.columns, "size_bytes", "words", "has_secret"]
    return found.groupBy(config.key).agg(F.max(F.struct("content_hash", *others)).alias("x")).select(config.key, "x.*")


def known(versions: DataFrame, config: Config) -> DataFrame:
    """The last version of each document."""
    return timeline.latest(versions, config.key, "batch", "content_hash", *(c for c in versions.columns if c != config.key))


def scan(spark: SparkSession, source: str, output: str, checkpoint: str, config: Config) -> dict:
    """Takes what is new in `source`; returns and logs what was read and written."""
    stream = event_stream(spark, source, config.files_per_batch or None)
    schema = schema_of(stream, config)
    total = {"batches": 0, "read": 0, "rejected": 0, "added": 0, "modified": 0}

    def handle(batch: DataFrame, number: int) -> None:
        key = F.col(config.key)
        counts = batch.agg(F.count("*").alias("read"), F.count_if(key.isNull()).alias("rejected")).first().asDict()  # reads the key column only
        rows = batch.where(key.isNotNull())
        before = known(read_or_empty(spark, output, schema).where(F.col("batch") < number), config).select(config.key, "content_hash", F.lit(True).alias("seen"))
        new = changed_files(facts(rows, config), before, config.key)
        marked = new.join(before.select(config.key, "seen"), config.key, "left").withColumn("event", F.when(F.col("seen"), "modified").otherwise("added")).drop("seen")
        part = F.coalesce(F.when(F.length(F.col(config.partition).cast("string")) > 0, F.col(config.partition).cast("string")), F.lit("none"))
        out = marked.withColumns({"batch": F.lit(number).cast("long"), "part": part})
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "part").parquet(output)
        written = read_or_empty(spark, output, schema).where(F.col("batch") == number)
        counts |= written.agg(F.count_if(F.col("event") == "added").alias("added"), F.count_if(F.col("event") == "modified").alias("modified")).first().asDict()
        log.info("scan_corpus batch %d: read %d rows of %s, rejected %d; wrote %d added, %d modified to %s", number, counts["read"], source, counts["rejected"], counts["added"], counts["modified"], output)
        total["batches"] += 1
        for name, n in counts.items():
            total[name] += n

    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if not total["batches"]:
        log.info("scan_corpus: nothing new in %s", source)
    return total


def versions(spark: SparkSession, source: str, output: str, config: Config) -> DataFrame:
    """All that was written."""
    return read_or_empty(spark, output, schema_of(spark.read.parquet(source), config))


if __name__ == "__main__":
    command("scan_corpus", __doc__.splitlines()[0], ("source", "output", "checkpoint"), Config, scan)
