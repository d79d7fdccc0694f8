"""SparkSession factory and table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "siltstone", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with UTC times and adaptive execution; on a cluster pass a configured session instead."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"} | conf
    return SparkSession.builder.appName(name).master(f"local[{cores}]").config(map=settings).getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table. Time-zone-free timestamps become UTC timestamps, as watermarks need."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def spread(df: DataFrame) -> DataFrame:
    """The rows of a small table over all cores. A file of one row group is read by one task, and so is all that is computed
    from its texts; a table with as many partitions as cores, as any large one has, stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
