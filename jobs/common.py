"""What the jobs share: configs, tables that may not be there yet, the command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("siltstone.jobs")


def configured(kind: type, text: str):
    """A config from JSON; unknown names are refused."""
    values = json.loads(text)
    unknown = set(values) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one where nothing has been written yet. The schema names the partition columns too."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:  # noqa: BLE001 - Spark has one class for all analysis errors
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def command(name: str, about: str, arguments: tuple[str, ...], config: type, run: Callable[..., dict]) -> None:
    """The command line of a job: paths by name, --config FILE; the session is made and stopped here only."""
    parser = argparse.ArgumentParser(prog=name, description=about)
    for argument in arguments:
        parser.add_argument(f"--{argument}", required=True, metavar="PATH")
    parser.add_argument("--config", required=True, metavar="FILE", help="JSON, read by Spark")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        settings = configured(config, spark.read.text(given.pop("config"), wholetext=True).first()[0])
        print(json.dumps(run(spark, **given, config=settings)))
    finally:
        spark.stop()
