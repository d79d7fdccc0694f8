"""Tables of many projects below one root, in versions and schema versions, read as one table.

    root/<table>/version=<v>/schema=<s>/project=<p>/   the rows, in the columns of schema version s
    root/<table>-versions/                             one row for each project and version: what makes a version count

A write adds a version of some projects and then its rows of the versions table; the newest entered version of a project is
its current one, so a reader sees the old rows or the new ones and never half of either. A version may have any schema
version the store knows: rows of older ones are migrated when they are read. A project whose current version is of an unknown
schema, or whose rows are not as many as were entered, is refused and named by `problems`; the others are read all the same.
Reads name their projects in a filter on partition columns, so nothing else is listed or opened.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VERSIONS = "project string, schema int, version long, rows long"
PRUNED_PROJECTS = 10_000  # versions that may be named in a filter; beyond that they are joined


@dataclass(frozen=True)
class Schema:
    """A schema version of a table: its columns (without project), and how rows of it become rows of the next version."""

    columns: str
    migrate: Callable[[DataFrame], DataFrame] = field(default=lambda rows: rows)


class ProjectStore:
    """schemas: by table, by version from 1 up; the largest is the one that is read and written by default."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, dict[int, Schema]]) -> None:
        self.spark, self.root, self.schemas = spark, root, schemas

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except Exception as error:  # noqa: BLE001 - Spark has one class for all analysis errors
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def _entered(self, table: str) -> DataFrame:
        return self._read(f"{self.root}/{table}-versions", _VERSIONS)

    def current(self, table: str) -> DataFrame:
        """project, schema, version, rows of the newest version of each project."""
        newest = F.max_by(F.struct("schema", "version", "rows"), "version").alias("x")
        return self._entered(table).groupBy("project").agg(newest).select("project", "x.*")

    def write(self, table: str, rows: DataFrame, schema: int | None = None) -> int:
        """A new version of the projects that rows name (project and the columns of a schema version). Returns its number.

        Numbers grow over all projects of a table; what a write that was cut off has left under a number is overwritten.
        """
        schema = max(self.schemas[table]) if schema is None else schema
        names = [f.name for f in self.spark.createDataFrame([], self.schemas[table][schema].columns).schema]
        number = (self._entered(table).agg(F.max("version")).first()[0] or 0) + 1
        out = rows.where("project is not null").select(*names, F.lit(schema).alias("schema"), "project")
        out.write.mode("overwrite").partitionBy("schema", "project").parquet(f"{self.root}/{table}/version={number}")
        self._enter(table, schema, number)
        return number

    def _enter(self, table: str, schema: int, number: int) -> None:
        found = self._rows(table, schema).where(F.col("version") == number).groupBy("project").agg(F.count("*").alias("rows"))
        found.select("project", F.lit(schema).alias("schema"), F.lit(number).cast("long").alias("version"), "rows").coalesce(1).write.mode("append").parquet(f"{self.root}/{table}-versions")

    def _rows(self, table: str, schema: int) -> DataFrame:
        return self._read(f"{self.root}/{table}", f"{self.schemas[table][schema].columns}, version long, schema int, project string").where(F.col("schema") == schema)

    def _wanted(self, table: str, projects: list[str] | None) -> DataFrame:
        found = self.current(table)
        return found if projects is None else found.where(F.col("project").isin(*projects))

    def _own(self, table: str, schema: int, wanted: DataFrame) -> DataFrame:
        """The rows of the wanted versions, chosen by partition columns."""
        keys = wanted.where(F.col("schema") == schema).select("project", "version")
        few = keys.limit(PRUNED_PROJECTS + 1).collect()
        rows = self._rows(table, schema)
        if len(few) > PRUNED_PROJECTS:
            return rows.join(keys, ["project", "version"], "left_semi")
        chosen = F.concat_ws("/", F.col("version").cast("string"), "project").isin(*(f"{r['version']}/{r['project']}" for r in few))
        return rows.where(chosen & F.col("project").isin(*(r["project"] for r in few)))

    def read(self, table: str, projects: list[str] | None = None) -> DataFrame:
        """project and the columns of the newest schema version, of all projects (or some) that have no problem."""
        wanted = self._wanted(table, projects).join(self.problems(table, projects), "project", "left_anti")
        versions, out = sorted(self.schemas[table]), []
        for schema in versions:
            rows = self._own(table, schema, wanted).drop("schema", "version")
            for step in versions[versions.index(schema) : -1]:
                rows = self.schemas[table][step].migrate(rows)
            names = [f.name for f in self.spark.createDataFrame([], self.schemas[table][versions[-1]].columns).schema]
            out.append(rows.select("project", *names))
        return reduce(DataFrame.unionByName, out)

    def problems(self, table: str, projects: list[str] | None = None) -> DataFrame:
        """project, problem: current versions that cannot be read. Only the files' row counts are looked at."""
        wanted = self._wanted(table, projects)
        known = F.col("schema").isin(*self.schemas[table])
        unknown = wanted.where(~known).select("project", F.concat(F.lit("unknown schema "), F.col("schema").cast("string")).alias("problem"))
        there = reduce(DataFrame.unionByName, [self._own(table, s, wanted).groupBy("project").agg(F.count("*").alias("there")) for s in sorted(self.schemas[table])])
        torn = wanted.where(known).join(there, "project", "left").where(~F.col("rows").eqNullSafe(F.col("there"))).select("project", F.lit("torn").alias("problem"))
        return unknown.unionByName(torn)
