"""Git as a source: history by ranges of commits in partitions; what is one line or a short list comes from the driver."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.evaluation import sticky

SEPARATOR = "\x1f"
LOG_FORMAT = f"%H{SEPARATOR}%an{SEPARATOR}%aI{SEPARATOR}%s"


def _git(root: str, *arguments: str) -> str | None:
    """The output of a git command; None where git, the repository or the revision is not there."""
    try:
        done = subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True, timeout=60, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def head_sha(root: str) -> str | None:
    out = _git(root, "rev-parse", "HEAD")
    return out.strip() if out else None


def resolve(root: str, reference: str) -> str | None:
    """The commit a name stands for."""
    out = _git(root, "rev-parse", "--verify", "--quiet", f"{reference}^{{commit}}")
    return out.strip() if out else None


def changed_files(spark: SparkSession, root: str) -> DataFrame:
    """path of the files that differ from the last commit; none where git cannot tell."""
    rows = (_git(root, "diff", "--name-only", "HEAD") or "").splitlines()
    return spark.createDataFrame([(r,) for r in rows if r], "path string")


def commits(spark: SparkSession, root: str, per_partition: int = 50_000) -> DataFrame | None:
    """sha, parent of all commits that branches, tags and the reflog reach (parent null for roots); None where there is no repository."""
    if _git(root, "rev-parse", "--git-dir") is None:
        return None
    return _source(spark, root, "parents", "", per_partition)


def history(spark: SparkSession, root: str, repository: str = "", per_partition: int = 2_000) -> DataFrame:
    """repository, sha, author, ts, subject, file_path, seq: the files of each commit that HEAD reaches, seq counting commits, the newest first.

    Read by ranges of commits, a partition each; a git that fails raises. The repository must be at the same path for every
    executor. A repository without commits has no history.
    """
    return _source(spark, root, "changes", repository, per_partition)


def _source(spark: SparkSession, root: str, what: str, repository: str, per_partition: int) -> DataFrame:
    spark.dataSource.register(GitSource)
    return spark.read.format("siltstone_git").option("path", root).option("what", what).option("repository", repository).option("per_partition", per_partition).load()


@dataclass
class _Range(InputPartition):
    """Commits skip to skip + count of a walk from fixed starting points."""

    start: tuple[str, ...]
    skip: int
    count: int


class GitSource(DataSource):
    """History of a repository as a partitioned table: `what` is changes (files of commits) or parents."""

    SCHEMAS = {"changes": "repository string, sha string, author string, ts double, subject string, file_path string, seq long", "parents": "sha string, parent string"}

    @classmethod
    def name(cls) -> str:
        return "siltstone_git"

    def schema(self) -> str:
        return self.SCHEMAS[self.options["what"]]

    def reader(self, schema) -> DataSourceReader:
        return _GitReader(dict(self.options))


class _GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.what, self.repository, self.size = options["path"], options["what"], options["repository"], int(options["per_partition"])

    def _lines(self, *arguments: str) -> Iterator[str]:
        """The lines of a command as they come; its failure is an error."""
        with subprocess.Popen(["git", "-C", self.root, "-c", "core.quotePath=false", *arguments], stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, encoding="utf-8", errors="replace") as run:
            for line in run.stdout:
                yield line.rstrip("\n")
            problem = run.stderr.read()
        if run.returncode:
            raise OSError(f"git {arguments[0]} in {self.root} failed: {problem.strip()}")

    def partitions(self) -> list[_Range]:
        """Ranges of a walk whose starting points are fixed here, so that a commit made meanwhile shifts nothing."""
        if self.what == "changes":
            heads = list(self._lines("rev-list", "--max-count=1", "HEAD", "--")) if any(self._lines("rev-list", "--all", "--max-count=1")) else []
        else:
            heads = sorted(set(self._lines("rev-list", "--all", "--reflog", "--no-walk")))
        total = int(next(self._lines("rev-list", "--count", *heads, "--"))) if heads else 0
        return [_Range(tuple(heads), k, self.size) for k in range(0, total, self.size)] or [_Range((), 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if not partition.start:
            return
        window = (f"--skip={partition.skip}", f"--max-count={partition.count}")
        if self.what == "parents":
            for line in self._lines("rev-list", "--parents", *window, *partition.start, "--"):
                sha, *parents = line.split()
                for parent in parents or [None]:
                    yield sha, parent
            return
        head, k = None, partition.skip - 1
        for line in self._lines("log", f"--pretty=format:{LOG_FORMAT}", "--name-only", *window, *partition.start, "--"):
            if SEPARATOR in line:
                head, k = line.split(SEPARATOR, 3), k + 1
            elif line.strip():
                yield self.repository, head[0], head[1], datetime.fromisoformat(head[2]).timestamp(), head[3], line, k


def tags(spark: SparkSession, root: str) -> DataFrame:
    rows = [tuple(line.split(" ", 1)) for line in (_git(root, "for-each-ref", "--format=%(refname:short) %(objectname)", "refs/tags") or "").splitlines()]
    return spark.createDataFrame(rows, "tag string, sha string")


def changes(lines: DataFrame) -> DataFrame:
    """repository, sha, author, ts, subject, file_path, seq from stored log lines (repository, n, value): a line with separators heads the file names below it."""
    head = F.when(F.contains("value", F.lit(SEPARATOR)), F.col("value"))
    rows = sticky(lines, "n", head, "repository").where(~F.contains("value", F.lit(SEPARATOR)) & (F.trim("value") != "") & F.col("header").isNotNull())
    f = F.split("header", SEPARATOR)
    return rows.select("repository", f[0].alias("sha"), f[1].alias("author"), F.unix_timestamp(F.to_timestamp(f[2])).cast("double").alias("ts"), f[3].alias("subject"), F.col("value").alias("file_path"), F.col("n").alias("seq"))


def recent(history: DataFrame, since: Column | None = None, path: str | None = None, limit: int = 50) -> DataFrame:
    """sha, author, ts, subject, files of the newest commits, after a time and touching a path (or anything below it) where these are given."""
    rows = history if since is None else history.where(F.col("ts") >= since)
    touched = F.lit(True) if path is None else (F.col("file_path") == path) | F.col("file_path").startswith(path.rstrip("/") + "/")
    grouped = rows.groupBy("repository", "sha").agg(F.first("author").alias("author"), F.first("ts").alias("ts"), F.first("subject").alias("subject"), F.array_sort(F.collect_set("file_path")).alias("files"), F.max(touched).alias("touched"), F.min("seq").alias("seq"))
    return grouped.where("touched").orderBy(F.desc("ts"), "seq").limit(limit).select("sha", "author", "ts", "subject", "files")
