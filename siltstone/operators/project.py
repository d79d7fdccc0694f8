"""A project's tables in one place: its health, what its answers must do without, answers as packs, a watch over time."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fts, packs
from .modules import degraded
from .retrieval import Retrieval, retrieve
from .text_index import TextIndex


@dataclass
class Project:
    """files: path, role, text; symbols: name, fq_name, file_path; edges: src, dst; git: file_path, churn_30d, age_days;
    vectors: path, embedding; states: name, status of articles; memories as sources.stores reads them. What is missing is None."""

    name: str
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame | None = None
    git: DataFrame | None = None
    vectors: DataFrame | None = None
    states: DataFrame | None = None
    memories: DataFrame | None = None
    index: TextIndex | None = None
    last_scan: float | None = None

    def check(self, now: float) -> dict[str, object]:
        """Numbers of the tables and what answers must do without."""
        counts = {name: 0 if df is None else df.count() for name, df in (("files", self.files), ("symbols", self.symbols), ("edges", self.edges), ("vectors", self.vectors))}
        dirty = 0 if self.states is None else self.states.where("status = 'dirty'").count()
        return {"project": self.name, **counts, "dirty": dirty, "degraded": degraded(counts["files"], self.last_scan, counts["vectors"], dirty, now)}

    def retrieve(self, query: str, mode: str = "navigate", limit: int = 10, vector_scores: DataFrame | None = None) -> Retrieval:
        if self.index is not None:
            found = self.index.search(query, 2 * limit).select(F.col(self.index.key).alias("path"), "score")
        else:
            variants = fts.variants(query)
            terms = variants[-1][0] if variants else []
            found = fts.bm25(self.files, "path", F.coalesce("text", F.lit("")), terms).select("path", "score") if terms else self.files.limit(0).select("path", F.lit(0.0).alias("score"))
        return retrieve(self.files, self.symbols, found, query, mode, limit, self.edges, self.git, vector_scores)

    def ask(self, query: str, now: float, mode: str = "navigate", limit: int = 10, vector_scores: DataFrame | None = None) -> tuple[packs.Pack, list[str]]:
        """A pack for a question, and what it had to do without. An empty project gives an empty pack."""
        lacks = self.check(now)["degraded"]
        return packs.build(self.retrieve(query, mode, limit, vector_scores), self.name, query, mode, self.memories), lacks

    def watch(self, seconds: float, every: float, now: Callable[[], float], sleep: Callable[[float], None] = time.sleep) -> list[dict[str, object]]:
        """Checks again and again for a time; keeps those that differ from the one before."""
        seen: list[dict[str, object]] = []
        end = now() + seconds
        while True:
            found = self.check(now())
            if not seen or seen[-1] != found:
                seen.append(found)
            if now() >= end:
                return seen
            sleep(every)


def health(files: DataFrame, symbols: DataFrame, scans: DataFrame, now: Column) -> DataFrame:
    """project, files, symbols, last_scan, stale of every project (files: project, path; symbols: project; scans: project, timestamp)."""
    counted = files.groupBy("project").agg(F.countDistinct("path").alias("files"))
    owned = symbols.groupBy("project").agg(F.count("*").alias("symbols"))
    last = scans.groupBy("project").agg(F.max("timestamp").alias("last_scan"))
    out = counted.join(owned, "project", "left").join(last, "project", "left").na.fill(0, ["symbols"])
    return out.withColumn("stale", F.col("last_scan").isNull() | (now - F.col("last_scan") > 86400))
