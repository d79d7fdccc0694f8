"""Metrics, patterns, registry audits, evaluation, vectors and chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86400.0


def sparkline(rows: DataFrame, ts: Column, now: Column, days: int, *aggregates: Column) -> DataFrame:
    """bucket 0..days-1 with aggregates (0 where a day has none): floor of the age in days since the start, clamped."""
    since = now - days * DAY
    bucket = F.greatest(F.lit(0), F.least(F.lit(days - 1), F.floor((ts - since) / DAY).cast("int")))
    found = rows.where((ts >= since) & (ts <= now)).groupBy(bucket.alias("bucket")).agg(*aggregates)
    all_days = rows.sparkSession.range(days).select(F.col("id").cast("int").alias("bucket"))
    return all_days.join(F.broadcast(found), "bucket", "left").na.fill(0)


def rolling_sums(rows: DataFrame, group: str, ts: Column, value: Column, now: Column, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Sums over the last days by group and, with a null group, over all."""
    sums = [F.round(F.sum(F.when(ts >= now - d * DAY, value).otherwise(0)), 4).alias(f"sum_{d}d") for d in windows]
    return rows.rollup(group).agg(*sums)


# What a coverage class counts in a mean.
COVERAGE_SCORES = {"high": 1.0, "medium": 0.5, "ambiguous": 0.25}


def coverage_score(coverage: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, score in COVERAGE_SCORES.items():
        out = F.when(coverage == name, score).otherwise(out)
    return out


def value_metrics(packs: DataFrame, files: Column, returned: Column, now: Column) -> DataFrame:
    """One row from packs (project, timestamp, mode, coverage): packs, packs_7d, active projects, classes of coverage, modes, compression.

    compression: files for each active project over files returned for each pack (1 at least). files and returned are
    aggregates over the packs.
    """
    active, n = F.countDistinct("project"), F.count("*")
    return packs.agg(
        n.alias("packs"), F.count_if(F.col("timestamp") >= now - 7 * DAY).alias("packs_7d"), active.alias("active"), *(F.count_if(F.col("coverage") == c).alias(c) for c in COVERAGE_SCORES),
        F.count_if(F.col("mode") == "edit").alias("edit"), F.round((files / active) / F.greatest(F.lit(1.0), returned / n), 6).alias("compression"),
    )


def budget_status(spent: Column, limit: Column) -> Column:
    return F.when(limit.isNull() | (limit <= 0), "disabled").when(spent >= limit, "exceeded").when(spent >= 0.8 * limit, "warning").otherwise("ok")


def model_cost(tokens_in: Column, cached: Column, tokens_out: Column, price: Column, price_cached: Column, price_out: Column) -> Column:
    """US dollars for prices per million tokens."""
    return F.round(((tokens_in - cached) * price + cached * price_cached + tokens_out * price_out) / 1e6, 8)


def histogram(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """le, n: cumulative bucket counts in one pass."""
    counts = rows.agg(*(F.sum((F.col(value) <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(bounds)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)))).alias("x")).select("x.*")


def shared_patterns(rows: DataFrame, project: str, dependency: Column, least: int) -> DataFrame:
    """pattern, projects, confidence: what at least `least` projects have in common."""
    total = rows.agg(F.countDistinct(project).alias("total"))
    found = rows.select(project, dependency.alias("pattern")).distinct().groupBy("pattern").agg(F.count("*").alias("projects")).where(F.col("projects") >= least)
    return found.crossJoin(F.broadcast(total)).select("pattern", "projects", F.round(F.col("projects") / F.col("total"), 6).alias("confidence"))


def is_stale(packs: Column, last_scan: Column, now: Column, days: int) -> Column:
    """No packs, and never scanned or not for some days."""
    return (F.coalesce(packs, F.lit(0)) == 0) & (last_scan.isNull() | (now - last_scan >= days * DAY))


def eval_metrics(results: DataFrame, k_recall: int = 5, k_precision: int = 3) -> DataFrame:
    """Adds recall, precision and reciprocal rank to (retrieved, expected) arrays.

    Nothing expected means recall 1; precision divides by what was retrieved among the first k.
    """
    top_r, top_p = F.slice("retrieved", 1, k_recall), F.slice("retrieved", 1, k_precision)
    n = F.size("expected")
    recall = F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_distinct(top_r), "expected")) / n)
    precision = F.when(F.size(top_p) == 0, 0.0).otherwise(F.size(F.filter(top_p, lambda x: F.array_contains("expected", x))) / F.size(top_p))
    hit = F.transform("retrieved", lambda x, i: F.when(F.array_contains("expected", x), i + 1))
    first = F.array_min(F.filter(hit, lambda x: x.isNotNull()))
    return results.withColumns({"recall": recall, "precision": precision, "rr": F.coalesce(1.0 / first, F.lit(0.0))})


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in double precision."""
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(double(a), double(b), lambda x, y: x * y))
    norm = lambda c: F.sqrt(total(F.transform(double(c), lambda x: x * x)))
    return dot / (norm(a) * norm(b))


def vector_top_k(vectors: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The k nearest vectors: one scan and a top-k, no shuffle of the table."""
    literal = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, F.round(cosine(F.col(vector), literal), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def hash_embedding(text: Column, width: int = 8) -> Column:
    """A deterministic stand-in for an embedding model: digests of the text as numbers in [-1, 1]."""
    digest = F.sha2(text.cast("binary"), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.conv(F.substring(digest, i * 4 + 1, F.lit(4)), 16, 10).cast("double") / 32767.5 - 1)


def chunk_lines(text: str, budget: int, count: Callable[[str], int]) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, text) of chunks within a token budget that prefer to end at a blank line."""
    if not text or not text.strip():
        return
    held: list[tuple[str, int]] = []
    first, size, blank = 1, 0, None

    def cut(n: int) -> tuple[int, int, str]:
        nonlocal held, first, size, blank
        out = (first, first + n - 1, "".join(line for line, _ in held[:n]))
        held, first, blank = held[n:], first + n, None
        size = sum(cost for _, cost in held)
        return out

    for line in text.splitlines(keepends=True):
        cost = count(line)
        if cost > budget:  # a line over the budget is a chunk of its own
            if held:
                yield cut(len(held))
            held = [(line, cost)]
            yield cut(1)
            continue
        if held and size + cost > budget:
            yield cut(blank if blank and blank > 1 else len(held))
        held.append((line, cost))
        size += cost
        if not line.strip():
            blank = len(held)
    if held:
        yield cut(len(held))


def chunks(docs: DataFrame, key: str, text: str, budget: int = 512) -> DataFrame:
    """key, chunk, start_line, end_line, text with a white-space token counter."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, a, b, t) for k, body in zip(batch[key], batch[text]) for i, (a, b, t) in enumerate(chunk_lines(body or "", budget, lambda s: len(s.split())))]
            yield pd.DataFrame(rows, columns=["key", "chunk", "start_line", "end_line", "text"])

    return docs.select(key, text).mapInPandas(run, f"key {kind}, chunk int, start_line int, end_line int, text string").withColumnRenamed("key", key)
