"""Evaluation of a retriever: metrics of each query, means, comparisons, several projects, and a centrality baseline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import identifier_tokens, without_stopwords
from .batch_retrieval import Answers
from .graph import kept, nodes, pagerank

RESULTS = "project string, query_id string, mode string, impact boolean, retrieved_files array<string>, retrieved_symbols array<string>, expected_files array<string>, expected_symbols array<string>"


def recall(retrieved: str, expected: str, k: int) -> Column:
    """The share of the expected among the first k retrieved; 1 where nothing is expected."""
    top = F.slice(F.col(retrieved), 1, k)
    hits = F.size(F.filter(expected, lambda x: F.array_contains(top, x)))
    return F.when(F.size(expected) == 0, 1.0).otherwise(hits / F.size(expected))


def precision(retrieved: str, expected: str, k: int) -> Column:
    top = F.slice(F.col(retrieved), 1, k)
    return F.when(F.size(top) == 0, 0.0).otherwise(F.size(F.filter(top, lambda x: F.array_contains(F.col(expected), x))) / F.size(top))


def reciprocal_rank(retrieved: str, expected: str) -> Column:
    place = F.array_min(F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(F.col(expected), x), i + 1)), lambda p: p.isNotNull()))
    return F.coalesce(1.0 / place, F.lit(0.0))


def scored(results: DataFrame) -> DataFrame:
    """Adds the metrics of each query."""
    return results.withColumns({
        "recall_at_5_files": recall("retrieved_files", "expected_files", 5), "precision_at_3_files": precision("retrieved_files", "expected_files", 3),
        "recall_at_5_symbols": recall("retrieved_symbols", "expected_symbols", 5), "rr_files": reciprocal_rank("retrieved_files", "expected_files"),
    })


def means(results: DataFrame, *by: str) -> DataFrame:
    """queries and the mean metrics over all queries (or by project, with a row over all, where it is null); impact recall over impact queries alone, 0 without any."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    sums = [F.count("*").alias("queries"), *(mean(c).alias(c) for c in ("recall_at_5_files", "precision_at_3_files", "recall_at_5_symbols")), mean("rr_files").alias("mrr_files"), mean(F.when(F.col("impact"), F.col("recall_at_5_files"))).alias("impact_recall_at_5")]
    rows = scored(results)
    return rows.rollup(*by).agg(*sums) if by else rows.agg(*sums)


def run(spark: SparkSession, queries: list[dict], retrieve: Callable[[str, str], tuple[list[str], list[str]]], impact_ids: set[str] = frozenset(), project: str = "") -> DataFrame:
    """The results of a retriever (text, mode) -> (files, symbols) on a set of queries (id, text, mode, expected)."""
    rows = []
    for q in queries:
        files, symbols = retrieve(q["text"], q["mode"])
        expected = q.get("expected") or {}
        rows.append((project, q["id"], q["mode"], q["id"] in impact_ids, list(files), list(symbols), list(expected.get("files") or []), list(expected.get("symbols") or [])))
    return spark.createDataFrame(rows, RESULTS)


def results(answers: Answers, queries: DataFrame, project: str = "") -> DataFrame:
    """The results of retrieve_many for queries (query_id, mode, impact, expected_files, expected_symbols): one row for each, in one plan.

    Queries without an answer have empty lists. A query's lists are as long as the retrieval's limit.
    """
    def listed(rows: DataFrame, value: str, name: str) -> DataFrame:
        return rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", value))), lambda x: x[value]).alias(name))

    met = queries.join(listed(answers.files, "path", "retrieved_files"), "query_id", "left").join(listed(answers.symbols, "fq_name", "retrieved_symbols"), "query_id", "left")
    none = F.array().cast("array<string>")
    lists = [F.coalesce(c, none).alias(c) for c in ("retrieved_files", "retrieved_symbols", "expected_files", "expected_symbols")]
    return met.select(F.lit(project).alias("project"), F.col("query_id").cast("string").alias("query_id"), "mode", "impact", *lists)


def from_hits(queries: DataFrame, retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, recall_at_5_files, precision_at_3_files, rr_files for sets of expected files that are too large for lists.

    retrieved: query_id, rank, hit (true where it was expected); expected: query_id, expected (how many were).
    """
    hit = F.coalesce("hit", F.lit(False))
    counted = retrieved.groupBy("query_id").agg(
        F.count_if(hit & (F.col("rank") <= 5)).alias("hits5"), F.count_if(hit & (F.col("rank") <= 3)).alias("hits3"), F.count_if(F.col("rank") <= 3).alias("top3"), F.min(F.when(hit, F.col("rank"))).alias("first")
    )
    met = queries.select("query_id").join(expected, "query_id", "left").join(counted, "query_id", "left").na.fill(0, ["expected", "hits5", "hits3", "top3"])
    recall_ = F.when(F.col("expected") == 0, 1.0).otherwise(F.col("hits5") / F.col("expected"))
    precision_ = F.when(F.col("top3") == 0, 0.0).otherwise(F.col("hits3") / F.col("top3"))
    return met.select("query_id", *(F.round(c, 6).alias(n) for n, c in (("recall_at_5_files", recall_), ("precision_at_3_files", precision_), ("rr_files", F.coalesce(1.0 / F.col("first"), F.lit(0.0))))))


def comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, before, after, change of two rows of means."""
    names = ["recall_at_5_files", "precision_at_3_files", "recall_at_5_symbols", "mrr_files", "impact_recall_at_5"]
    long = lambda df, name: df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias(name)) for n in names))).alias("x")).select("x.*")
    return long(before, "before").join(long(after, "after"), "metric").withColumn("change", F.round(F.col("after") - F.col("before"), 6))


def failing(means_row: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """metric, value, least of the metrics below their thresholds."""
    long = means_row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"), F.lit(float(t)).alias("least")) for n, t in thresholds.items()))).alias("x")).select("x.*")
    return long.where("value < least")


def report(results: DataFrame) -> str:
    """Markdown: the means, and the worst queries first. Query sets are files of tens of queries."""
    m = means(results).first()
    lines = ["# Evaluation", "", "| metric | value |", "|---|---|", *(f"| {c} | {m[c]} |" for c in m.asDict()), "", "| query | recall@5 | precision@3 | first hit |", "|---|---|---|---|"]
    rows = scored(results).orderBy("recall_at_5_files", "precision_at_3_files", "query_id").collect()
    return "\n".join(lines + [f"| {r['query_id']} | {r['recall_at_5_files']:.3f} | {r['precision_at_3_files']:.3f} | {r['rr_files']:.3f} |" for r in rows]) + "\n"


def central_baseline(edges: DataFrame, query: str, k: int = 10) -> DataFrame:
    """node, score: personalised PageRank that jumps to the nodes whose names share words with the query, as many as they share."""
    wanted = F.array_distinct(without_stopwords(identifier_tokens(F.lit(query))))
    weights = nodes(edges).select("node", F.size(F.array_intersect(F.array_distinct(identifier_tokens(F.col("node"))), wanted)).cast("double").alias("weight"))
    return pagerank(edges, teleport=weights).select("node", F.col("rank").alias("score")).orderBy(F.desc("score"), "node").limit(k)


def reranked(candidates: DataFrame, judge: Callable[[list[str]], list[float]] | None, key: str = "path", score: str = "score") -> DataFrame:
    """Candidates (few) with their scores scaled by a judge's marks, the best mark counting 1.

    Without a judge, or where it fails or gives another number of marks, or none above 0, they stay as they are.
    """
    rows = candidates.orderBy(F.desc(score), key).select(key, score).collect()
    try:
        marks = judge([r[key] for r in rows]) if judge else []
    except Exception:  # noqa: BLE001 - a judge is an outside service; a failing one changes nothing
        marks = []
    if len(marks) != len(rows) or not rows or max(marks) <= 0:
        return candidates
    made = [(r[key], float(r[score]) * max(0.0, m) / max(marks)) for r, m in zip(rows, marks)]
    return candidates.sparkSession.createDataFrame(made, f"{key} string, {score} double").orderBy(F.desc(score), key)


def sticky(lines: DataFrame, order: str, value: Column, *by: str) -> DataFrame:
    """Adds header: the last value that is not null up to each row, in order, within each group `by`.

    No task sees a whole group: rows are sorted in ranges, each range fills its own rows, and what was last known before a
    range is carried over from one row for each range and group.
    """
    keys = [*by, order]
    ranged = lines.withColumn("siltstone_value", value).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("siltstone_part", F.spark_partition_id())
    ranged = kept(ranged, "sticky")
    own = Window.partitionBy(*by, "siltstone_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = ranged.withColumn("siltstone_own", F.last("siltstone_value", ignorenulls=True).over(own))
    last = ranged.groupBy(*by, "siltstone_part").agg(F.max_by("siltstone_value", F.when(F.col("siltstone_value").isNotNull(), F.col(order))).alias("siltstone_last"))
    before = Window.partitionBy(*by).orderBy("siltstone_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*(F.col(c).alias(f"siltstone_{c}") for c in by), F.col("siltstone_part").alias("siltstone_at"), F.last("siltstone_last", ignorenulls=True).over(before).alias("siltstone_carried"))
    cond = F.col("siltstone_part") == F.col("siltstone_at")
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"siltstone_{c}"))
    return filled.join(carried, cond).select(*lines.columns, F.coalesce("siltstone_own", "siltstone_carried").alias("header"))
