"""Ranked retrieval: symbol lookup, boosts, fusion, cut-offs, coverage, suggestions, and the staged pipeline (retrieve)."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.paths import looks_like_file, stem
from ..functions.text import GENERIC_TOKENS, identifier_tokens, strings, without_stopwords
from .code_graph import mixed_walk
from .graph import expand, kept, pagerank

# Weights of the stages and of the roles in both modes.
SYMBOL_WEIGHT, FTS_WEIGHT, KEEP_SHARE = 3.0, 1.0, 0.4
GRAPH_SEEDS, GRAPH_DECAY = 5, 0.7
ROLE_WEIGHTS = {"navigate": {"source": 1.0, "test": 0.65, "config": 1.10, "docs": 0.35, "other": 0.70}, "edit": {"source": 1.0, "test": 0.95, "config": 1.15, "docs": 0.40, "other": 0.70}}
DOCS_WORDS = ("docs", "documentation", "readme", "changelog", "architecture", "design", "spec", "adr")
DOCS_WEIGHT = 1.20
CONFIG_WORDS = ("config", "settings", "timeout", "ttl", "schedule", "lifetime", "env", "port", "url", "host", "secret", "credential", "database", "db", "connection")
CONFIG_SHARE = 0.5
STEM_BOOST, PARENT_BOOST, ANCESTOR_BOOST = (0.75, 3), (0.25, 2), (0.15, 3)
CHURN_BOOST, NEW_BOOST, NEW_DAYS = 1.10, 1.05, 30
CENTRALITY_BOOST = 0.10
RRF_K = 60


def symbol_scores(symbols: DataFrame, query: str, name: str = "name", fq_name: str = "fq_name") -> DataFrame:
    """Adds score: 10 for the exact name, 3 for a substring of the qualified name, 2 or 1 for each query token in either.

    Query tokens count as often as they occur; symbols without a score, and documentation headings (`#`), are left out.
    """
    low = query.lower()
    tokens = without_stopwords(identifier_tokens(F.lit(query)))
    names, fq = identifier_tokens(F.col(name)), identifier_tokens(F.col(fq_name))
    per_token = F.aggregate(F.transform(tokens, lambda t: F.when(F.array_contains(names, t), 2).when(F.array_contains(fq, t), 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    exact = F.when(F.lower(name) == low, 10).otherwise(0) + F.when(F.contains(F.lower(fq_name), F.lit(low)), 3).otherwise(0)
    score = F.when(F.size(tokens) > 0, exact + per_token).otherwise(0).cast("double")
    return symbols.where(~F.contains(F.col(fq_name), F.lit("#"))).withColumn("score", score).where("score > 0")


def config_boost(scored: DataFrame, query: str, role: str = "role", score: str = "score") -> DataFrame:
    """If the query has a trigger word, scored config files rise to half of the best score."""
    if not set(query.lower().split()) & set(CONFIG_WORDS):
        return scored
    best = scored.agg((CONFIG_SHARE * F.max(score)).alias("least"))
    lifted = F.when((F.col(role) == "config") & (F.col(score) > 0), F.greatest(score, "least")).otherwise(F.col(score))
    return scored.crossJoin(F.broadcast(best)).withColumn(score, lifted).drop("least")


def path_boost(path: Column, query: str | Column) -> Column:
    """What query tokens in the stem, the parent and the earlier segments of a path add."""
    tokens = F.array_distinct(identifier_tokens(F.lit(query) if isinstance(query, str) else query))
    parts = F.split(path, "/")
    parent = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")
    earlier = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), "/")).otherwise("")
    total = F.lit(0.0)
    for text, (weight, cap) in ((stem(path), STEM_BOOST), (parent, PARENT_BOOST), (earlier, ANCESTOR_BOOST)):
        total = total + weight * F.least(F.size(F.array_intersect(F.array_distinct(identifier_tokens(text)), tokens)), F.lit(cap))
    return total


def role_weight(role: Column, query: str, mode: str = "navigate") -> Column:
    weights = ROLE_WEIGHTS[mode]
    out = F.lit(weights["other"])
    for name, weight in weights.items():
        about_docs = name == "docs" and any(word in query.lower() for word in DOCS_WORDS)
        out = F.when(role == name, DOCS_WEIGHT if about_docs else weight).otherwise(out)
    return out


def git_boost(churn: Column, age_days: Column) -> Column:
    return F.when(churn > 0, CHURN_BOOST).otherwise(1.0) * F.when(age_days < NEW_DAYS, NEW_BOOST).otherwise(1.0)


def recency_weight(churn: Column, age_days: Column) -> Column:
    """Teleport weight of a file in the personalised centrality."""
    return F.when(churn > 0, 1 + churn / (1 + age_days / 30)).otherwise(0.0)


def lower_median(df: DataFrame, value: str) -> DataFrame:
    """One row (mid, top): the value at place max(0, n // 2 - 1) in ascending order, and the largest."""
    ranked = global_rank(df.select(F.col(value).alias("v")), [F.col("v")])
    size = ranked.agg(F.count("*").alias("n"), F.max("v").alias("top"))
    return ranked.crossJoin(F.broadcast(size)).where(F.col("rank") == F.greatest(F.floor(F.col("n") / 2), F.lit(1))).select(F.col("v").alias("mid"), "top")


def global_rank(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds rank, from 1, in a total order, without one task that sees all rows: ranges are sorted apart and their sizes summed."""
    place = F.monotonically_increasing_id()
    ranged = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"siltstone_part": F.shiftright(place, 33), "siltstone_place": place.bitwiseAND((1 << 33) - 1)}), "ranked")
    sizes = ranged.groupBy("siltstone_part").agg(F.count("*").alias("siltstone_n"))  # a row for each range
    before = F.coalesce(F.sum("siltstone_n").over(Window.orderBy("siltstone_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("siltstone_part", before.alias("siltstone_before"))
    return ranged.join(F.broadcast(offsets), "siltstone_part").withColumn("rank", F.col("siltstone_before") + F.col("siltstone_place") + 1).drop("siltstone_part", "siltstone_place", "siltstone_before")


def centrality_boost(scored: DataFrame, centrality: str = "centrality", score: str = "score") -> DataFrame:
    """Files above the lower median of the candidates' centrality gain up to a tenth. Candidates are few (two stages' top k)."""
    pivot = lower_median(scored.where(F.col(centrality).isNotNull()), centrality)
    share = (F.col(centrality) - F.col("mid")) / (F.col("top") - F.col("mid"))
    factor = F.when((F.col(centrality) > F.col("mid")) & (F.col("top") > F.col("mid")), 1 + CENTRALITY_BOOST * share).otherwise(1.0)
    return scored.crossJoin(F.broadcast(pivot)).withColumn(score, F.col(score) * factor).drop("mid", "top")


def of_candidates(facts: DataFrame, scored: DataFrame) -> DataFrame:
    """The rows of a table of all paths that the candidates have. Joined first, so that a plan that broadcasts one side takes the candidates, not the table."""
    return facts.join(scored.select("path").distinct(), "path", "left_semi")


def score_decay(scored: DataFrame, score: str = "score") -> DataFrame:
    """Rows with at least 0.4 of the best score."""
    best = scored.agg(F.max(score).alias("best"))
    return scored.crossJoin(F.broadcast(best)).where(F.col(score) >= KEEP_SHARE * F.col("best")).drop("best")


def rrf(rankings: list[tuple[DataFrame, float]], key: str, score: str = "score") -> DataFrame:
    """Weighted reciprocal-rank fusion of whole rankings; a weight of 0 drops a list."""
    parts = [global_rank(ranking.select(key, score), [F.desc(score), F.col(key)]).select(key, (weight / (RRF_K + F.col("rank"))).alias("part")) for ranking, weight in rankings if weight > 0]
    return reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.round(F.sum("part"), 9).alias("fused"))


def vector_weight(top: Column, corpus: Column) -> Column:
    """Weight of the vector ranking by its best score and the size of the corpus; 0 at or below either lower bound."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return clamp((top - 0.45) / 0.25) * clamp((corpus - 100) / 400.0)


def coverage_class(scores: Column) -> Column:
    """high, medium or ambiguous from an array of scores: the first against the fourth (or last) in descending order."""
    ordered = F.sort_array(F.filter(scores, lambda s: s.isNotNull()), asc=False)
    n = F.size(ordered)
    top, tail = F.try_element_at(ordered, F.lit(1)), F.try_element_at(ordered, F.greatest(F.least(n, F.lit(4)), F.lit(1)))
    ratio = F.when(tail <= 0, F.lit(float("inf"))).otherwise(top / tail)
    return F.when((n == 0) | (top <= 0), "ambiguous").when(n == 1, "high").when(ratio >= 2, "high").when(ratio >= 1.2, "medium").otherwise("ambiguous")


def disambiguators(paths: DataFrame, path: str, query: str, k: int = 3) -> DataFrame:
    """Path tokens that split the candidates most evenly: token, coverage."""
    query_tokens = identifier_tokens(F.lit(query))
    cut = F.regexp_replace(F.col(path), r"(?<=[^/])\.[^./]*$", "")
    tokens = F.array_except(F.array_except(F.array_distinct(identifier_tokens(cut)), query_tokens), strings(GENERIC_TOKENS))
    rows = paths.select(path).distinct()
    total = rows.agg(F.count("*").alias("n"))
    counted = rows.select(F.explode(tokens).alias("token")).where(F.length("token") >= 3).groupBy("token").agg(F.count("*").alias("coverage"))
    ranked = counted.crossJoin(F.broadcast(total)).where("coverage < n")
    return ranked.orderBy(F.abs(F.col("coverage") - F.col("n") / 2), F.desc("coverage"), "token").limit(k).select("token", "coverage")


def article_relevance(articles: DataFrame, key: str, text: str, query: str, k: int = 3) -> DataFrame:
    """Distinct query words found in each article line, the best k."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    wanted = without_stopwords(words(F.lit(query)))
    return articles.select(key, F.size(F.array_intersect(words(F.col(text)), wanted)).alias("overlap")).where("overlap > 0").orderBy(F.desc("overlap"), key).limit(k)


def pack_section(role: Column) -> Column:
    """The part of an edit pack a file goes to."""
    return F.when(role == "test", "tests").when(role == "config", "configs").otherwise("targets")


def symbol_list(hits: DataFrame, symbols: DataFrame, top_files: DataFrame, k: int) -> DataFrame:
    """Direct symbol hits, then the symbols of files without hits, each name once."""
    direct = hits.select("fq_name", F.lit(0).alias("priority"), F.col("score"))
    rest = symbols.join(top_files.select(F.col("path").alias("file_path")), "file_path", "left_semi").join(hits.select("file_path").distinct(), "file_path", "left_anti")
    both = direct.unionByName(rest.select("fq_name", F.lit(1).alias("priority"), F.lit(0.0).alias("score")))
    return both.groupBy("fq_name").agg(F.min("priority").alias("priority"), F.max("score").alias("score")).orderBy("priority", F.desc("score"), "fq_name").limit(k)


# --- the staged pipeline ------------------------------------------------------------------------------------------


@dataclass
class Retrieval:
    """files: path, score, the best first. symbols: fq_name. stages: (name, milliseconds, candidates) in their order."""

    files: DataFrame
    symbols: DataFrame
    coverage: str
    stages: list[tuple[str, float, int]] = field(default_factory=list)


def retrieve(
    files: DataFrame,
    symbols: DataFrame,
    text_scores: DataFrame,
    query: str,
    mode: str = "navigate",
    limit: int = 10,
    edges: DataFrame | None = None,
    git: DataFrame | None = None,
    vectors: DataFrame | None = None,
    centrality: bool = True,
) -> Retrieval:
    """Symbols, text, graph, then boosts (config, path, role, centrality, git), vector fusion, cut-off and ranking.

    files: path, role; symbols: name, fq_name, file_path; text_scores: path, score; edges: src, dst; git: file_path,
    churn_30d, age_days; vectors: path, score. Candidates are a few times `limit`; each stage writes them, so no stage
    is computed twice.
    """
    stages: list[tuple[str, float, int]] = []
    began = [time.perf_counter()]

    def done(name: str, df: DataFrame) -> DataFrame:
        seen = Observation()
        out = kept(df.observe(seen, F.count("*").alias("n")), f"retrieve-{name}")
        stages.append((name, (time.perf_counter() - began[0]) * 1000, seen.get["n"]))
        began[0] = time.perf_counter()
        return out

    hits = done("symbols", symbol_scores(symbols, query).select("name", "fq_name", "file_path", "score").orderBy(F.desc("score"), "fq_name", "file_path").limit(2 * limit))
    by_symbol = hits.groupBy(F.col("file_path").alias("path")).agg((SYMBOL_WEIGHT * F.max("score")).alias("score"))
    by_text = text_scores.select("path", (FTS_WEIGHT * F.col("score")).alias("score")).orderBy(F.desc("score"), "path").limit(2 * limit)
    scored = done("text", by_symbol.unionByName(by_text).groupBy("path").agg(F.sum("score").alias("score")))
    if edges is not None:
        seeds = kept(scored.orderBy(F.desc("score"), "path").limit(GRAPH_SEEDS).select(F.col("path").alias("node"), "score"), "retrieve-seeds")
        reached = expand(edges, seeds, 3 if mode == "edit" else 2, GRAPH_DECAY).select("node", "score").unionByName(mixed_walk(edges, seeds, GRAPH_DECAY))
        weight = 1.0 if mode == "edit" else 0.5
        reached = reached.where(looks_like_file(F.col("node"))).select(F.col("node").alias("path"), (weight * F.col("score")).alias("score"))
        scored = done("graph", scored.unionByName(reached).groupBy("path").agg(F.max("score").alias("score")))
    known = scored.join(of_candidates(files.select("path", "role"), scored), "path", "left")
    known = config_boost(known, query).withColumn("score", F.col("score") + path_boost(F.col("path"), query))
    scored = done("roles", known.select("path", (F.col("score") * role_weight(F.col("role"), query, mode)).alias("score")))
    weights = None if git is None else git.select(F.col("file_path").alias("node"), recency_weight(F.col("churn_30d"), F.col("age_days")).alias("weight"))
    if edges is not None and centrality:
        ranks = pagerank(edges, teleport=weights).select(F.col("node").alias("path"), F.col("rank").alias("centrality"))
        central = scored.join(of_candidates(ranks, scored), "path", "left").withColumn("centrality", F.coalesce("centrality", F.lit(0.0)))
        scored = done("centrality", centrality_boost(central).select("path", "score"))
    if git is not None:
        facts = git.select(F.col("file_path").alias("path"), "churn_30d", "age_days")
        scored = done("git", scored.join(of_candidates(facts, scored), "path", "left").select("path", (F.col("score") * git_boost(F.col("churn_30d"), F.col("age_days"))).alias("score")))
    if vectors is not None:
        top = vectors.agg(F.max("score")).first()[0]
        weight = 0.0 if top is None else files.sparkSession.range(1).select(vector_weight(F.lit(float(top)), F.lit(files.count()))).first()[0]
        if weight > 0:
            fused = kept(rrf([(scored, 1.0), (vectors, weight)], "path"), "retrieve-fused")
            best = scored.agg(F.max("score").alias("s")).crossJoin(fused.agg(F.max("fused").alias("f")))
            scored = done("vectors", fused.crossJoin(F.broadcast(best)).select("path", (F.col("fused") * F.coalesce(F.col("s"), F.lit(1.0)) / F.col("f")).alias("score")))
    final = done("cut", score_decay(scored).orderBy(F.desc("score"), "path").limit(limit))
    coverage = final.agg(coverage_class(F.collect_list("score")).alias("c")).first()["c"]
    top_two = final.orderBy(F.desc("score"), "path").limit(2)
    return Retrieval(final.orderBy(F.desc("score"), "path"), symbol_list(hits, symbols.where(~F.contains("fq_name", F.lit("#"))), top_two, limit), coverage, stages)
