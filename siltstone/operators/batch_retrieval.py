"""The staged retrieval for a table of queries in one plan: every stage is keyed by query and path.

The stages are those of retrieval.retrieve: symbols, text, graph, then boosts (config, path, role, centrality, git), vector
fusion, cut-off and ranking. What does not depend on a query (texts, tokens of symbols, edges, centrality) is read once for
all of them. Two tables are written on the way, so that no stage is computed twice. Queries meet symbols by their tokens and
by the first characters of the query, never all with all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import looks_like_file
from ..functions.text import identifier_tokens, strings, without_stopwords
from .code_graph import mixed_walk
from .graph import kept, pagerank
from .retrieval import (
    CENTRALITY_BOOST, CONFIG_SHARE, CONFIG_WORDS, DOCS_WEIGHT, DOCS_WORDS, FTS_WEIGHT, GRAPH_DECAY, GRAPH_SEEDS, KEEP_SHARE, ROLE_WEIGHTS, RRF_K, SYMBOL_WEIGHT,
    coverage_class, git_boost, global_rank, of_candidates, path_boost, recency_weight, vector_weight,
)

DEPTH = {"navigate": 2, "edit": 3}
WALK_WEIGHT = {"navigate": 0.5, "edit": 1.0}
GRAM = 3  # first characters of a query by which it meets the qualified names that hold it


@dataclass
class Answers:
    """files: query_id, path, score, rank; symbols: query_id, fq_name, rank; coverage: query_id, coverage."""

    files: DataFrame
    symbols: DataFrame
    coverage: DataFrame


def _by_mode(values: dict[str, float]) -> Column:
    return F.when(F.col("mode") == "edit", values["edit"]).otherwise(values["navigate"])


def _best(rows: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows of each query with their rank; the limit is applied before the shuffle too."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def symbol_hits(symbols: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, name, fq_name, file_path, score: of each query (query_id, text) the best k symbols.

    10 for the exact name, 3 where the qualified name holds the query, and for each token of the query 2 or 1 as it is in the
    name or in the qualified name only. Queries of stop-words alone have no hits.
    """
    tokens = without_stopwords(identifier_tokens(F.col("text")))
    asked = queries.select("query_id", F.lower("text").alias("low"), tokens.alias("tokens")).where(F.size("tokens") > 0)
    known = symbols.where(~F.contains(F.col("fq_name"), F.lit("#"))).select("name", "fq_name", "file_path").distinct()
    none = F.array().cast("array<string>")
    own = known.withColumns({"in_name": F.coalesce(identifier_tokens(F.col("name")), none), "in_fq": F.coalesce(identifier_tokens(F.col("fq_name")), none)})
    token_rows = own.select("name", "fq_name", "file_path", "in_name", F.explode_outer(F.array_distinct(F.concat("in_name", "in_fq"))).alias("token")).where("token is not null")
    weighted = token_rows.select("name", "fq_name", "file_path", "token", F.when(F.array_contains("in_name", F.col("token")), 2).otherwise(1).alias("points"))
    wanted = asked.select("query_id", F.explode_outer("tokens").alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    columns = ["query_id", "name", "fq_name", "file_path", "points"]
    by_token = weighted.join(wanted, "token").withColumn("points", F.col("points") * F.col("times")).select(*columns)
    exact = known.join(asked.select("query_id", "low"), F.lower("name") == F.col("low")).withColumn("points", F.lit(10).cast("long")).select(*columns)
    low = F.lower("fq_name")
    n = F.length(low)
    grams = F.array_distinct(F.flatten(F.transform(F.array(*(F.lit(g) for g in range(1, GRAM + 1))), lambda g: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i + g <= n + 1), lambda i: F.substring(low, i, g)))))
    placed = known.select("name", "fq_name", "file_path", F.explode_outer(grams).alias("gram"))
    holding = placed.join(asked.select("query_id", "low", F.substring("low", 1, GRAM).alias("gram")), "gram").where(F.contains(F.lower("fq_name"), F.col("low"))).withColumn("points", F.lit(3).cast("long")).select(*columns)
    scored = by_token.unionByName(exact).unionByName(holding).groupBy("query_id", "name", "fq_name", "file_path").agg(F.sum("points").cast("double").alias("score"))
    return _best(scored, k, F.desc("score"), "fq_name", "file_path").drop("rank")


def expand(edges: DataFrame, seeds: DataFrame, depth: int, decay: float = GRAPH_DECAY) -> DataFrame:
    """query_id, node, score: what the seeds (query_id, node, score, depth) reach along and against the edges, decayed by hop.

    A query's seeds are neither entered nor returned. Depths are small; a hop is one join, and a node counts at its nearest hop.
    What a hop reaches is written, so that the next one knows that it is the smaller side, not the edges.
    """
    start = seeds.select("query_id", F.col("node").alias("seed"), F.col("score").alias("seed_score"), "depth", "node")
    closed = seeds.select(F.col("query_id").alias("own"), F.col("node").alias("closed"))
    parts = None
    for source, target in (("src", "dst"), ("dst", "src")):
        directed = edges.select(F.col(source).alias("node"), F.col(target).alias("next"))
        frontier = start
        for hop in range(1, depth + 1):
            step = frontier.where(F.col("depth") >= hop).join(directed, "node").join(closed, (F.col("query_id") == F.col("own")) & (F.col("next") == F.col("closed")), "left_anti")
            frontier = kept(step.select("query_id", "seed", "seed_score", "depth", F.col("next").alias("node")).distinct(), "many-hop")
            part = frontier.select("query_id", "node", (F.col("seed_score") * decay**hop).alias("score"))
            parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("query_id", "node").agg(F.round(F.max("score"), 6).alias("score"))


def _role_weight() -> Column:
    """By mode and role; documentation weighs more where a query asks for it."""
    about_docs = F.lit(False)
    for word in DOCS_WORDS:
        about_docs = about_docs | F.contains(F.lower("text"), F.lit(word))
    out = _by_mode({mode: weights["other"] for mode, weights in ROLE_WEIGHTS.items()})
    for role in ROLE_WEIGHTS["navigate"]:
        weight = _by_mode({mode: weights[role] for mode, weights in ROLE_WEIGHTS.items()})
        out = F.when(F.col("role") == role, F.when(about_docs, DOCS_WEIGHT).otherwise(weight) if role == "docs" else weight).otherwise(out)
    return out


def _boosted(scored: DataFrame, files: DataFrame, queries: DataFrame) -> DataFrame:
    """Config files rise to half of their query's best score where it has a trigger word; then paths and roles count."""
    best = scored.groupBy("query_id").agg(F.max("score").alias("best"))
    known = scored.join(of_candidates(files.select("path", "role"), scored), "path", "left").join(best, "query_id").join(queries, "query_id")
    triggered = F.arrays_overlap(F.split(F.trim(F.lower("text")), r"\s+"), strings(CONFIG_WORDS))
    lifted = F.when(triggered & (F.col("role") == "config") & (F.col("score") > 0), F.greatest(F.col("score"), CONFIG_SHARE * F.col("best"))).otherwise(F.col("score"))
    return known.select("query_id", "path", ((lifted + path_boost(F.col("path"), F.col("text"))) * _role_weight()).alias("score"))


def _central(scored: DataFrame, ranks: DataFrame) -> DataFrame:
    """Files above the lower median of their query's candidates gain up to a tenth by their centrality."""
    met = scored.join(of_candidates(ranks, scored), "path", "left").withColumn("centrality", F.coalesce("centrality", F.lit(0.0)))
    own = Window.partitionBy("query_id")
    placed = met.withColumns({"place": F.row_number().over(own.orderBy("centrality", "path")), "n": F.count("*").over(own)})
    pivots = placed.groupBy("query_id").agg(F.max(F.when(F.col("place") == F.greatest(F.floor(F.col("n") / 2), F.lit(1)), F.col("centrality"))).alias("mid"), F.max("centrality").alias("top"))
    share = (F.col("centrality") - F.col("mid")) / (F.col("top") - F.col("mid"))
    factor = F.when((F.col("centrality") > F.col("mid")) & (F.col("top") > F.col("mid")), 1 + CENTRALITY_BOOST * share).otherwise(1.0)
    return met.join(pivots, "query_id").select("query_id", "path", (F.col("score") * factor).alias("score"))


def _fused(scored: DataFrame, vectors: DataFrame, files: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion with each query's vector ranking, by a weight from its best similarity and the size of the corpus.

    A vector ranking may hold the whole corpus: its places come from sorted ranges, not from one task for a query.
    """
    placed = global_rank(vectors.select("query_id", "path", "score"), [F.col("query_id"), F.desc("score"), F.col("path")])
    tops = placed.groupBy("query_id").agg(F.min("rank").alias("first"), F.max("score").alias("top")).crossJoin(F.broadcast(files.agg(F.count("*").alias("corpus"))))
    weights = tops.select("query_id", "first", vector_weight(F.col("top"), F.col("corpus")).alias("weight")).where("weight > 0")
    weights = kept(weights, "many-weights")  # a row for each query
    near = placed.join(weights, "query_id").select("query_id", "path", (F.col("weight") / (RRF_K + F.col("rank") - F.col("first") + 1)).alias("part"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "path")))
    fusing = ranked.join(weights.select("query_id"), "query_id", "left_semi")
    both = fusing.select("query_id", "path", (1.0 / (RRF_K + F.col("rank"))).alias("part")).unionByName(near)
    fused = kept(both.groupBy("query_id", "path").agg(F.round(F.sum("part"), 9).alias("fused")), "many-fused")
    scale = fused.groupBy("query_id").agg(F.max("fused").alias("f")).join(scored.groupBy("query_id").agg(F.max("score").alias("s")), "query_id", "left")
    scale = kept(scale, "many-scale")  # a row for each query
    out = fused.join(scale, "query_id").select("query_id", "path", (F.col("fused") * F.coalesce(F.col("s"), F.lit(1.0)) / F.col("f")).alias("score"))
    return out.unionByName(scored.join(weights.select("query_id"), "query_id", "left_anti").select("query_id", "path", "score"))


def retrieve_many(
    files: DataFrame,
    symbols: DataFrame,
    texts: DataFrame,
    queries: DataFrame,
    limit: int = 10,
    edges: DataFrame | None = None,
    git: DataFrame | None = None,
    vectors: DataFrame | None = None,
    centrality: bool = True,
) -> Answers:
    """The answers to queries (query_id, text, mode).

    files: path, role; symbols: name, fq_name, file_path; texts and vectors: query_id, path, score; edges: src, dst; git:
    file_path, churn_30d, age_days. Modes other than edit are navigate; a null text finds nothing.
    """
    # Written, because rows that come from the driver have no known size, and a join would broadcast the other side instead.
    queries = kept(queries.select("query_id", F.coalesce("text", F.lit("")).alias("text"), "mode"), "many-queries")
    hits = kept(symbol_hits(symbols, queries, 2 * limit), "many-hits")
    by_symbol = hits.groupBy("query_id", F.col("file_path").alias("path")).agg((SYMBOL_WEIGHT * F.max("score")).alias("score"))
    by_text = _best(texts.select("query_id", "path", (FTS_WEIGHT * F.col("score")).alias("score")), 2 * limit, F.desc("score"), "path").drop("rank")
    scored = by_symbol.unionByName(by_text).groupBy("query_id", "path").agg(F.sum("score").alias("score"))
    if edges is not None:
        scored = kept(scored, "many-scored")
        seeds = _best(scored, GRAPH_SEEDS, F.desc("score"), "path").join(queries, "query_id").select("query_id", F.col("path").alias("node"), "score", _by_mode(DEPTH).alias("depth"))
        seeds = kept(seeds, "many-seeds")
        reached = expand(edges, seeds, max(DEPTH.values())).unionByName(mixed_walk(edges, seeds, GRAPH_DECAY, "query_id"))
        reached = reached.where(looks_like_file(F.col("node"))).join(queries, "query_id").select("query_id", F.col("node").alias("path"), (_by_mode(WALK_WEIGHT) * F.col("score")).alias("score"))
        scored = scored.unionByName(reached).groupBy("query_id", "path").agg(F.max("score").alias("score"))
    scored = _boosted(kept(scored, "many-reached"), files, queries)
    if edges is not None and centrality:
        weights = None if git is None else git.select(F.col("file_path").alias("node"), recency_weight(F.col("churn_30d"), F.col("age_days")).alias("weight"))
        scored = _central(kept(scored, "many-boosted"), pagerank(edges, teleport=weights).select(F.col("node").alias("path"), F.col("rank").alias("centrality")))
    if git is not None:
        facts = git.select(F.col("file_path").alias("path"), "churn_30d", "age_days")
        scored = kept(scored, "many-central")
        scored = scored.join(of_candidates(facts, scored), "path", "left").select("query_id", "path", (F.col("score") * git_boost(F.col("churn_30d"), F.col("age_days"))).alias("score"))
    if vectors is not None:
        scored = _fused(kept(scored, "many-git"), vectors, files)
    best = Window.partitionBy("query_id")
    close = scored.withColumn("best", F.max("score").over(best)).where(F.col("score") >= KEEP_SHARE * F.col("best")).drop("best")
    final = kept(_best(close, limit, F.desc("score"), "path"), "many-final")
    coverage = queries.select("query_id").join(final.groupBy("query_id").agg(F.collect_list("score").alias("scores")), "query_id", "left")
    coverage = coverage.select("query_id", coverage_class(F.coalesce("scores", F.array().cast("array<double>"))).alias("coverage"))
    return Answers(final, _symbols(hits, symbols, final.where("rank <= 2"), limit), coverage)


def _symbols(hits: DataFrame, symbols: DataFrame, top_files: DataFrame, k: int) -> DataFrame:
    """Direct hits first, then the symbols of the best files without hits, each name once."""
    direct = hits.select("query_id", "fq_name", F.lit(0).alias("priority"), "score")
    files = top_files.select("query_id", F.col("path").alias("file_path")).join(hits.select("query_id", "file_path").distinct(), ["query_id", "file_path"], "left_anti")
    rest = symbols.where(~F.contains("fq_name", F.lit("#"))).join(files, "file_path").select("query_id", "fq_name", F.lit(1).alias("priority"), F.lit(0.0).alias("score"))
    both = direct.unionByName(rest).groupBy("query_id", "fq_name").agg(F.min("priority").alias("priority"), F.max("score").alias("score"))
    return _best(both, k, "priority", F.desc("score"), "fq_name").select("query_id", "fq_name", "rank")
