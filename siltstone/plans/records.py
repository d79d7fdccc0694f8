"""Queries over stores: traces, summaries, vectors, registries, modules, articles, headings, evaluation, term handling."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, terms, text
from ..operators import analytics, evaluation, modules, packs, retrieval, timeline
from ..operators.graph import shared_folder
from ..operators.vector_index import VectorIndex
from ..session import load
from ..sources import code, gitlog, sinks, stores
from ..sources.project_store import ProjectStore, Schema
from .bindings import table

QUERIES, ORACLES, query = table()

NOW = 1706745600.0  # after the last event


def _traces(spark: SparkSession, sf: str) -> DataFrame:
    """Events as retrievals: users are projects, the value is the time of the first of two stages."""
    ev = load(spark, sf, "events")
    path = lambda k: F.concat(F.lit("f"), (F.col("event_id") * k % 17).cast("string"))
    few = F.array(*(F.struct(path(k).alias("path"), F.lit(1.0).alias("score")) for k in (1, 2, 3)))
    stages = F.array(F.struct(F.lit("symbols").alias("name"), F.col("value").alias("elapsed_ms"), few.alias("candidates")), F.struct(F.lit("cut").alias("name"), F.lit(1.5).alias("elapsed_ms"), F.slice(few, 1, 1).alias("candidates")))
    return ev.select(F.col("event_id").cast("string").alias("trace_id"), F.col("user_id").cast("string").alias("project"), F.col("event_type").alias("mode"), F.col("ts").cast("double").alias("timestamp"), stages.alias("stages"))


@query("SELECT event_type AS mode, count(*) AS n, round(max(value + 1.5), 6) AS slowest, round(sum(value + 1.5), 3) AS total FROM events GROUP BY event_type")
def trace_latency(spark: SparkSession, sf: str) -> DataFrame:
    took = stores.latency(F.col("stages"))
    return _traces(spark, sf).groupBy("mode").agg(F.count("*").alias("n"), F.round(F.max(took), 6).alias("slowest"), F.round(F.sum(took), 3).alias("total"))


@query(f"""WITH old AS (SELECT * FROM events WHERE event_id % 2 = 0), fresh AS (SELECT event_id, ts, user_id FROM events WHERE event_id % 3 = 0), t AS (SELECT event_id, ts, user_id FROM old WHERE event_id % 3 <> 0 UNION ALL SELECT * FROM fresh)
SELECT CAST(event_id AS VARCHAR) AS trace_id FROM t WHERE epoch(ts) >= {NOW} - 30 * 86400""")
def trace_save(spark: SparkSession, sf: str) -> DataFrame:
    """The trace table after new traces, some of which replace old ones."""
    rows = _traces(spark, sf)
    number = F.col("trace_id").cast("long")
    return stores.save_traces(rows.where(number % 2 == 0), rows.where(number % 3 == 0), F.lit(NOW)).select("trace_id")


@query("""WITH t AS (SELECT 'f' || (event_id % 17) AS a, 'f' || (event_id * 2 % 17) AS b, 'f' || (event_id * 3 % 17) AS c, value FROM events WHERE event_id = 40)
SELECT CAST(0 AS INTEGER) AS place, 'symbols' AS stage, value AS elapsed_ms, CAST(3 AS INTEGER) AS candidates, CAST(len(list_filter(list_distinct([a, b, c]), lambda x: x <> a)) AS INTEGER) AS dropped FROM t UNION ALL SELECT 1, 'cut', 1.5, 1, 0 FROM t""")
def trace_explain(spark: SparkSession, sf: str) -> DataFrame:
    return stores.explain(_traces(spark, sf), "40")


@query("SELECT CAST(event_id AS VARCHAR) AS trace_id FROM events WHERE user_id = 7 AND epoch(ts) >= 1705276800")
def trace_range(spark: SparkSession, sf: str) -> DataFrame:
    return stores.traces_since(_traces(spark, sf), "7", F.lit(1705276800.0)).select("trace_id")


@query("""WITH s AS (SELECT DISTINCT sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 3 = 0) SELECT doc_id FROM documents WHERE sha256(coalesce(text, '')) NOT IN (SELECT h FROM s)""")
def summary_misses(spark: SparkSession, sf: str) -> DataFrame:
    files = load(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_hash"))
    known = files.where("doc_id % 3 = 0").select("content_hash", F.lit("m").alias("model"), F.lit("v1").alias("prompt_version"))
    return stores.missing_summaries(files, known, "m", "v1").select("doc_id")


@query("""WITH d AS (SELECT DISTINCT sha256(coalesce(text, '')) AS h, len(coalesce(text, '')) AS n FROM documents), k AS (SELECT DISTINCT h, n FROM d WHERE h IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 3 = 0))
SELECT (SELECT count(*) FROM documents) - (SELECT count(*) FROM d WHERE h NOT IN (SELECT h FROM k)) AS cached, (SELECT count(*) FROM d WHERE h NOT IN (SELECT h FROM k)) AS new, CAST((SELECT coalesce(sum(n + 5), 0) FROM d WHERE h NOT IN (SELECT h FROM k)) AS BIGINT) AS tokens, round((SELECT coalesce(sum((n + 2 * 5) / 1e6), 0) FROM d WHERE h NOT IN (SELECT h FROM k)), 8) AS cost""")
def summary_totals(spark: SparkSession, sf: str) -> DataFrame:
    files = load(spark, sf, "documents").select(F.coalesce("text", F.lit("")).alias("text"), "doc_id").withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256))
    known = files.where("doc_id % 3 = 0").select("content_hash", F.lit("m").alias("model"), F.lit("v1").alias("prompt_version"), F.lit("").alias("prompt_hash"), F.lit("").alias("summary"), F.lit(0).cast("long").alias("tokens_in"), F.lit(0).cast("long").alias("tokens_out"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("created_at"))
    return stores.summarize(files, known, lambda t: (t[:10], len(t), 5), "m", "v1", (F.col("tokens_in") + 2 * F.col("tokens_out")) / 1e6, NOW)[1]


@query("""WITH v AS (SELECT vec_id, CAST(label AS VARCHAR) AS project, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT 'v' || vec_id AS path, round(list_cosine_similarity(e, (SELECT e FROM v WHERE vec_id = 1)), 6) AS score FROM v WHERE project = '3' ORDER BY score DESC, path LIMIT 15""")
def vector_search_project(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "embeddings").select(F.col("label").cast("string").alias("project"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("path"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return stores.search_vectors(rows, "3", rows.where("path = 'v1'").first()["embedding"], 15)


@query("""SELECT 'v' || vec_id AS path, CASE WHEN vec_id % 5 = 0 THEN 'new' ELSE 'old' END AS version FROM embeddings WHERE label <> 3""")
def vector_upsert_delete(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "embeddings").select(F.col("label").cast("string").alias("project"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("path"), "embedding", "vec_id")
    width = len(rows.first()["embedding"])
    new = rows.where("vec_id % 5 = 0").drop("vec_id").withColumn("version", F.lit("new"))
    table_ = stores.upsert_vectors(rows.drop("vec_id").withColumn("version", F.lit("old")), new, width)
    return stores.delete_project(table_, "3").select("path", "version")


@query(f"""WITH c AS (SELECT 'r' || o_custkey AS root, count(*) AS files, max(epoch(o_orderdate)) AS last_scan FROM orders GROUP BY o_custkey), t AS (SELECT 'r' || user_id AS root, count(*) AS packs, count(*) FILTER (WHERE epoch(ts) >= {NOW} - 7 * 86400.0) AS packs_7d FROM events GROUP BY user_id)
SELECT 'r' || c_custkey AS root, coalesce(files, 0) AS files, coalesce(packs, 0) AS packs, coalesce(packs_7d, 0) AS packs_7d, c_custkey % 4 <> 0 AS "exists", coalesce(packs, 0) = 0 AND (last_scan IS NULL OR {NOW} - last_scan >= 30 * 86400) AS stale FROM customer LEFT JOIN c ON c.root = 'r' || c_custkey LEFT JOIN t ON t.root = 'r' || c_custkey""")
def registry_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as projects, orders as what is cached of them, events as their packs."""
    return _audited(spark, sf).select("root", "files", "packs", "packs_7d", "exists", "stale")


def _audited(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("r"), F.col(c).cast("string"))
    customers = load(spark, sf, "customer")
    caches = load(spark, sf, "orders").groupBy(name("o_custkey").alias("root")).agg(F.count("*").alias("files"), F.count("*").alias("symbols"), F.max(F.col("o_orderdate").cast("double")).alias("last_scan"))
    traces = load(spark, sf, "events").select(name("user_id").alias("project"), F.col("ts").cast("double").alias("timestamp"))
    return stores.audit(customers.select(name("c_custkey").alias("root")), caches, traces, customers.where("c_custkey % 4 <> 0").select(name("c_custkey").alias("root")), F.lit(NOW), 30)


@query(f"""WITH c AS (SELECT 'r' || o_custkey AS root, max(epoch(o_orderdate)) AS last_scan FROM orders GROUP BY o_custkey), t AS (SELECT DISTINCT 'r' || user_id AS root FROM events),
a AS (SELECT 'r' || c_custkey AS root, CASE WHEN c_custkey % 4 = 0 THEN 'missing' WHEN t.root IS NULL AND (last_scan IS NULL OR {NOW} - last_scan >= 30 * 86400) THEN 'stale' END AS reason FROM customer LEFT JOIN c ON c.root = 'r' || c_custkey LEFT JOIN t ON t.root = 'r' || c_custkey)
SELECT root, reason FROM a WHERE reason IS NOT NULL""")
def registry_prune_plan(spark: SparkSession, sf: str) -> DataFrame:
    return stores.prune_plan(_audited(spark, sf), stale=True)


_MODULE = "'m' || (p_partkey % 6) || '/' || 'n' || (p_partkey % 4)"


@query(f"""WITH f AS (SELECT p_partkey, {_MODULE} AS module FROM part), s AS (SELECT DISTINCT {_MODULE} AS module, p_name AS fq, count(*) OVER (PARTITION BY {_MODULE}, p_name) AS n FROM part),
r AS (SELECT module, fq, n, row_number() OVER (PARTITION BY module ORDER BY fq) AS r FROM s), d AS (SELECT DISTINCT a.module AS src, b.module AS dst FROM part p JOIN f a USING (p_partkey) JOIN f b ON b.p_partkey = p.p_partkey // 2 WHERE a.module <> b.module)
SELECT module, count(*) AS files, (SELECT CAST(sum(n) AS BIGINT) FROM r WHERE r.module = f.module) AS symbols, (SELECT string_agg(fq, ',' ORDER BY fq) FROM r WHERE r.module = f.module AND r <= 10) AS first_symbols,
 coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM d WHERE src = f.module), '') AS dependencies, coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM d WHERE dst = f.module), '') AS dependents FROM f GROUP BY module""")
def module_rollup(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    path = lambda k: F.concat(F.lit("m"), (k % 6).cast("string"), F.lit("/n"), (k % 4).cast("string"), F.lit("/f"), k.cast("string"))
    parts = load(spark, sf, "part")
    known = parts.select((key * 1).alias("half"))
    edges = parts.withColumn("half", F.floor(key / 2)).join(known, "half").select(path(key).alias("src"), path(F.col("half")).alias("dst"))
    return modules.rollup(parts.select(path(key).alias("path")), parts.select(F.col("p_name").alias("fq_name"), path(key).alias("file_path")), edges)


@query(r"""WITH a AS (SELECT coalesce(source, 'none') AS project, 'd' || doc_id AS name, CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE trim(regexp_extract(trim(split_part(regexp_replace(coalesce(text, ''), '[\n#]', ' ', 'g') || ' end', '~~', 1)), '^(.*?[.!?](?:\s|$)|.*)', 1)) END AS p, doc_id FROM documents)
SELECT project, '- [' || name || '](' || name || '.md)' || CASE WHEN doc_id % 3 <> 0 AND len(p) > 0 THEN ': ' || p ELSE '' END AS line FROM a""")
def article_index(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of an index of articles by project: their purpose's first sentence."""
    first = F.trim(F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), "[\n#]", " "), F.lit(" end")))
    body = F.when(F.col("doc_id") % 3 == 0, F.lit("# T\n\nno such heading")).otherwise(F.concat(F.lit("# T\n\n## Purpose\n\n"), first, F.lit("\n\n## Rest\n\nmore")))
    articles = load(spark, sf, "documents").select(F.coalesce("source", F.lit("none")).alias("project"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), body.alias("text"))
    return modules.article_index(articles, "project").select("project", "line")


@query("""WITH a AS (SELECT o_custkey AS k, count(*) % 3 AS h FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) % 3 AS h FROM orders GROUP BY 1)
SELECT 'c' || coalesce(a.k, b.k) AS name, CASE WHEN b.k IS NULL THEN 'gone' WHEN a.h = b.h THEN 'current' ELSE 'dirty' END AS status FROM a FULL JOIN b ON a.k = b.k""")
def article_states(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders")
    hashed = lambda df: df.groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name")).agg((F.count("*") % 3).cast("string").alias("hash"))
    state = hashed(orders.where("o_orderkey % 2 = 0")).withColumn("status", F.lit("current"))
    return modules.article_states(state, hashed(orders)).select("name", "status")


_MARKDOWN = "'# Doc ' || doc_id || chr(10) || coalesce(text, '') || chr(10) || '## See lib/m' || (doc_id % 9) || '.py and apps.core.m' || (doc_id % 5) || chr(10) || '#no heading' || chr(10)"


def _markdown(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("doc_id").cast("string")
    body = F.concat(F.lit("# Doc "), number, F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n## See lib/m"), (F.col("doc_id") % 9).cast("string"), F.lit(".py and apps.core.m"), (F.col("doc_id") % 5).cast("string"), F.lit("\n#no heading\n"))
    return load(spark, sf, "documents").select(F.concat(F.lit("docs/d"), number, F.lit(".md")).alias("path"), body.alias("text"), F.lit("markdown").alias("language"))


@query(rf"""WITH d AS (SELECT doc_id, unnest(string_split({_MARKDOWN}, chr(10))) AS line FROM documents), h AS (SELECT doc_id, len(regexp_extract(line, '^(#+)', 1)) AS level, trim(regexp_extract(line, '^#+ +(.*)$', 1)) AS title FROM d WHERE regexp_matches(line, '^#{{1,6}} +\S'))
SELECT 'docs/d' || doc_id || '.md' AS file_path, level, title, 'docs/d' || doc_id || '.md#h' || level || '-' || title AS fq_name FROM h""")
def markdown_headings(spark: SparkSession, sf: str) -> DataFrame:
    return code.markdown_headings(_markdown(spark, sf)).select("file_path", F.col("level").cast("long").alias("level"), "title", "fq_name")


@query(f"""WITH f AS (SELECT path FROM (VALUES ('lib/m1.py'), ('lib/m2.py'), ('lib/m8.py'), ('apps/core/m3.py'), ('apps/core/m4.py')) v(path)), t AS (SELECT 'docs/d' || doc_id || '.md' AS src_ref, {_MARKDOWN} AS t, doc_id FROM documents)
SELECT DISTINCT src_ref, path AS dst_ref FROM t JOIN f ON path = 'lib/m' || (doc_id % 9) || '.py' OR path = 'apps/core/m' || (doc_id % 5) || '.py'""")
def docs_links(spark: SparkSession, sf: str) -> DataFrame:
    files = spark.createDataFrame([("lib/m1.py",), ("lib/m2.py",), ("lib/m8.py",), ("apps/core/m3.py",), ("apps/core/m4.py",)], "path string")
    return code.docs_links(_markdown(spark, sf), files)


_EVAL = """WITH r AS (SELECT c_nationkey % 3 AS project, c_nationkey AS q, list('c' || c_custkey ORDER BY c_acctbal DESC, c_custkey) AS got, coalesce(list('c' || c_custkey) FILTER (WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000), []) AS want FROM customer GROUP BY c_nationkey),
m AS (SELECT project, q % 4 = 0 AS impact, CASE WHEN len(want) = 0 THEN 1.0 ELSE len(list_intersect(got[1:5], want)) / len(want) END AS recall, len(list_filter(got[1:3], lambda i: list_contains(want, i))) / least(3, len(got)) AS prec,
 coalesce(1.0 / list_min(list_filter(list_transform(got, lambda i, k: CASE WHEN list_contains(want, i) THEN k END), lambda k: k IS NOT NULL)), 0) AS rr FROM r)"""


def _results(spark: SparkSession, sf: str) -> DataFrame:
    customers = load(spark, sf, "customer").withColumn("id", F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    # What is retrieved is a ranking of a nation's customers; the feature's arrays are such rankings.
    ranked = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("c_acctbal")).alias("b"), "c_custkey", "id"))), lambda x: x["id"])
    wanted = F.collect_list(F.when((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 5000), F.col("id")))
    rows = customers.groupBy("c_nationkey").agg(ranked.alias("retrieved_files"), wanted.alias("expected_files"))
    none = F.array().cast("array<string>")
    return rows.select((F.col("c_nationkey") % 3).cast("string").alias("project"), F.col("c_nationkey").cast("string").alias("query_id"), F.lit("navigate").alias("mode"), (F.col("c_nationkey") % 4 == 0).alias("impact"), "retrieved_files", none.alias("retrieved_symbols"), "expected_files", none.alias("expected_symbols"))


@query(_EVAL + """SELECT CAST(project AS VARCHAR) AS project, count(*) AS queries, round(avg(recall), 6) AS recall_at_5_files, round(avg(prec), 6) AS precision_at_3_files, 1.0::DOUBLE AS recall_at_5_symbols, round(avg(rr), 6) AS mrr_files, round(coalesce(avg(recall) FILTER (WHERE impact), 0), 6) AS impact_recall_at_5 FROM m GROUP BY ROLLUP (project)""")
def eval_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean metrics by project and over all."""
    return evaluation.means(_results(spark, sf), "project")


@query("""WITH l AS (SELECT l_suppkey % 3 AS repo, l_orderkey * 10 + l_linenumber AS n, CASE WHEN l_linenumber = 1 THEN 'h' || l_orderkey ELSE NULL END AS head, l_partkey FROM lineitem)
SELECT CAST(repo AS VARCHAR) AS repo, n, last_value(head IGNORE NULLS) OVER (PARTITION BY repo ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM l""")
def sticky_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Each line with the header above it, as a log of commits is read."""
    rows = load(spark, sf, "lineitem").select((F.col("l_suppkey") % 3).cast("string").alias("repo"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), F.when(F.col("l_linenumber") == 1, F.concat(F.lit("h"), F.col("l_orderkey").cast("string"))).alias("head"))
    return evaluation.sticky(rows, "n", F.col("head"), "repo").select("repo", "n", "header")


@query("""WITH c AS (SELECT o_orderkey AS sha, 'a' || (o_custkey % 9) AS author, epoch(o_orderdate) AS ts, o_orderkey FROM orders), f AS (SELECT l_orderkey AS sha, 'dir' || (l_partkey % 6) || '/f' || l_suppkey AS path FROM lineitem)
SELECT CAST(c.sha AS VARCHAR) AS sha, author, array_to_string(list_sort(list_distinct(list(path))), ',') AS files FROM c JOIN f USING (sha) WHERE ts >= 800000000 GROUP BY c.sha, author, ts HAVING bool_or(starts_with(path, 'dir2/')) ORDER BY ts DESC, c.sha LIMIT 25""")
def recent_history(spark: SparkSession, sf: str) -> DataFrame:
    """The newest commits after a time that touch a folder."""
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("a"), (F.col("o_custkey") % 9).cast("string")).alias("author"), F.col("o_orderdate").cast("double").alias("ts"))
    files = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat(F.lit("dir"), (F.col("l_partkey") % 6).cast("string"), F.lit("/f"), F.col("l_suppkey").cast("string")).alias("file_path"))
    history = orders.join(files, "k").select(F.lit("r").alias("repository"), F.col("k").cast("string").alias("sha"), "author", "ts", F.lit("").alias("subject"), "file_path", F.col("k").alias("seq"))
    return gitlog.recent(history, F.lit(800000000.0), "dir2", 25).select("sha", "author", F.array_join("files", ",").alias("files"))


@query(f"""SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (WHERE event_id % 3 <> 0) AS kind, arg_max(value, (ts, event_id)) FILTER (WHERE event_id % 2 = 0) AS value FROM events GROUP BY user_id""")
def latest_known_values(spark: SparkSession, sf: str) -> DataFrame:
    """Of each column the last value that is known, independently."""
    rows = load(spark, sf, "events").withColumns({"kind": F.when(F.col("event_id") % 3 != 0, F.col("event_type")), "value": F.when(F.col("event_id") % 2 == 0, F.col("value"))})
    return timeline.latest_known(rows, "user_id", "ts", "event_id", "kind", "value")


@query("""WITH o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS r, count(*) OVER () AS n FROM orders) SELECT max(v) FILTER (WHERE r = greatest(n // 2, 1)) AS mid, max(v) AS top FROM o""")
def lower_median(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.lower_median(load(spark, sf, "orders"), "o_totalprice")


@query("""WITH s AS (SELECT c_custkey, c_acctbal + 2000 AS score, 1.0::DOUBLE / (1 + c_custkey % 97) AS c FROM customer), r AS (SELECT c, row_number() OVER (ORDER BY c) AS r, count(*) OVER () AS n FROM s), m AS (SELECT max(c) FILTER (WHERE r = greatest(n // 2, 1)) AS mid, max(c) AS top FROM r)
SELECT c_custkey, round(score * CASE WHEN c > mid AND top > mid THEN 1 + 0.10 * (c - mid) / (top - mid) ELSE 1 END, 6) AS score FROM s CROSS JOIN m""")
def centrality_boost(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") + 2000).alias("score"), (1.0 / (1 + F.col("c_custkey") % 97)).alias("centrality"))
    return retrieval.centrality_boost(rows).select("c_custkey", F.round("score", 6).alias("score"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 4 > 0 THEN round(1 + (o_custkey % 4) / (1 + (o_orderkey % 90) / 30.0::DOUBLE), 6) ELSE 0.0 END AS weight FROM orders""")
def recency_weights(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select("o_orderkey", F.round(retrieval.recency_weight(F.col("o_custkey") % 4, F.col("o_orderkey") % 90), 6).alias("weight"))


@query("""WITH h AS (SELECT p_name AS fq, 'f' || (p_partkey % 50) AS file, p_size AS score FROM part WHERE p_partkey % 40 = 0), s AS (SELECT p_name || '.' || p_partkey AS fq, 'f' || (p_partkey % 50) AS file FROM part), t AS (SELECT 'f7' AS path UNION ALL SELECT 'f0'),
b AS (SELECT fq, 0 AS priority, CAST(score AS DOUBLE) AS score FROM h UNION ALL SELECT fq, 1, 0 FROM s WHERE file IN (SELECT path FROM t) AND file NOT IN (SELECT file FROM h))
SELECT fq AS fq_name, min(priority) AS priority, max(score) AS score FROM b GROUP BY fq ORDER BY priority, score DESC, fq LIMIT 30""")
def symbol_list(spark: SparkSession, sf: str) -> DataFrame:
    """Direct hits, then symbols of the best files that have none."""
    parts = load(spark, sf, "part").withColumn("file_path", F.concat(F.lit("f"), (F.col("p_partkey") % 50).cast("string")))
    hits = parts.where("p_partkey % 40 = 0").select(F.col("p_name").alias("fq_name"), "file_path", F.col("p_size").cast("double").alias("score"))
    symbols = parts.select(F.concat_ws(".", "p_name", F.col("p_partkey").cast("string")).alias("fq_name"), "file_path")
    return retrieval.symbol_list(hits, symbols, spark.createDataFrame([("f7",), ("f0",)], "path string"), 30)


_WORDS = ("кэш", "session", "запросов", "config", "widget", "база")


@query("WITH w AS (SELECT doc_id, (" + repr(list(_WORDS)) + ")[1 + doc_id % 6] || ' ' || (" + repr(list(_WORDS)) + ")[1 + (doc_id // 6) % 6] AS q FROM documents), d(a, b) AS (VALUES " + ", ".join(f"('{w}', '{(terms.RUSSIAN | terms.ENGLISH).get(w, '')}')" for w in _WORDS) + """),
x AS (SELECT doc_id, q, unnest(string_split(q, ' ')) AS t, generate_subscripts(string_split(q, ' '), 1) AS i FROM w), y AS (SELECT doc_id, t, i FROM x UNION ALL SELECT doc_id, b, i + 100 FROM x JOIN d ON a = t WHERE b <> ''), z AS (SELECT doc_id, t, min(i) AS i FROM y GROUP BY doc_id, t)
SELECT doc_id, string_agg(t, ',' ORDER BY i) AS terms FROM z GROUP BY doc_id""")
def translated_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Query words with their translations added, each once."""
    word = lambda k: F.element_at(text.strings(_WORDS), (1 + k % 6).cast("int"))
    tokens = F.array_distinct(F.array(word(F.col("doc_id")), word(F.floor(F.col("doc_id") / 6))))
    return load(spark, sf, "documents").select("doc_id", F.array_join(text.translate_terms(tokens), ",").alias("terms"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS u FROM pages), t AS (SELECT page_id, unnest(list_concat(regexp_extract_all(lower(u), '[a-zа-яё0-9_.-]+'), list_transform(regexp_extract_all(regexp_replace(u, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[a-zA-Zа-яА-ЯёЁ0-9]+'), lambda x: lower(x)))) AS t,
 generate_subscripts(list_concat(regexp_extract_all(lower(u), '[a-zа-яё0-9_.-]+'), regexp_extract_all(regexp_replace(u, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[a-zA-Zа-яА-ЯёЁ0-9]+')), 1) AS i FROM p), f AS (SELECT page_id, t, min(i) AS i FROM t GROUP BY page_id, t)
SELECT page_id, string_agg(t, ' ' ORDER BY i) AS terms FROM f GROUP BY page_id""")
def expanded_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Raw terms and identifier tokens, each once, in order."""
    return load(spark, sf, "pages").select("page_id", F.array_join(text.expand_terms(F.regexp_replace("url", "^https?://", "")), " ").alias("terms"))


_PATHS = "CASE doc_id % 8 WHEN 0 THEN 'lib/core/x' || doc_id || '.py' WHEN 1 THEN 'tests/test_x' || doc_id || '.py' WHEN 2 THEN 'app/config/y.py' WHEN 3 THEN 'conf' || doc_id || '.yaml' WHEN 4 THEN 'node_modules/z.js' WHEN 5 THEN 'docs/d' || doc_id || '.md' WHEN 6 THEN './rel' WHEN 7 THEN 'pkg/tool' END"


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    made = [F.concat(F.lit("lib/core/x"), n, F.lit(".py")), F.concat(F.lit("tests/test_x"), n, F.lit(".py")), F.lit("app/config/y.py"), F.concat(F.lit("conf"), n, F.lit(".yaml")), F.lit("node_modules/z.js"), F.concat(F.lit("docs/d"), n, F.lit(".md")), F.lit("./rel"), F.lit("pkg/tool")]
    return load(spark, sf, "documents").select("doc_id", F.element_at(F.array(*made), (F.col("doc_id") % 8 + 1).cast("int")).alias("path"))


@query(f"""WITH p AS (SELECT doc_id, {_PATHS} AS path FROM documents) SELECT doc_id, path, contains(path, 'node_modules/') AS ignored, doc_id % 8 = 1 AS test, CASE doc_id % 8 WHEN 0 THEN 'python' WHEN 1 THEN 'python' WHEN 2 THEN 'python' WHEN 3 THEN 'yaml' WHEN 4 THEN 'javascript' WHEN 5 THEN 'markdown' END AS language,
 CASE doc_id % 8 WHEN 1 THEN 'test' WHEN 5 THEN 'docs' WHEN 3 THEN 'config' ELSE 'source' END AS role, doc_id % 8 <> 6 AS file, CASE WHEN doc_id % 8 = 1 THEN 'tests' WHEN doc_id % 8 IN (2, 3) THEN 'configs' ELSE 'targets' END AS section,
 starts_with(path, 'lib/core/') OR path = 'lib/core' AS in_scope FROM p""")
def path_facts(spark: SparkSession, sf: str) -> DataFrame:
    """What a path says: ignored, a test, language, role, a file at all, its part of an edit pack, whether it lies in a module."""
    p = F.col("path")
    return _paths(spark, sf).select("doc_id", "path", paths.is_ignored(p).alias("ignored"), paths.is_test_path(p).alias("test"), paths.language(p).alias("language"), paths.role(p, F.coalesce(paths.language(p), F.lit(""))).alias("role"), paths.looks_like_file(p).alias("file"), packs.section(p).alias("section"), timeline.in_scope(p, "lib/core").alias("in_scope"))


@query(f"""WITH r AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/home/u/proj_' || page_id || '.x' WHEN 1 THEN '/tmp/p' || page_id WHEN 2 THEN '/home/u/.worktrees/a' ELSE md5('x' || page_id) END AS root FROM pages)
SELECT page_id, page_id % 4 IN (1, 2) AS transient, replace(replace(replace(root, '.', '-'), '_', '-'), '/', '-') AS encoded, replace(replace(replace(replace(root, '.', '-'), '_', '-'), '/', '-'), '-', '/') AS decoded, page_id % 4 = 3 AS is_id FROM r""")
def project_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Scratch checkouts, encoded project names and their lossy way back, and what looks like a symbol's id."""
    n = F.col("page_id").cast("string")
    root = F.element_at(F.array(F.concat(F.lit("/home/u/proj_"), n, F.lit(".x")), F.concat(F.lit("/tmp/p"), n), F.lit("/home/u/.worktrees/a"), F.md5(F.concat(F.lit("x"), n).cast("binary"))), (F.col("page_id") % 4 + 1).cast("int"))
    rows = load(spark, sf, "pages").select("page_id", root.alias("root"))
    encoded = paths.encode_project(F.col("root"))
    return rows.select("page_id", paths.is_transient(F.col("root")).alias("transient"), encoded.alias("encoded"), paths.decode_project(encoded).alias("decoded"), timeline.is_symbol_id(F.col("root")).alias("is_id"))


@query("""WITH s AS (SELECT 't' || (c_custkey % 30) AS tag, CAST(c_custkey % 4 AS VARCHAR) AS head_sha, c_custkey AS k FROM customer) SELECT k, tag = 't7' AND head_sha <> '2' AS tag_invalidated FROM s""")
def invalidated_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots of a tag that has moved."""
    rows = load(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("t"), (F.col("c_custkey") % 30).cast("string")).alias("tag"), (F.col("c_custkey") % 4).cast("string").alias("head_sha"), F.lit(None).cast("boolean").alias("tag_invalidated"))
    return timeline.invalidate_tag(rows, "t7", "2").select("k", "tag_invalidated")


@query("""WITH e AS (SELECT user_id % 10 AS p, event_id, ts FROM events) SELECT CAST(p AS VARCHAR) AS project_root, CAST(arg_max(event_id, ts) AS VARCHAR) AS commit_sha FROM e GROUP BY p""")
def scan_state(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select((F.col("user_id") % 10).cast("string").alias("project_root"), F.col("event_id").cast("string").alias("commit_sha"), F.col("ts").cast("double").alias("timestamp"))
    return sinks.scan_states(rows.where("cast(commit_sha as long) % 2 = 0"), rows.where("cast(commit_sha as long) % 2 = 1")).select("project_root", "commit_sha")


@query("""WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents) SELECT doc_id, round(('0x' || substr(h, 1, 4))::BIGINT / 32767.5 - 1, 9) AS first, round(('0x' || substr(h, 29, 4))::BIGINT / 32767.5 - 1, 9) AS last FROM h""")
def hash_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """The stand-in for an embedding model: first and last of eight numbers."""
    v = analytics.hash_embedding(F.coalesce("text", F.lit("")), 8)
    return load(spark, sf, "documents").select("doc_id", F.round(v[0], 9).alias("first"), F.round(v[7], 9).alias("last"))


_STORED = {
    1: Schema("dependency string", lambda rows: rows.withColumn("kind", F.lit("imports"))),
    2: Schema("dependency string, kind string"),
}


@query("""WITH c AS (SELECT DISTINCT p_brand, string_split(p_type, ' ')[-1] AS pattern FROM part) SELECT pattern, count(*) AS projects, round(count(*) / (SELECT count(DISTINCT p_brand) FROM part), 6) AS confidence FROM c GROUP BY pattern HAVING count(*) >= 2""")
def stored_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """What brands have in common, read across their stores: all were written in an old schema, half of them again in the new one."""
    root = f"{shared_folder(spark)}/stores-{uuid.uuid4().hex}"
    store = ProjectStore(spark, root, {"imports": _STORED})
    parts = load(spark, sf, "part").select(F.col("p_brand").alias("project"), F.element_at(F.split("p_type", " "), -1).alias("dependency"))
    store.write("imports", parts, 1)
    store.write("imports", parts.where(F.pmod(F.xxhash64("project"), F.lit(2)) == 0).withColumn("kind", F.lit("from")), 2)
    return analytics.shared_patterns(store.read("imports"), "project", F.col("dependency"), 2)


@query()
def vector_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of every hundredth vector by an inverted file; tests hold its recall against a scan."""
    vectors = load(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").cast("string").alias("project"), "embedding")
    index = VectorIndex.build(vectors, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}")
    return index.search(vectors.where("key % 100 = 0").select(F.col("key").alias("query_id"), "embedding"))
