"""Metrics, registry, pattern and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, code_graph, graph
from ..session import load
from ..sources import code, sinks
from .bindings import table

QUERIES, ORACLES, query = table()


def _now(events: DataFrame) -> float:
    """The latest time in the table stands for the present."""
    return events.agg(F.max(F.col("ts").cast("double"))).first()[0] or 0.0


_COVERAGE = "CASE event_type WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium' ELSE 'ambiguous' END"


def _coverage():
    kind = F.col("event_type")
    return F.when(kind == "purchase", "high").when(kind == "click", "medium").otherwise("ambiguous")


@query(f"""WITH m AS (SELECT max(epoch(ts)) AS now FROM events), b AS (SELECT CAST(greatest(0, least(6, floor((epoch(ts) - (now - 7 * 86400.0)) / 86400.0))) AS INTEGER) AS bucket, value, CASE {_COVERAGE} WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.5 ELSE 0.25 END AS cover FROM events, m WHERE epoch(ts) >= now - 7 * 86400.0)
SELECT CAST(d.bucket AS INTEGER) AS bucket, count(b.bucket) AS n, coalesce(round(max(value), 6), 0) AS top, coalesce(round(avg(cover), 6), 0) AS coverage FROM (SELECT unnest(range(7)) AS bucket) d LEFT JOIN b ON b.bucket = d.bucket GROUP BY d.bucket""")
def sparkline_7d(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events")
    coverage = F.round(F.avg(analytics.coverage_score(_coverage())), 6).alias("coverage")
    return analytics.sparkline(events, F.col("ts").cast("double"), F.lit(_now(events)), 7, F.count("*").alias("n"), F.round(F.max("value"), 6).alias("top"), coverage)


@query("""WITH m AS (SELECT max(epoch(ts)) AS now FROM events) SELECT event_type, round(sum(CASE WHEN epoch(ts) >= now - 7 * 86400.0 THEN value ELSE 0 END), 2) AS sum_7d, round(sum(CASE WHEN epoch(ts) >= now - 30 * 86400.0 THEN value ELSE 0 END), 2) AS sum_30d FROM events, m GROUP BY ROLLUP (event_type)""")
def rolling_usage(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events")
    out = analytics.rolling_sums(events, "event_type", F.col("ts").cast("double"), F.col("value"), F.lit(_now(events)))
    return out.select("event_type", F.round("sum_7d", 2).alias("sum_7d"), F.round("sum_30d", 2).alias("sum_30d"))


@query(f"""WITH m AS (SELECT max(epoch(ts)) AS now FROM events), e AS (SELECT *, {_COVERAGE} AS cover FROM events) SELECT count(*) AS packs, count(*) FILTER (WHERE epoch(ts) >= now - 7 * 86400.0) AS packs_7d, count(DISTINCT user_id) AS active, count(*) FILTER (WHERE cover = 'high') AS high,
count(*) FILTER (WHERE cover = 'medium') AS medium, count(*) FILTER (WHERE cover = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE event_id % 4 = 0) AS edit, round((max(event_id) / count(DISTINCT user_id)) / greatest(1, sum(event_id % 9) / count(*)), 6) AS compression FROM e, m""")
def value_metrics(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events")
    packs = events.select(F.col("user_id").alias("project"), F.col("ts").cast("double").alias("timestamp"), F.when(F.col("event_id") % 4 == 0, "edit").otherwise("navigate").alias("mode"), _coverage().alias("coverage"), "event_id")
    return analytics.value_metrics(packs, F.max("event_id"), F.sum(F.col("event_id") % 9), F.lit(_now(events)))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang")
def language_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")


@query("""SELECT source, count(*) AS parseable, round(100.0::DOUBLE * count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) / count(*), 6) AS pct FROM documents WHERE n_chars >= 20 AND lang IN ('en', 'fr', 'de') GROUP BY source""")
def scan_coverage_pct(spark: SparkSession, sf: str) -> DataFrame:
    files = load(spark, sf, "documents").where((F.col("n_chars") >= 20) & F.col("lang").isin("en", "fr", "de")).select("doc_id", "source")
    known = load(spark, sf, "labels").select("doc_id").distinct().withColumn("known", F.lit(1))
    sums = files.join(known, "doc_id", "left").groupBy("source").agg(F.count("*").alias("parseable"), F.count("known").alias("found"))
    return sums.select("source", "parseable", F.round(100.0 * F.col("found") / F.col("parseable"), 6).alias("pct"))


@query("""SELECT s_nationkey AS pattern, count(DISTINCT p_brand) AS projects, round(count(DISTINCT p_brand) / (SELECT count(DISTINCT p_brand) FROM lineitem JOIN part ON p_partkey = l_partkey), 6) AS confidence
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_nationkey HAVING count(DISTINCT p_brand) >= 2""")
def dependency_patterns(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    parts = load(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    suppliers = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return analytics.shared_patterns(lines.join(parts, "l_partkey").join(suppliers, "l_suppkey"), "p_brand", F.col("s_nationkey"), 2)


@query("""WITH c AS (SELECT DISTINCT p_brand, string_split(p_type, ' ')[-1] AS pattern FROM part) SELECT pattern, count(*) AS projects, round(count(*) / (SELECT count(DISTINCT p_brand) FROM part), 6) AS confidence FROM c GROUP BY pattern HAVING count(*) >= 2""")
def structural_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.shared_patterns(load(spark, sf, "part"), "p_brand", F.element_at(F.split("p_type", " "), -1), 2)


@query("""WITH o AS (SELECT o_custkey, max(epoch(o_orderdate)) AS last_scan, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS packs FROM orders GROUP BY o_custkey), m AS (SELECT max(epoch(o_orderdate)) AS now FROM orders)
SELECT c_custkey, coalesce(packs, 0) = 0 AND (last_scan IS NULL OR now - last_scan >= 90 * 86400.0) AS stale FROM customer LEFT JOIN o ON o_custkey = c_custkey CROSS JOIN m""")
def registry_staleness(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").withColumn("t", F.col("o_orderdate").cast("double"))
    seen = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("t").alias("last_scan"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("packs"))
    now = F.broadcast(orders.agg(F.max("t").alias("now")))
    return load(spark, sf, "customer").select("c_custkey").join(seen, "c_custkey", "left").crossJoin(now).select("c_custkey", analytics.is_stale(F.col("packs"), F.col("last_scan"), F.col("now"), 90).alias("stale"))


@query("""SELECT n_name, count(DISTINCT c_custkey) AS files, count(o_orderkey) AS symbols, (SELECT max(o_orderdate) FROM orders) - max(o_orderdate) > INTERVAL '24 hours' AS stale FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name""")
def health_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Orders are summed by customer before the join, so a nation's rows stay few."""
    orders = load(spark, sf, "orders")
    per = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"))
    now = F.broadcast(orders.agg(F.max("o_orderdate").alias("now")))
    nations = F.broadcast(load(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))  # 25 rows
    rows = load(spark, sf, "customer").select("c_custkey", "c_nationkey").join(nations, "c_nationkey").join(per, "c_custkey", "left").crossJoin(now)
    age = F.first("now").cast("double") - F.max("last").cast("double")
    return rows.groupBy("n_name").agg(F.countDistinct("c_custkey").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"), (age > 86400).alias("stale"))


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS spent, CASE WHEN ends_with(month, '-02') THEN 'disabled' WHEN sum(o_totalprice) >= 3e7 THEN 'exceeded' WHEN sum(o_totalprice) >= 2.4e7 THEN 'warning' ELSE 'ok' END AS status FROM orders GROUP BY month""")
def budget_status(spark: SparkSession, sf: str) -> DataFrame:
    by_month = load(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum("o_totalprice").alias("sum"))
    return by_month.select("month", F.round("sum", 2).alias("spent"), analytics.budget_status(F.col("sum"), F.when(~F.col("month").endswith("-02"), 3e7)).alias("status"))


@query("""SELECT o_orderpriority, round(sum(round(((1000 * o_orderkey % 5000 - 100) * 0.5 + 100 * 0.05 + 300 * 2.0) / 1e6, 8)), 6) AS cost FROM orders GROUP BY o_orderpriority""")
def model_cost(spark: SparkSession, sf: str) -> DataFrame:
    cost = analytics.model_cost(1000 * F.col("o_orderkey") % 5000, F.lit(100), F.lit(300), F.lit(0.5), F.lit(0.05), F.lit(2.0))
    return load(spark, sf, "orders").groupBy("o_orderpriority").agg(F.round(F.sum(cost), 6).alias("cost"))


@query("""SELECT le, count(*) FILTER (WHERE l_quantity <= le) AS n FROM lineitem, (VALUES (5.0::DOUBLE), (10.0), (25.0), (50.0)) b(le) GROUP BY le""")
def histogram_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.histogram(load(spark, sf, "lineitem"), "l_quantity", [5, 10, 25, 50])


@query("""WITH r AS (SELECT c_nationkey AS q, list(c_custkey ORDER BY c_acctbal DESC, c_custkey) AS retrieved, list(c_custkey) FILTER (WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000) AS expected FROM customer GROUP BY c_nationkey),
x AS (SELECT q, retrieved, coalesce(expected, []) AS expected FROM r)
SELECT q, round(CASE WHEN len(expected) = 0 THEN 1.0 ELSE len(list_intersect(retrieved[1:5], expected)) / len(expected) END, 6) AS recall, round(len(list_filter(retrieved[1:3], lambda i: list_contains(expected, i))) / least(3, len(retrieved)), 6) AS precision,
round(coalesce(1.0 / list_min(list_filter(list_transform(retrieved, lambda i, k: CASE WHEN list_contains(expected, i) THEN k END), lambda k: k IS NOT NULL)), 0), 6) AS rr FROM x""")
def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as queries: customers by balance are retrieved, rich ones of one segment expected."""
    customers = load(spark, sf, "customer")
    ranked = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("c_acctbal")).alias("b"), "c_custkey"))), lambda x: x["c_custkey"])
    wanted = F.collect_list(F.when((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 5000), F.col("c_custkey")))
    rows = customers.groupBy(F.col("c_nationkey").alias("q")).agg(ranked.alias("retrieved"), wanted.alias("expected"))
    return analytics.eval_metrics(rows).select("q", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "rr")))


@query("""SELECT c_mktsegment, avg(c_acctbal) > 4500 AS above, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment)""")
def workspace_totals(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").rollup("c_mktsegment").agg((F.avg("c_acctbal") > 4500).alias("above"), F.count("*").alias("n"))


@query("""SELECT l_suppkey, count(*) AS commit_count, count(*) FILTER (WHERE epoch(l_shipdate) >= (SELECT max(epoch(l_shipdate)) FROM lineitem) - 30 * 86400) AS churn_30d, CAST(floor(((SELECT max(epoch(l_shipdate)) FROM lineitem) - min(epoch(l_shipdate))) / 86400) AS BIGINT) AS age_days, len(list_distinct(list(l_returnflag))) AS authors FROM lineitem GROUP BY l_suppkey""")
def git_boost_stats(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file_path"), F.col("l_returnflag").alias("author"), F.col("l_shipdate").cast("double").alias("ts"), (-F.col("l_orderkey") * 10 - F.col("l_linenumber")).alias("seq"))
    now = lines.agg(F.max("ts")).first()[0]
    stats = code.file_git_stats(lines, F.lit(now))
    return stats.select(F.col("file_path").alias("l_suppkey"), "commit_count", "churn_30d", "age_days", F.size("authors").cast("long").alias("authors"))


@query("""WITH a AS (SELECT 'd' || doc_id AS name, CASE WHEN quality = 1 THEN 'new' ELSE 'old' END AS hash, 100 * toxic AS size FROM labels), m AS (SELECT 'd' || doc_id AS name, 'new' AS hash FROM documents WHERE doc_id % 2 = 0), i AS (SELECT 'd' || doc_id AS name FROM documents WHERE doc_id % 3 = 0)
SELECT issue, count(*) AS n FROM (SELECT 'orphan' AS issue FROM a WHERE name NOT IN (SELECT name FROM m) UNION ALL SELECT 'missing' FROM m WHERE name NOT IN (SELECT name FROM a) UNION ALL SELECT 'stale' FROM a JOIN m USING (name) WHERE a.hash <> m.hash
 UNION ALL SELECT 'empty' FROM a WHERE size < 50 UNION ALL SELECT 'unindexed' FROM a WHERE name NOT IN (SELECT name FROM i) UNION ALL SELECT 'dangling' FROM i WHERE name NOT IN (SELECT name FROM a)) GROUP BY issue""")
def wiki_lint(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as articles, even documents as modules, every third one in the index."""
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name")
    articles = load(spark, sf, "labels").select(name, F.when(F.col("quality") == 1, "new").otherwise("old").alias("hash"), (100 * F.col("toxic")).alias("size"))
    docs = load(spark, sf, "documents")
    issues = code_graph.lint(articles, docs.where("doc_id % 2 = 0").select(name, F.lit("new").alias("hash")), docs.where("doc_id % 3 = 0").select(name))
    return issues.groupBy("issue").agg(F.count("*").alias("n"))


@query("""SELECT src, dst, count(*) AS n FROM (SELECT DISTINCT 'm' || (l_partkey % 40) AS src, 'm' || (l_suppkey % 40) AS dst, l_partkey, l_suppkey FROM lineitem) WHERE src <> dst GROUP BY src, dst""")
def module_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """Parts and suppliers as files of forty modules."""
    path = lambda c: F.concat(F.lit("m"), (F.col(c) % 40).cast("string"), F.lit("/f"), F.col(c).cast("string")).alias(c)
    lines = load(spark, sf, "lineitem")
    return code_graph.module_dependencies(graph.edges_of(lines.select(path("l_partkey"), path("l_suppkey")), "l_partkey", "l_suppkey"))


@query("""WITH RECURSIVE p AS (SELECT o_orderkey AS sha, o_orderkey // 2 AS parent FROM orders WHERE o_orderkey > 1 UNION ALL SELECT o_orderkey, o_orderkey // 3 FROM orders WHERE o_orderkey > 2 AND o_orderkey % 5 = 0),
a AS (SELECT CAST(1200 AS BIGINT) AS c UNION SELECT p.parent FROM a JOIN p ON p.sha = a.c), b AS (SELECT CAST(75 AS BIGINT) AS c UNION SELECT p.parent FROM b JOIN p ON p.sha = b.c)
SELECT CAST(c AS VARCHAR) AS commit_sha FROM a WHERE c NOT IN (SELECT c FROM b)""")
def commit_range(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as commits whose parents are half, and for every fifth also a third, of their key."""
    orders = load(spark, sf, "orders").select("o_orderkey")
    key = F.col("o_orderkey")
    parents = orders.where("o_orderkey > 1").select(key.cast("string").alias("sha"), F.floor(key / 2).cast("string").alias("parent")).union(orders.where("o_orderkey > 2 and o_orderkey % 5 = 0").select(key.cast("string"), F.floor(key / 3).cast("string")))
    return code_graph.commits_between(parents, "75", "1200")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)""")
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    customers = load(spark, sf, "customer").select("c_custkey", "c_name")
    return sinks.insert_new(customers.where("c_custkey % 3 = 0"), customers.where("c_custkey % 2 = 0"), "c_custkey")


@query("""SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NOT NULL THEN 'new' ELSE 'old' END AS version FROM (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) a FULL JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) b ON a.c_custkey = b.c_custkey""")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    customers = load(spark, sf, "customer").select("c_custkey")
    return code.upsert(customers.where("c_custkey % 3 = 0").withColumn("version", F.lit("old")), customers.where("c_custkey % 2 = 0").withColumn("version", F.lit("new")), "c_custkey")


_PATHS = """p AS (SELECT doc_id, coalesce(source, 'none') AS s, doc_id % 3 AS kind, CASE doc_id % 3 WHEN 0 THEN 'pkg/' || coalesce(source, 'none') || '/d' || doc_id || '.py' WHEN 1 THEN 'pkg/' || coalesce(source, 'none') || '/d' || doc_id || '/__init__.py' ELSE 'web/' || coalesce(source, 'none') || '/d' || doc_id || '.ts' END AS path FROM documents),
x AS (SELECT a.path AS src, a.kind AS own, b.* FROM p a JOIN p b ON b.doc_id = (a.doc_id * 7 + 3) % (SELECT max(doc_id) + 1 FROM documents) AND b.doc_id <> a.doc_id)"""


@query(f"""WITH {_PATHS}, r AS (SELECT src, 'pkg.' || s || '.d' || doc_id AS ref, CASE WHEN kind < 2 THEN path END AS dst FROM x UNION ALL SELECT src, 'pkg.' || s || '.d' || doc_id || '.run', CASE WHEN kind = 0 THEN path END FROM x
 UNION ALL SELECT src, '../' || s || '/d' || doc_id, CASE WHEN kind = 2 THEN path END FROM x WHERE own = 2 UNION ALL SELECT src, s || '/d' || doc_id || '.ts', CASE WHEN kind = 2 THEN path END FROM x)
SELECT src, ref, dst FROM r WHERE dst IS NOT NULL""")
def resolved_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as modules, packages and scripts; each names another one as a module, by something in it, by a relative path and by the end of its path."""
    source, number, kind = F.coalesce("source", F.lit("none")), F.col("doc_id").cast("string"), F.col("doc_id") % 3
    place = lambda root, end: F.concat(F.lit(f"{root}/"), source, F.lit("/d"), number, F.lit(end))
    files = load(spark, sf, "documents").select("doc_id", source.alias("s"), kind.alias("kind"), F.when(kind == 0, place("pkg", ".py")).when(kind == 1, place("pkg", "/__init__.py")).otherwise(place("web", ".ts")).alias("path"))
    size = files.agg(F.max("doc_id") + 1).first()[0]
    asked = files.select(F.col("path").alias("src"), F.col("kind").alias("own"), F.col("doc_id").alias("from"), ((F.col("doc_id") * 7 + 3) % F.lit(size)).alias("doc_id"))
    met = asked.join(files.select("doc_id", "s"), "doc_id").where(F.col("doc_id") != F.col("from"))
    name = F.concat("s", F.lit("/d"), F.col("doc_id").cast("string"))
    module = F.concat(F.lit("pkg."), F.translate(name, "/", "."))
    refs = F.array(module, F.concat(module, F.lit(".run")), F.when(F.col("own") == 2, F.concat(F.lit("../"), name)), F.concat(name, F.lit(".ts")))
    imports = met.select("src", F.explode(refs).alias("ref")).where("ref is not null")
    return code_graph.resolve_imports(imports, files.select("path"))
