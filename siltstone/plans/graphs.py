"""Graph queries over all of lineitem. Edges join parts to the suppliers that ship them.

As relations, the first line of an order defines its part in the file of its supplier, every other line imports it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, impact
from ..session import load
from .bindings import table

QUERIES, ORACLES, query = table()

_EDGES = "edges AS MATERIALIZED (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem)"
_PAIRS = """defined AS (SELECT l_partkey AS sym, max('s' || l_suppkey) AS dst FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), used AS (SELECT DISTINCT l_partkey AS sym, 's' || l_suppkey AS src FROM lineitem WHERE l_linenumber <> 1),
pairs AS MATERIALIZED (SELECT DISTINCT src, dst FROM used JOIN defined USING (sym) WHERE src <> dst)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem")
    return graph.edges_of(rows.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("p"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("s")), "p", "s")


def relations(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") == 1, "defines").otherwise("imports")
    return load(spark, sf, "lineitem").select(kind.alias("relation_type"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src_ref"), F.col("l_partkey").cast("string").alias("dst_ref"))


@query(f"WITH {_EDGES} SELECT src, dst FROM edges")
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf)


@query("""SELECT node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT 'p' || l_partkey AS node, 0 AS i, 1 AS o FROM lineitem UNION ALL SELECT 's' || l_suppkey, 1, 0 FROM lineitem) GROUP BY node""")
def fan_in_out(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem")
    return graph.degrees(rows.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst")))


@query("""WITH d AS (SELECT l_suppkey AS node, count(*) AS fan_in, count(DISTINCT l_partkey) AS fan_out, count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '1998-06-01') AS churn, bool_or(l_linestatus = 'F' AND l_suppkey % 2 = 0) AS tested FROM lineitem GROUP BY l_suppkey)
SELECT node, fan_in, fan_out, churn, CAST(fan_in * (1 + churn) * CASE WHEN tested THEN 1 ELSE 2 END AS DOUBLE) AS score FROM d ORDER BY score DESC, node LIMIT 10""")
def hotspots_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(
        F.count("*").alias("fan_in"), F.countDistinct("l_partkey").alias("fan_out"), F.count_if(F.col("l_shipdate") >= "1998-06-01").alias("churn"), F.bool_or((F.col("l_linestatus") == "F") & (F.col("l_suppkey") % 2 == 0)).alias("tested")
    )
    return graph.hotspots(rows).select("node", "fan_in", "fan_out", "churn", "score")


@query(f"WITH {_PAIRS} SELECT src, dst FROM pairs")
def impact_direct(spark: SparkSession, sf: str) -> DataFrame:
    """Importer and definer of each symbol, the last definer counts."""
    return graph.file_dependencies(relations(spark, sf))


@query(f"""WITH RECURSIVE {_PAIRS}, walk AS (SELECT 's9' AS node, 0 AS hop UNION SELECT p.src, w.hop + 1 FROM walk w JOIN pairs p ON p.dst = w.node WHERE w.hop < 4)
SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM walk WHERE node <> 's9' GROUP BY node""")
def impact_transitive(spark: SparkSession, sf: str) -> DataFrame:
    return graph.dependents(graph.file_dependencies(relations(spark, sf)), "s9", 4)


@query(f"""WITH RECURSIVE {_PAIRS}, roles AS (SELECT 's' || s_suppkey AS path, CASE WHEN s_suppkey % 4 = 0 THEN 'test' ELSE 'source' END AS role FROM supplier),
walk AS (SELECT 's9' AS node, 0 AS hop UNION SELECT p.src, w.hop + 1 FROM walk w JOIN pairs p ON p.dst = w.node WHERE w.hop < 4), near AS (SELECT node, min(hop) AS hop FROM walk WHERE node <> 's9' GROUP BY node)
SELECT CASE WHEN hop = 1 THEN 'direct' ELSE 'transitive' END AS kind, node, NULL::DOUBLE AS risk FROM near UNION ALL SELECT 'test', node, NULL FROM near JOIN roles ON path = node WHERE role = 'test' OR contains(node, '/test') OR starts_with(node, 'test')
UNION ALL SELECT 'risk', 's9', round((SELECT count(DISTINCT src) FROM pairs WHERE dst = 's9') * greatest(1, (SELECT count(DISTINCT dst) FROM pairs WHERE src = 's9')) * (1 + 7 / 10.0::DOUBLE), 6)""")
def impact_report(spark: SparkSession, sf: str) -> DataFrame:
    """Direct and transitive dependents, affected tests and the risk of changing one file that was changed seven times."""
    roles = load(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"), F.when(F.col("s_suppkey") % 4 == 0, "test").otherwise("source").alias("role"))
    return impact.report(relations(spark, sf), roles, "s9", churn=7)


@query(f"""WITH {_PAIRS}, i AS (SELECT dst AS path, count(DISTINCT src) AS fan_in FROM pairs GROUP BY dst), o AS (SELECT src AS path, count(DISTINCT dst) AS fan_out FROM pairs GROUP BY src)
SELECT 's' || s_suppkey AS path, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, round(coalesce(fan_in, 0) * greatest(1, coalesce(fan_out, 0)) * (1 + (s_suppkey % 3) / 10.0::DOUBLE), 6) AS risk
FROM supplier LEFT JOIN i ON i.path = 's' || s_suppkey LEFT JOIN o ON o.path = 's' || s_suppkey""")
def impact_risk(spark: SparkSession, sf: str) -> DataFrame:
    """The risk of every file at once."""
    path = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    return impact.risks(graph.file_dependencies(relations(spark, sf)), load(spark, sf, "supplier").select(path.alias("path"), (F.col("s_suppkey") % 3).alias("churn"))).withColumn("risk", F.round("risk", 6))


@query("""WITH f AS (SELECT 'lib/m' || (p_partkey % 7) || '/' || replace(p_name, ' ', '_') || p_size || '.py' AS path FROM part WHERE p_partkey % 2 = 0), t AS (SELECT DISTINCT 'tests/m' || (p_partkey % 7) || '/test_' || replace(p_name, ' ', '_') || p_size || '.py' AS path FROM part WHERE p_partkey % 5 = 0
 UNION SELECT DISTINCT 'tests/' || replace(p_name, ' ', '_') || p_size || '_test.py' FROM part WHERE p_partkey % 11 = 0)
SELECT path, count(t.path) > 0 AS has_tests FROM (SELECT DISTINCT path, string_split(path, '/')[-1] AS base FROM f) f LEFT JOIN (SELECT path FROM t) t ON ends_with(t.path, 'test_' || base) OR ends_with(t.path, replace(base, '.py', '_test.py')) GROUP BY f.path""".replace("SELECT path, count(t.path)", "SELECT f.path, count(t.path)"))
def test_presence(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a source file has a test file by its name."""
    word = F.concat(F.translate("p_name", " ", "_"), F.col("p_size").cast("string"))
    module = (F.col("p_partkey") % 7).cast("string")
    parts = load(spark, sf, "part")
    sources = parts.where("p_partkey % 2 = 0").select(F.concat(F.lit("lib/m"), module, F.lit("/"), word, F.lit(".py")).alias("path"), F.lit("source").alias("role"))
    tests = parts.where("p_partkey % 5 = 0").select(F.concat(F.lit("tests/m"), module, F.lit("/test_"), word, F.lit(".py")).alias("path")).union(parts.where("p_partkey % 11 = 0").select(F.concat(F.lit("tests/"), word, F.lit("_test.py"))))
    return impact.test_presence(sources.unionByName(tests.withColumn("role", F.lit("test"))).distinct()).select("path", "has_tests")


@query("""WITH r AS (SELECT CASE WHEN l_linenumber = 1 THEN 's' || l_suppkey ELSE 'c' || (l_partkey % 900) END AS src, l_linenumber = 1 AS defines, l_partkey AS sym FROM lineitem), d AS (SELECT sym, max(src) AS file FROM r WHERE defines GROUP BY sym),
e AS (SELECT src, d.file AS dst FROM r JOIN d USING (sym) WHERE NOT defines AND src <> d.file)
SELECT src, dst, count(*) AS n FROM e GROUP BY src, dst""")
def endpoint_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Relations between files and symbols brought down to files, with their multiplicity."""
    line = F.col("l_linenumber") == 1
    src = F.when(line, F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).otherwise(F.concat(F.lit("c"), (F.col("l_partkey") % 900).cast("string")))
    rows = load(spark, sf, "lineitem").select(F.lit("file").alias("src_type"), src.alias("src_ref"), F.lit("symbol").alias("dst_type"), F.col("l_partkey").cast("string").alias("dst_ref"), F.when(line, "defines").otherwise("imports").alias("relation_type"))
    return impact.file_edges(rows.where("relation_type = 'imports'"), rows).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_orderkey, 'src' || (o_custkey % 5) || '/m' || (o_custkey % 11) || '/f' || (o_custkey % 97) || '.py' AS src, 'src' || (o_orderkey % 5) || '/m' || (o_orderkey % 11) || '/g.py' AS dst FROM orders),
m AS (SELECT o_orderkey, array_to_string(string_split(src, '/')[1:2], '/') AS a, array_to_string(string_split(dst, '/')[1:2], '/') AS b FROM c)
SELECT a AS src, b AS dst, count(*) AS n FROM m WHERE a <> b GROUP BY a, b ORDER BY min(o_orderkey), a, b LIMIT 20""")
def module_pairs_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """The first twenty pairs of modules in the order they appear."""
    path = lambda c, leaf: F.concat(F.lit("src"), (c % 5).cast("string"), F.lit("/m"), (c % 11).cast("string"), leaf)
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), path(F.col("o_custkey"), F.concat(F.lit("/f"), (F.col("o_custkey") % 97).cast("string"), F.lit(".py"))).alias("src"), path(F.col("o_orderkey"), F.lit("/g.py")).alias("dst"))
    return impact.first_pairs(rows, 20)


@query(f"""WITH RECURSIVE {_EDGES}, both_ways AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), walk AS (SELECT 's1' AS node, 0 AS hop UNION SELECT b.dst, w.hop + 1 FROM walk w JOIN both_ways b ON b.src = w.node WHERE w.hop < 3)
SELECT 's1' AS seed, node, CAST(min(hop) AS INTEGER) AS hop FROM walk GROUP BY node""")
def graph_bfs_expand(spark: SparkSession, sf: str) -> DataFrame:
    one = graph.kept(edges(spark, sf), "edges")
    return graph.bfs(one.union(one.select("dst", "src")), spark.range(1).select(F.lit("s1").alias("node")), 3)


@query(f"""WITH {_EDGES}, seeds AS (SELECT * FROM (VALUES ('s1', 10.0::DOUBLE), ('s2', 4.0::DOUBLE)) t(node, score)),
r1 AS (SELECT s.node AS seed, s.score, e.src AS node FROM seeds s JOIN edges e ON e.dst = s.node WHERE e.src NOT IN (SELECT node FROM seeds))
SELECT node, round(max(score) * 0.7, 6) AS score, 1 AS hop, 'reverse' AS via FROM r1 GROUP BY node""")
def graph_expand_decay(spark: SparkSession, sf: str) -> DataFrame:
    seeds = spark.createDataFrame([("s1", 10.0), ("s2", 4.0)], "node string, score double")
    return graph.expand(graph.kept(edges(spark, sf), "edges"), seeds, 2)


def _pagerank_sql(weight: str) -> str:
    """A hundred rounds; as in the operator, they stop counting where a fifth round changes the ranks by less than 1e-8."""
    rounds = ["r0 AS MATERIALIZED (SELECT w.node, w.weight / (SELECT sum(weight) FROM w) AS jump, outs.outs, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank, false AS done FROM w LEFT JOIN outs ON outs.node = w.node)"]
    for i in range(1, 101):
        new = f"(SELECT n.node, n.jump, n.outs, n.rank AS old, n.done, CASE WHEN n.done THEN n.rank ELSE 0.15 * n.jump + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE outs IS NULL) * n.jump + 0.85 * coalesce(g.got, 0) END AS rank FROM r{i - 1} n LEFT JOIN (SELECT e.dst AS node, sum(p.rank / p.outs) AS got FROM edges e JOIN r{i - 1} p ON p.node = e.src GROUP BY e.dst) g ON g.node = n.node)"
        done = "done OR sum(abs(rank - old)) OVER () < 1e-8" if i % 5 == 0 else "done"
        rounds.append(f"r{i} AS MATERIALIZED (SELECT node, jump, outs, rank, {done} AS done FROM {new})")
    return f"""WITH {_EDGES}, nodes AS MATERIALIZED (SELECT src AS node FROM edges UNION SELECT dst FROM edges), w AS MATERIALIZED (SELECT node, {weight} AS weight FROM nodes), outs AS MATERIALIZED (SELECT src AS node, count(*) AS outs FROM edges GROUP BY src),
{", ".join(rounds)}
SELECT node, round(rank / (SELECT sum(rank) FROM r100), 9) AS rank FROM r100"""


@query(_pagerank_sql("1.0::DOUBLE"))
def pagerank(spark: SparkSession, sf: str) -> DataFrame:
    """The operator's own rounds and tolerance."""
    return graph.pagerank(graph.kept(edges(spark, sf), "edges")).select("node", F.round("rank", 9).alias("rank"))


@query(_pagerank_sql("CASE WHEN node LIKE 's%' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END"))
def pagerank_personalized(spark: SparkSession, sf: str) -> DataFrame:
    one = graph.kept(edges(spark, sf), "edges")
    weights = graph.nodes(one).select("node", F.when(F.col("node").startswith("s"), 2.0).otherwise(0.0).alias("weight"))
    return graph.pagerank(one, teleport=weights).select("node", F.round("rank", 9).alias("rank"))


@query("""SELECT 'in' AS kind, neighbor FROM (SELECT DISTINCT 'p' || l_partkey AS neighbor FROM lineitem WHERE l_suppkey = 3) ORDER BY neighbor LIMIT 10""")
def graph_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem")
    return graph.neighbors(graph.edges_of(rows.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("p"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("s")), "p", "s"), "s3", 10)


_CLUSTERS = f"""WITH {_EDGES}, m AS (SELECT 'p' || p_partkey AS node, p_brand AS cluster, p_type AS role FROM part UNION ALL SELECT 's' || s_suppkey, 'suppliers', 'supplier' FROM supplier),
deg AS (SELECT node, sum(c) AS degree FROM (SELECT src AS node, 1 AS c FROM edges UNION ALL SELECT dst, 1 FROM edges) GROUP BY node), k AS (SELECT m.*, coalesce(deg.degree, 0) AS degree FROM m LEFT JOIN deg USING (node)),
roles AS (SELECT cluster, role, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, role) AS r FROM k GROUP BY cluster, role),
tops AS (SELECT cluster, string_agg(node, ',' ORDER BY r) AS top FROM (SELECT cluster, node, row_number() OVER (PARTITION BY cluster ORDER BY degree DESC, node) AS r FROM k) WHERE r <= 3 GROUP BY cluster),
crossing AS (SELECT a.cluster, count(DISTINCT b.cluster) AS outgoing FROM edges e JOIN m a ON a.node = e.src JOIN m b ON b.node = e.dst WHERE a.cluster <> b.cluster GROUP BY a.cluster)
SELECT k.cluster, count(*) AS size, any_value(roles.role) AS dominant, CAST(sum(degree) AS BIGINT) AS degree, coalesce(any_value(crossing.outgoing), 0) AS outgoing, any_value(tops.top) AS top
FROM k JOIN roles ON roles.cluster = k.cluster AND roles.r = 1 JOIN tops ON tops.cluster = k.cluster LEFT JOIN crossing ON crossing.cluster = k.cluster GROUP BY k.cluster ORDER BY size DESC, k.cluster LIMIT 10"""


@query(_CLUSTERS)
def cluster_modules(spark: SparkSession, sf: str) -> DataFrame:
    return graph.clusters(_members(spark, sf), graph.kept(edges(spark, sf), "edges"), 10, 3)


def _members(spark: SparkSession, sf: str) -> DataFrame:
    parts = load(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_brand").alias("cluster"), F.col("p_type").alias("role"))
    suppliers = load(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), F.lit("suppliers").alias("cluster"), F.lit("supplier").alias("role"))
    return parts.union(suppliers)
