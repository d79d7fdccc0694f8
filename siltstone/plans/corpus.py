"""Search and retrieval queries over documents, pages, parts and embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, paths, text
from ..functions.porter import porter_sql
from ..functions.text import STOPWORDS, identifier_tokens
from ..operators import analytics, batch_retrieval, evaluation, fts, graph, retrieval, timeline
from ..operators.text_index import TextIndex
from ..session import load, spread
from ..sources import code
from .bindings import table

QUERIES, ORACLES, query = table()

def _bm25_sql(terms: list[str], tail: str) -> str:
    wanted = ", ".join(f"'{t}'" for t in terms)
    return f"""
WITH tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS ts FROM documents),
lens AS (SELECT doc_id, len(ts) AS n FROM tok),
corpus AS (SELECT count(*) AS total, avg(n) AS mean_n FROM lens),
hits AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM tok) WHERE term IN ({wanted}) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
scored AS (SELECT h.doc_id, round(sum(greatest(ln((c.total - d.df + 0.5) / (d.df + 0.5)), 1e-6) * h.tf * 2.2 / (h.tf + 1.2 * (0.25 + 0.75 * l.n / c.mean_n))), 6) AS score, count(*) AS matched
  FROM hits h JOIN dfs d USING (term) JOIN lens l USING (doc_id) CROSS JOIN corpus c GROUP BY h.doc_id)
{tail}"""


@query(_bm25_sql(["scum", "error", "table", "apache", "license"], "SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 20"))
def fts_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    scored = fts.bm25(spread(load(spark, sf, "documents")), "doc_id", F.coalesce("text", F.lit("")), ["scum", "error", "table", "apache", "license"])
    return fts.top_k(scored.select("doc_id", "score"), "doc_id", 20)


@query(_bm25_sql(["license", "apache", "version"], """, best AS (SELECT bool_or(matched = 3) AS some_all FROM scored)
SELECT doc_id, score, CASE WHEN some_all THEN 'and' ELSE 'or' END AS mode FROM scored CROSS JOIN best WHERE NOT some_all OR matched = 3 ORDER BY score DESC, doc_id LIMIT 20"""))
def fts_and_or_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return fts.search(spread(load(spark, sf, "documents")), "doc_id", F.coalesce("text", F.lit("")), ["license", "apache", "version"], 20)


_TOKENS = "list_transform(regexp_extract_all(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[a-zA-Zа-яА-ЯёЁ0-9]+'), lambda t: lower(t))"


@query(f"""SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS.format("coalesce(text, '')")}) AS token FROM documents) GROUP BY token ORDER BY n DESC, token LIMIT 50""")
def identifier_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return spread(load(spark, sf, "documents")).select(F.explode_outer(identifier_tokens(F.col("text"))).alias("token")).where("token is not null").groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(50)


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


@query(f"""WITH q AS (SELECT list_filter(regexp_extract_all('the red widget of brand widget', '[a-z0-9]+'), lambda t: t NOT IN ({_STOP})) AS ts),
s AS (SELECT p_partkey, p_name, p_brand, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS nt, regexp_extract_all(lower(replace(p_brand, '#', '-') || '.' || p_name), '[a-z0-9]+') AS ft FROM part)
SELECT p_partkey, CAST(CASE WHEN lower(p_name) = 'the red widget of brand widget' THEN 10 ELSE 0 END + CASE WHEN contains(lower(replace(p_brand, '#', '-') || '.' || p_name), 'the red widget of brand widget') THEN 3 ELSE 0 END
 + list_sum(list_transform(ts, lambda t: CASE WHEN list_contains(nt, t) THEN 2 WHEN list_contains(ft, t) THEN 1 ELSE 0 END)) AS DOUBLE) AS score
FROM s CROSS JOIN q WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 20""")
def symbol_lookup_topk(spark: SparkSession, sf: str) -> DataFrame:
    symbols = load(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.concat_ws(".", F.translate("p_brand", "#", "-"), "p_name").alias("fq_name"))
    return retrieval.symbol_scores(symbols, "the red widget of brand widget").select("p_partkey", "score").orderBy(F.desc("score"), "p_partkey").limit(20)


_URL_PATH = "regexp_replace(url, '^https?://[^/]*/', '')"


@query(f"""WITH p AS (SELECT page_id, {_URL_PATH} AS path FROM pages), s AS (SELECT page_id, path, string_split(path, '/') AS parts FROM p),
t AS (SELECT page_id, list_distinct(regexp_extract_all(lower(regexp_replace(parts[len(parts)], '(.)\\.[^.]*$', '\\1')), '[a-z0-9]+')) AS a,
 list_distinct(regexp_extract_all(lower(CASE WHEN len(parts) > 1 THEN parts[len(parts)-1] ELSE '' END), '[a-z0-9]+')) AS b,
 list_distinct(regexp_extract_all(lower(array_to_string(parts[1:len(parts)-2], '/')), '[a-z0-9]+')) AS c FROM s)
SELECT page_id, CAST(0.75 * least(len(list_intersect(a, ['page', 'ref', '2', 'en', 'x'])), 3) + 0.25 * least(len(list_intersect(b, ['page', 'ref', '2', 'en', 'x'])), 2) + 0.15 * least(len(list_intersect(c, ['page', 'ref', '2', 'en', 'x'])), 3) AS DOUBLE) AS boost FROM t""")
def path_token_boost(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?://[^/]*/", "")
    return load(spark, sf, "pages").select("page_id", F.round(retrieval.path_boost(path, "page ref 2 en x"), 6).alias("boost"))


_ROLE = "CASE lang WHEN 'en' THEN 'source' WHEN 'fr' THEN 'test' WHEN 'de' THEN 'docs' WHEN 'es' THEN 'config' ELSE 'unknown' END"


def _roles(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.col("lang")
    role = F.when(lang == "en", "source").when(lang == "fr", "test").when(lang == "de", "docs").when(lang == "es", "config").otherwise("unknown")
    return load(spark, sf, "documents").select("doc_id", role.alias("role"), F.col("n_chars").cast("double").alias("score"), "source", "n_chars")


@query(f"""SELECT doc_id, {_ROLE} AS role, CAST(round(n_chars * CASE {_ROLE} WHEN 'source' THEN 1.0 WHEN 'test' THEN 0.65 WHEN 'config' THEN 1.10 WHEN 'docs' THEN 1.20 ELSE 0.70 END, 6) AS DOUBLE) AS score FROM documents""")
def role_weighted_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = _roles(spark, sf)
    return rows.select("doc_id", "role", F.round(F.col("score") * retrieval.role_weight(F.col("role"), "where is the README"), 6).alias("score"))


@query(f"""WITH r AS (SELECT doc_id, {_ROLE} AS role, CAST(n_chars AS DOUBLE) AS score FROM documents), m AS (SELECT 0.5 * max(score) AS least_score FROM r)
SELECT doc_id, CASE WHEN role = 'config' AND score > 0 THEN greatest(score, least_score) ELSE score END AS score FROM r CROSS JOIN m""")
def config_boost(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.config_boost(_roles(spark, sf).select("doc_id", "role", "score"), "database timeout").select("doc_id", "score")


@query("""WITH m AS (SELECT max(o_totalprice) AS best FROM orders) SELECT o_orderkey, o_totalprice FROM orders CROSS JOIN m WHERE o_totalprice >= 0.4 * best""")
def score_decay_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.score_decay(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("""WITH t AS (SELECT c_nationkey, list_sort(list(c_acctbal), 'DESC') AS s FROM customer GROUP BY c_nationkey), u AS (SELECT c_nationkey, len(s) AS n, s[1] AS a, s[least(len(s), 4)] AS b FROM t)
SELECT c_nationkey, CASE WHEN a <= 0 THEN 'ambiguous' WHEN n = 1 THEN 'high' WHEN b <= 0 OR a / b >= 2 THEN 'high' WHEN a / b >= 1.2 THEN 'medium' ELSE 'ambiguous' END AS coverage FROM u""")
def coverage_class(spark: SparkSession, sf: str) -> DataFrame:
    # A nation's scores are reduced to the best four and their number before they meet.
    customers = load(spark, sf, "customer")
    best = top_values(customers, "c_nationkey", "c_acctbal", 4)
    return best.select("c_nationkey", retrieval.coverage_class(F.col("values")).alias("coverage"))


def top_values(rows: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """group, values: the n largest values of each group."""
    return timeline.keep_newest(rows.select(group, value).withColumn("siltstone_id", F.monotonically_increasing_id()), group, value, "siltstone_id", n).groupBy(group).agg(F.collect_list(value).alias("values"))


@query(f"""WITH r AS (SELECT DISTINCT url FROM pages), n AS (SELECT count(*) AS n FROM r),
t AS (SELECT token, count(*) AS coverage FROM (SELECT url, unnest(list_distinct({_TOKENS.format("regexp_replace(url, '([^/])\\.[^./]*$', '\\1')")})) AS token FROM r)
 WHERE len(token) >= 3 AND token NOT IN ('http', 'example', 'src', 'lib', 'libs', 'app', 'apps', 'test', 'tests', 'docs', 'doc', 'py', 'ts', 'js', 'go', 'rs', 'pkg', 'internal', 'main', 'init', 'index') GROUP BY token)
SELECT token, coverage FROM t CROSS JOIN n WHERE coverage < n ORDER BY abs(coverage - n / 2), coverage DESC, token LIMIT 3""")
def disambiguators(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.disambiguators(load(spark, sf, "pages"), "url", "http example")


_RRF = """a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored),
b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents)"""


@query(_bm25_sql(["license", "apache"], f""", {_RRF}
SELECT doc_id, round(sum(part), 9) AS fused FROM (SELECT doc_id, 1.0::DOUBLE / (60 + r) AS part FROM a UNION ALL SELECT doc_id, 0.5::DOUBLE / (60 + r) FROM b) GROUP BY doc_id ORDER BY fused DESC, doc_id LIMIT 50"""))
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    a = fts.bm25(spread(docs), "doc_id", F.coalesce("text", F.lit("")), ["license", "apache"])
    b = docs.select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return retrieval.rrf([(a, 1.0), (b, 0.5)], "doc_id").orderBy(F.desc("fused"), "doc_id").limit(50)


@query("""SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20""")
def vector_topk_cosine(spark: SparkSession, sf: str) -> DataFrame:
    vectors = load(spark, sf, "embeddings")
    return analytics.vector_top_k(vectors, "vec_id", "embedding", vectors.where("vec_id = 0").first()["embedding"], 20)


@query("""SELECT label, round(top, 6) AS top, n, round(greatest(0, least(1, (top - 0.45) / 0.25)) * greatest(0, least(1, (n - 100) / 400.0)), 6) AS weight
FROM (SELECT label, max(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))) AS top, 10 * count(*) AS n FROM embeddings WHERE vec_id <> 0 GROUP BY label)""")
def vector_fusion_adaptive(spark: SparkSession, sf: str) -> DataFrame:
    vectors = load(spark, sf, "embeddings")
    first = F.array(*(F.lit(float(x)) for x in vectors.where("vec_id = 0").first()["embedding"]))
    best = vectors.where("vec_id <> 0").groupBy("label").agg(F.max(analytics.cosine(F.col("embedding"), first)).alias("top"), (10 * F.count("*")).alias("n"))
    return best.select("label", F.round("top", 6).alias("top"), "n", F.round(retrieval.vector_weight(F.col("top"), F.col("n")), 6).alias("weight"))


_FILES = f"""files AS (SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'xx') || '/d' || doc_id || '.py' AS path, {_ROLE} AS role, CASE WHEN n_chars % 3 = 0 THEN 1 ELSE 0 END AS churn, CASE WHEN n_chars % 5 = 0 THEN 1 ELSE 99 END AS age,
 coalesce(source, 'none') || (doc_id % 100) AS name, coalesce(source, 'none') || '.' || coalesce(lang, 'xx') || '.' || coalesce(source, 'none') || (doc_id % 100) AS fq_name FROM documents),
edges AS (SELECT a.path AS src, b.path AS dst FROM files a JOIN files b ON b.doc_id = (a.doc_id * 7 + 3) % (SELECT max(doc_id) + 1 FROM documents) WHERE a.path <> b.path)"""
_QUERY = "license apache version url src7"
_QUERY_TERMS = _QUERY.split()


def _bound(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents as source files: (files with git facts, symbols, edges, text scores, vector scores)."""
    docs = load(spark, sf, "documents")
    source, lang = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("xx"))
    number = F.col("doc_id").cast("string")
    name = F.concat(source, (F.col("doc_id") % 100).cast("string"))
    role = F.when(F.col("lang") == "en", "source").when(F.col("lang") == "fr", "test").when(F.col("lang") == "de", "docs").when(F.col("lang") == "es", "config").otherwise("unknown")
    files = docs.select(
        "doc_id", F.concat(source, F.lit("/"), lang, F.lit("/d"), number, F.lit(".py")).alias("path"), role.alias("role"), name.alias("name"), F.concat_ws(".", source, lang, name).alias("fq_name"),
        (F.col("n_chars") % 3 == 0).cast("int").alias("churn_30d"), F.when(F.col("n_chars") % 5 == 0, 1).otherwise(99).alias("age_days"),
    )
    files = graph.kept(files, "files").withColumn("file_path", F.col("path"))
    size = files.agg(F.max("doc_id") + 1).first()[0]
    all_files = files.hint("merge")  # joins with whole tables: neither side is small
    target = all_files.select(F.col("doc_id").alias("to"), F.col("path").alias("dst"))
    edges = files.select(((F.col("doc_id") * 7 + 3) % F.lit(size)).alias("to"), F.col("path").alias("src")).join(target, "to").where("src <> dst").select("src", "dst")
    found = fts.bm25(docs, "doc_id", F.coalesce("text", F.lit("")), _QUERY_TERMS).join(all_files.select("doc_id", "path"), "doc_id").select("path", "score")
    vectors = load(spark, sf, "embeddings")
    first = F.array(*(F.lit(float(x)) for x in vectors.where("vec_id = 0").first()["embedding"]))
    near = vectors.select(F.col("vec_id").alias("doc_id"), F.round(analytics.cosine(F.col("embedding"), first), 6).alias("score")).join(all_files.select("doc_id", "path"), "doc_id").select("path", "score")
    return files, files.select("name", "fq_name", "file_path"), graph.kept(edges, "edges"), found, near


@query(_bm25_sql(_QUERY_TERMS, f""", {_FILES}, q AS (SELECT {_QUERY_TERMS!r} AS ts),
found AS (SELECT path, fq_name, CAST((lower(name) = '{_QUERY}')::INT * 10 + contains(lower(fq_name), '{_QUERY}')::INT * 3 + list_sum(list_transform(ts, lambda t: CASE WHEN list_contains({_TOKENS.format("name")}, t) THEN 2 WHEN list_contains({_TOKENS.format("fq_name")}, t) THEN 1 ELSE 0 END)) AS DOUBLE) AS score
 FROM files, q WHERE score > 0 ORDER BY score DESC, fq_name, path LIMIT 20),
texts AS (SELECT path, score FROM scored JOIN files USING (doc_id) ORDER BY score DESC, path LIMIT 20),
s1 AS (SELECT path, sum(score) AS score FROM (SELECT path, 3 * max(score) AS score FROM found GROUP BY path UNION ALL SELECT path, score FROM texts) GROUP BY path),
seeds AS (SELECT path, score FROM s1 ORDER BY score DESC, path LIMIT 5), open_edges AS (SELECT src, dst FROM edges WHERE dst NOT IN (SELECT path FROM seeds)), back AS (SELECT dst AS src, src AS dst FROM edges WHERE src NOT IN (SELECT path FROM seeds)),
f1 AS (SELECT e.dst AS path, s.score * 0.7 AS score FROM seeds s JOIN open_edges e ON e.src = s.path), f2 AS (SELECT e.dst AS path, f.score * 0.7 AS score FROM f1 f JOIN open_edges e ON e.src = f.path),
b1 AS (SELECT e.dst AS path, s.score * 0.7 AS score FROM seeds s JOIN back e ON e.src = s.path), b2 AS (SELECT e.dst AS path, f.score * 0.7 AS score FROM b1 f JOIN back e ON e.src = f.path),
mixed AS (SELECT e.dst AS path, s.score * 0.49 AS score FROM seeds s JOIN edges e ON e.src = s.path),
s2 AS (SELECT path, max(score) AS score FROM (SELECT path, score FROM s1 UNION ALL SELECT path, 0.5 * round(score, 6) FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM mixed)) GROUP BY path),
s3 AS (SELECT path, role, doc_id, churn, age, CASE WHEN role = 'config' AND score > 0 THEN greatest(score, 0.5 * (SELECT max(score) FROM s2)) ELSE score END + 0.15 * ((string_split(path, '/')[1] = 'src7')::INT) AS score FROM s2 JOIN files USING (path)),
s4 AS (SELECT path, score * CASE role WHEN 'source' THEN 1.0 WHEN 'test' THEN 0.65 WHEN 'config' THEN 1.10 WHEN 'docs' THEN 0.35 ELSE 0.70 END * CASE WHEN churn > 0 THEN 1.10 ELSE 1.0 END * CASE WHEN age < 30 THEN 1.05 ELSE 1.0 END AS score FROM s3),
near AS (SELECT path, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings JOIN files ON doc_id = vec_id),
w AS (SELECT greatest(0, least(1, ((SELECT max(score) FROM near) - 0.45) / 0.25)) * greatest(0, least(1, ((SELECT count(*) FROM files) - 100) / 400.0)) AS w),
ranks AS (SELECT path, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, path)) AS part FROM s4 UNION ALL SELECT path, w / (60 + row_number() OVER (ORDER BY score DESC, path)) FROM near, w),
fused AS (SELECT path, round(sum(part), 9) AS f FROM ranks GROUP BY path), s5 AS (SELECT path, f * (SELECT max(score) FROM s4) / (SELECT max(f) FROM fused) AS score FROM fused)
SELECT path, round(score, 6) AS score FROM s5 WHERE score >= 0.4 * (SELECT max(score) FROM s5) ORDER BY s5.score DESC, path LIMIT 10"""))
def hybrid_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """All stages but the centrality, which hybrid_retrieve_central adds: its ranks have no SQL at this place."""
    files, symbols, edges, found, near = _bound(spark, sf)
    result = retrieval.retrieve(files, symbols, found, _QUERY, edges=edges, git=files, vectors=near, centrality=False)
    return result.files.select("path", F.round("score", 6).alias("score"))


@query()
def hybrid_retrieve_central(spark: SparkSession, sf: str) -> DataFrame:
    """All ten stages, in edit mode; held against plain Python in a test."""
    files, symbols, edges, found, near = _bound(spark, sf)
    result = retrieval.retrieve(files, symbols, found, _QUERY, "edit", 10, edges, files, near)
    return result.files.select("path", F.round("score", 6).alias("score"))


# Queries of a batch: (text, mode). Each stage has a case: a trigger of the config boost, a word that asks for documentation, both modes, stop-words alone, nothing found.
_BATCH = {
    "q0": (_QUERY, "navigate"), "q1": (_QUERY, "edit"), "q2": ("error table src3", "navigate"), "q3": ("scum src11 en license", "edit"), "q4": ("apache readme src2 src2", "navigate"), "q5": ("the of", "navigate"), "q6": ("zzzz", "edit"),
    "q7": ("src5", "edit"),
}


def _retrieve_sql(query_id: str, asked: str, mode: str) -> str:
    """One query of the batch: the stages without centrality; vectors for all queries are those of the first vector."""
    terms = list(dict.fromkeys(asked.split()))
    telling = [t for t in asked.split() if t not in STOPWORDS]
    weights = retrieval.ROLE_WEIGHTS[mode] | ({"docs": retrieval.DOCS_WEIGHT} if any(w in asked for w in retrieval.DOCS_WORDS) else {})
    role = "CASE role " + " ".join(f"WHEN '{r}' THEN {w}" for r, w in weights.items() if r != "other") + f" ELSE {weights['other']} END"
    config = "CASE WHEN role = 'config' AND score > 0 THEN greatest(score, 0.5 * (SELECT max(score) FROM s2)) ELSE score END" if set(asked.split()) & set(retrieval.CONFIG_WORDS) else "score"
    hops = 3 if mode == "edit" else 2
    walks = "".join(f", {w}{k} AS (SELECT DISTINCT e.dst AS path, f.score * 0.7 AS score FROM {w}{k - 1} f JOIN {source} e ON e.src = f.path)" for w, source in (("f", "open_edges"), ("b", "back")) for k in range(1, hops + 1))
    reached = " UNION ALL ".join(f"SELECT * FROM {w}{k}" for w in "fb" for k in range(1, hops + 1))
    points = f"list_sum(list_transform({telling!r}, lambda t: CASE WHEN list_contains({_TOKENS.format('name')}, t) THEN 2 WHEN list_contains({_TOKENS.format('fq_name')}, t) THEN 1 ELSE 0 END))" if telling else "0"
    symbol = f"(lower(name) = '{asked}')::INT * 10 + contains(lower(fq_name), '{asked}')::INT * 3 + {points}" if telling else "0"
    return _bm25_sql(terms, f""", {_FILES},
found AS (SELECT path, fq_name, CAST({symbol} AS DOUBLE) AS score FROM files WHERE score > 0 ORDER BY score DESC, fq_name, path LIMIT 20),
texts AS (SELECT path, score FROM scored JOIN files USING (doc_id) ORDER BY score DESC, path LIMIT 20),
s1 AS (SELECT path, sum(score) AS score FROM (SELECT path, 3 * max(score) AS score FROM found GROUP BY path UNION ALL SELECT path, score FROM texts) GROUP BY path),
seeds AS (SELECT path, score FROM s1 ORDER BY score DESC, path LIMIT 5), open_edges AS (SELECT src, dst FROM edges WHERE dst NOT IN (SELECT path FROM seeds)), back AS (SELECT dst AS src, src AS dst FROM edges WHERE src NOT IN (SELECT path FROM seeds)),
f0 AS (SELECT * FROM seeds), b0 AS (SELECT * FROM seeds){walks},
mixed AS (SELECT e.dst AS path, s.score * 0.49 AS score FROM seeds s JOIN edges e ON e.src = s.path),
s2 AS (SELECT path, max(score) AS score FROM (SELECT path, score FROM s1 UNION ALL SELECT path, {1.0 if mode == "edit" else 0.5} * round(score, 6) FROM ({reached} UNION ALL SELECT * FROM mixed)) GROUP BY path),
s3 AS (SELECT path, role, churn, age, {config} + 0.75 * (('d' || doc_id) IN {tuple([*terms, ''])!r})::INT + 0.25 * (string_split(path, '/')[2] IN {tuple([*terms, ''])!r})::INT + 0.15 * (string_split(path, '/')[1] IN {tuple([*terms, ''])!r})::INT AS score FROM s2 JOIN files USING (path)),
s4 AS (SELECT path, score * {role} * CASE WHEN churn > 0 THEN 1.10 ELSE 1.0 END * CASE WHEN age < 30 THEN 1.05 ELSE 1.0 END AS score FROM s3),
near AS (SELECT path, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings JOIN files ON doc_id = vec_id),
w AS (SELECT greatest(0, least(1, ((SELECT max(score) FROM near) - 0.45) / 0.25)) * greatest(0, least(1, ((SELECT count(*) FROM files) - 100) / 400.0)) AS w),
ranks AS (SELECT path, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, path)) AS part FROM s4 UNION ALL SELECT path, w / (60 + row_number() OVER (ORDER BY score DESC, path)) FROM near, w WHERE w > 0),
fused AS (SELECT path, round(sum(part), 9) AS f FROM ranks GROUP BY path),
s5 AS (SELECT path, f * coalesce((SELECT max(score) FROM s4), 1.0) / (SELECT max(f) FROM fused) AS score FROM fused WHERE (SELECT w FROM w) > 0 UNION ALL SELECT path, score FROM s4 WHERE (SELECT w FROM w) <= 0)
SELECT '{query_id}' AS query_id, path, score, row_number() OVER (ORDER BY s5.score DESC, path) AS rank FROM s5 WHERE score >= 0.4 * (SELECT max(score) FROM s5) ORDER BY s5.score DESC, path LIMIT 10""")


_BATCH_SQL = " UNION ALL ".join(f"SELECT * FROM ({_retrieve_sql(q, text, mode)})" for q, (text, mode) in _BATCH.items())


def _batch(spark: SparkSession, sf: str) -> tuple[DataFrame, batch_retrieval.Answers]:
    files, symbols, edges, _, near = _bound(spark, sf)
    queries = spark.createDataFrame([(q, text, mode) for q, (text, mode) in _BATCH.items()], "query_id string, text string, mode string")
    docs = spread(load(spark, sf, "documents"))
    texts = fts.bm25_many(docs, "doc_id", F.coalesce("text", F.lit("")), {q: asked.split() for q, (asked, _) in _BATCH.items()}).join(files.hint("merge").select("doc_id", "path"), "doc_id").select("query_id", "path", "score")
    vectors = near.join(F.broadcast(queries.select("query_id")))  # eight queries, each with the same vector
    return queries, batch_retrieval.retrieve_many(files, symbols, texts, queries, edges=edges, git=files, vectors=vectors, centrality=False)


@query(f"SELECT query_id, path, round(score, 6) AS score, rank FROM ({_BATCH_SQL})")
def retrieve_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Eight queries through all stages in one plan."""
    _, answers = _batch(spark, sf)
    return answers.files.select("query_id", "path", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH r AS MATERIALIZED ({_BATCH_SQL}), wanted AS (SELECT coalesce(source, 'none') || '/' || coalesce(lang, 'xx') || '/d' || doc_id || '.py' AS path FROM documents WHERE contains(text, 'Apache License')),
q AS (SELECT unnest({list(_BATCH)!r}) AS query_id), n AS (SELECT count(*) AS n FROM wanted), h AS (SELECT q.query_id, count(*) FILTER (WHERE r.rank <= 5 AND w.path IS NOT NULL) AS hits5, count(*) FILTER (WHERE r.rank <= 3 AND w.path IS NOT NULL) AS hits3, count(*) FILTER (WHERE r.rank <= 3) AS top3, min(r.rank) FILTER (WHERE w.path IS NOT NULL) AS first
FROM q LEFT JOIN r USING (query_id) LEFT JOIN wanted w ON w.path = r.path GROUP BY q.query_id)
SELECT query_id, round(CASE WHEN n = 0 THEN 1.0 ELSE hits5 / n END, 6) AS recall_at_5_files, round(CASE WHEN top3 = 0 THEN 0.0 ELSE hits3 / top3 END, 6) AS precision_at_3_files, round(coalesce(1.0 / first, 0.0), 6) AS rr_files FROM h, n""")
def eval_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics of the batch: of every query, files that hold `Apache License` are expected."""
    queries, answers = _batch(spark, sf)
    docs = load(spark, sf, "documents").where(F.contains("text", F.lit("Apache License")))
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("xx")), F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".py"))
    wanted = docs.select(path.alias("path"))
    # Expected files are looked at by those that were retrieved, so that no list grows with the table: the metrics need their number and the hits.
    n = wanted.agg(F.count("*").alias("expected"))
    hits = answers.files.join(wanted.withColumn("hit", F.lit(True)), "path", "left")
    return evaluation.from_hits(queries, hits, n.crossJoin(F.broadcast(queries.select("query_id"))))


def _index_sql(docs: str = "documents") -> str:
    """terms (doc_id, term, n): Porter stems of words and of their normalised forms; corpus (total, mean_n)."""
    norm = "CASE WHEN len(w) < 5 THEN w WHEN regexp_matches(w, '[а-яё]') THEN regexp_replace(w, '^(.{3,}?)(?:' || ru || ')$', '\\1') ELSE regexp_replace(w, '^(.{3,}?)(?:' || en || ')$', '\\1') END"
    return f"""
WITH ends AS (SELECT '{"|".join(text._SUFFIXES_RU)}' AS ru, '{"|".join(text._SUFFIXES)}' AS en), tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS ts FROM {docs}),
corpus AS (SELECT count(*) AS total, avg(len(ts)) AS mean_n FROM tok), words AS MATERIALIZED (SELECT doc_id, len(ts) AS n, unnest(ts) AS w FROM tok),
forms AS MATERIALIZED (SELECT w, {norm} AS s FROM (SELECT DISTINCT w FROM words), ends), every AS (SELECT w FROM forms UNION SELECT s FROM forms), stems AS MATERIALIZED (SELECT w, stem FROM {porter_sql("every", "w")}),
pairs AS MATERIALIZED (SELECT f.w, s.stem AS term FROM forms f JOIN stems s ON s.w = f.w UNION SELECT f.w, s.stem FROM forms f JOIN stems s ON s.w = f.s),
terms AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM words JOIN pairs USING (w) GROUP BY ALL)"""


_WEIGHT = "greatest(ln((c.total - d.df + 0.5) / (d.df + 0.5)), 1e-6) * h.tf * 2.2 / (h.tf + 1.2 * (0.25 + 0.75 * h.n / c.mean_n))"


def _prefix_sql(terms: list[str], tail: str, docs: str = "documents") -> str:
    wanted = ", ".join(f"('{t}')" for t in terms)
    return _index_sql(docs) + f""",
hits AS (SELECT doc_id, n, p.t AS term, sum(tf) AS tf FROM terms JOIN (VALUES {wanted}) p(t) ON starts_with(term, p.t) GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
scored AS (SELECT h.doc_id, round(sum({_WEIGHT}), 6) AS score, count(*) AS matched FROM hits h JOIN dfs d USING (term) CROSS JOIN corpus c GROUP BY h.doc_id)
{tail}"""


def _index(spark: SparkSession, sf: str, docs: DataFrame | None = None) -> TextIndex:
    """An index of documents in a folder of its own."""
    docs = load(spark, sf, "documents") if docs is None else docs
    return TextIndex.build(spread(docs), "doc_id", F.col("text"), f"{graph.shared_folder(spark)}/index-{uuid.uuid4().hex}")


@query(_prefix_sql(["licen", "apach"], "SELECT doc_id, score, 'and' AS mode FROM scored WHERE matched = 2 ORDER BY score DESC, doc_id LIMIT 20"))
def fts_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """A search in a persisted index: `licenses of Apaches` by the stems `licen` and `apach`, prefixes that all must occur."""
    return _index(spark, sf).search("licenses of Apaches", 20)


@query(_prefix_sql(["licen", "version"], "SELECT doc_id, score, (SELECT count(*) FROM changed) AS documents FROM scored WHERE matched = 2 ORDER BY score DESC, doc_id LIMIT 50", "changed")
       .replace("WITH ends", "WITH changed AS (SELECT doc_id, CASE WHEN doc_id % 100 = 7 THEN text || ' licensed version ' || source ELSE text END AS text FROM documents WHERE doc_id % 100 <> 3), ends"))
def fts_index_update(spark: SparkSession, sf: str) -> DataFrame:
    """An index after changes: one document in a hundred is deleted, one changed, in five segments, so that tiers are merged too."""
    docs = load(spark, sf, "documents")
    index = _index(spark, sf, docs)
    changed = docs.where("doc_id % 100 = 7").withColumn("text", F.concat("text", F.lit(" licensed version "), F.coalesce("source", F.lit(""))))
    for k in range(5):  # a fifth of the changes each
        own = F.pmod(F.floor(F.col("doc_id") / 100), F.lit(5)) == k
        index.change(changed.where(own), F.col("text"), gone=docs.where("doc_id % 100 = 3").where(own).select("doc_id"))
    total = index.segments()[-1]["total"]
    return index.search("licensed versions", 50).select("doc_id", "score", F.lit(total).alias("documents"))


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents""")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", hashing.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))


@query("""SELECT doc_id, source FROM documents WHERE regexp_matches(text, 'AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{32,}|ghp_[A-Za-z0-9]{36}|[Tt][Oo][Kk][Ee][Nn] = "[0-9A-Fa-f]{40}"')""")
def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").where(paths.has_secret(F.col("text"), generic=True)).select("doc_id", "source")


@query("""WITH refs AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"/]+)', 1)) AS target FROM pages), first AS (SELECT DISTINCT string_split(regexp_replace(url, '^https?://[^/]*/', ''), '/')[1] AS segment FROM pages)
SELECT DISTINCT page_id, target FROM refs WHERE target IN (SELECT segment FROM first)""")
def docs_linker(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "pages")
    refs = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"/]+)'), F.lit(1))).alias("target"))
    known = pages.select(F.split(F.regexp_replace("url", "^https?://[^/]*/", ""), "/")[0].alias("target")).distinct()
    return refs.join(known, "target", "left_semi").distinct().select("page_id", "target")


@query("""SELECT page_id, level, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h([1-6])[ >]', 1)) AS level FROM pages) GROUP BY page_id, level""")
def heading_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<h([1-6])[ >]"), F.lit(1))).alias("level")).groupBy("page_id", "level").agg(F.count("*").alias("n"))


@query(f"""WITH q AS (SELECT list_filter(list_distinct(regexp_extract_all(lower('the apache license of that'), '[a-z0-9]+')), lambda t: t NOT IN ({_STOP})) AS ts)
SELECT doc_id, CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), ts)) AS INTEGER) AS overlap FROM documents CROSS JOIN q WHERE overlap > 0 ORDER BY overlap DESC, doc_id LIMIT 3""")
def wiki_relevance(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.article_relevance(load(spark, sf, "documents"), "doc_id", "text", "the apache license of that")


@query()
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.chunks(load(spark, sf, "documents"), "doc_id", "text", 128)


@query("""SELECT o.doc_id, o.source, CASE WHEN o.doc_id % 2 = 0 THEN 'new' ELSE 'changed' END AS state FROM documents o WHERE o.doc_id % 2 = 0 OR o.doc_id % 3 = 0""")
def incremental_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Old table: odd documents, with another hash where divisible by three; new table: all."""
    new = load(spark, sf, "documents").select("doc_id", "source", hashing.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    old = new.where("doc_id % 2 = 1").withColumn("content_hash", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("content_hash")))
    changed = code.changed_files(new, old, "doc_id")
    return changed.select("doc_id", "source", F.when(F.col("doc_id") % 2 == 0, "new").otherwise("changed").alias("state"))


@query("""SELECT source, count(*) AS files, sha256(coalesce(string_agg(h, '' ORDER BY h), '')) AS module_hash FROM (SELECT source, sha256(coalesce(text, '')) AS h FROM documents) GROUP BY source""")
def dirty_modules(spark: SparkSession, sf: str) -> DataFrame:
    hashes = load(spark, sf, "documents").select("source", hashing.content_hash(F.coalesce("text", F.lit(""))).alias("h"))
    return hashes.groupBy("source").agg(F.count("*").alias("files"), hashing.module_hash(F.collect_list("h")).alias("module_hash"))


@query("""SELECT conv_id, turn, substr(text, 1, 600) AS body FROM conversations WHERE role = 'user' ORDER BY conv_id DESC, turn DESC LIMIT 5""")
def memory_recent(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").where("role = 'user'").orderBy(F.desc("conv_id"), F.desc("turn")).limit(5).select("conv_id", "turn", F.substring("text", 1, 600).alias("body"))
