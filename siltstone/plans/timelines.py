"""Timeline queries. Events stand for symbol events: signup adds, error removes, the rest modify; user_id is the symbol."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, timeline
from ..session import load
from ..streaming import streams
from .bindings import table

QUERIES, ORACLES, query = table()

_KIND = "CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'removed' ELSE 'modified' END"
_E = f"e AS (SELECT event_id AS id, CAST(epoch(ts) AS DOUBLE) AS timestamp, user_id AS symbol_id, {_KIND} AS event_type, 'c' || (event_id % 7) AS commit_sha FROM events)"
CUT = "2024-01-15"
_CUT_TS = 1705276800.0


def symbol_events(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "removed").otherwise("modified")
    return load(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("double").alias("timestamp"), F.col("user_id").alias("symbol_id"), kind.alias("event_type"), F.concat(F.lit("c"), (F.col("event_id") % 7).cast("string")).alias("commit_sha"),
        F.lit(False).alias("orphaned"), F.col("event_type").alias("qualified_name"), F.lit("f").alias("file_path"),
    )


def _commits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"c{i}",) for i in range(5)], "commit_sha string")


def _renames(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth customer was renamed to the next one; every twentieth only perhaps."""
    rows = load(spark, sf, "customer").where("c_custkey % 10 = 0")
    return rows.select(F.col("c_custkey").alias("old_symbol_id"), (F.col("c_custkey") + 1).alias("new_symbol_id"), (F.col("c_custkey") % 20 == 0).alias("is_candidate"))


@query(f"""WITH last0 AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS c, arg_max(CAST(event_id % 3 AS VARCHAR), (ts, event_id)) AS p FROM events WHERE ts < TIMESTAMP '{CUT}' GROUP BY user_id),
last1 AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS c, arg_max(CAST(event_id % 3 AS VARCHAR), (ts, event_id)) AS p FROM events WHERE ts >= TIMESTAMP '{CUT}' GROUP BY user_id)
SELECT * FROM (SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed' WHEN a.c = b.c AND a.p = b.p THEN NULL WHEN a.c = b.c THEN 'moved' ELSE 'modified' END AS change
FROM last0 a FULL JOIN last1 b ON a.user_id = b.user_id) WHERE change IS NOT NULL""")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").withColumn("place", (F.col("event_id") % 3).cast("string"))
    prev, curr = (timeline.latest(events.where(cond), "user_id", "ts", "event_id", "event_type", "place") for cond in (F.col("ts") < CUT, F.col("ts") >= CUT))
    return timeline.snapshot_diff(prev, curr, "user_id", "event_type", "place")


@query(f"""WITH {_E}, x AS (SELECT symbol_id, arg_min(event_type, (timestamp, id)) AS f, arg_max(event_type, (timestamp, id)) AS l FROM e GROUP BY symbol_id)
SELECT symbol_id, CASE WHEN l = 'removed' THEN 'removed' WHEN f = 'added' THEN 'added' ELSE 'modified' END AS effect FROM x""")
def net_effect(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.net_effect(symbol_events(spark, sf), "symbol_id", "event_type", "timestamp", "id")


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id""")
def latest_event_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.latest(load(spark, sf, "events"), "user_id", "ts", "event_id", "event_type", "value")


_OPEN = f"o AS (SELECT * FROM e WHERE timestamp > {_CUT_TS} AND commit_sha IN ('c0', 'c1', 'c2', 'c3', 'c4'))"


@query(f"""WITH {_E}, {_OPEN}, l AS (SELECT symbol_id, arg_max(event_type, (timestamp, id)) AS event_type, max(timestamp) AS timestamp FROM o GROUP BY symbol_id),
g AS (SELECT * FROM l WHERE event_type = 'removed' AND symbol_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0 AND c_custkey % 20 <> 0))
SELECT symbol_id, round(timestamp, 3) AS timestamp, (SELECT count(*) FROM g) AS total_before_limit, (SELECT count(*) FROM g) > 25 AS truncated FROM g ORDER BY g.timestamp DESC, symbol_id LIMIT 25""")
def removed_since(spark: SparkSession, sf: str) -> DataFrame:
    found = timeline.removed_since(symbol_events(spark, sf), _commits(spark), _renames(spark, sf), F.lit(_CUT_TS), 25)
    return found.select("symbol_id", F.round("timestamp", 3).alias("timestamp"), "total_before_limit", "truncated")


@query(f"""WITH {_E}, {_OPEN}, x AS (SELECT symbol_id, arg_min(event_type, (timestamp, id)) AS f, arg_max(event_type, (timestamp, id)) AS l, max(timestamp) AS timestamp FROM o GROUP BY symbol_id),
n AS (SELECT symbol_id, timestamp, CASE WHEN l = 'removed' THEN 'removed' WHEN f = 'added' THEN 'added' ELSE 'modified' END AS effect FROM x WHERE symbol_id NOT IN (SELECT c_custkey + d FROM customer, (VALUES (0), (1)) v(d) WHERE c_custkey % 10 = 0 AND c_custkey % 20 <> 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY effect ORDER BY timestamp DESC, symbol_id) AS rn, count(*) OVER (PARTITION BY effect) AS total FROM n)
SELECT effect, symbol_id, round(timestamp, 3) AS timestamp, total AS total_before_limit FROM r WHERE rn <= 10""")
def timeline_diff_topn(spark: SparkSession, sf: str) -> DataFrame:
    found = timeline.diff(symbol_events(spark, sf), _commits(spark), _renames(spark, sf), F.lit(_CUT_TS), F.lit(4e9), 10)
    return found.select("effect", "symbol_id", F.round("timestamp", 3).alias("timestamp"), "total_before_limit")


@query(f"""WITH {_E}, {_OPEN}, x AS (SELECT symbol_id, arg_max(event_type, (timestamp, id)) AS l FROM o GROUP BY symbol_id) SELECT symbol_id FROM x WHERE l = 'removed' AND symbol_id NOT IN (SELECT c_custkey + d FROM customer, (VALUES (0), (1)) v(d) WHERE c_custkey % 10 = 0 AND c_custkey % 20 <> 0)""")
def regressions(spark: SparkSession, sf: str) -> DataFrame:
    """The removed bucket of the diff, uncut."""
    return timeline.regressions(symbol_events(spark, sf), _commits(spark), _renames(spark, sf), F.lit(_CUT_TS), F.lit(4e9))


@query("""SELECT event_id, event_type, value FROM events WHERE user_id = 7 ORDER BY ts, event_id""")
def symbol_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.history(load(spark, sf, "events"), "user_id", 7, "ts", "event_id").select("event_id", "event_type", "value")


@query("""SELECT user_id, epoch_us(max(ts)) AS last_us, max(event_type) AS name FROM events WHERE contains(lower(event_type), 'r') GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 15""")
def fuzzy_symbols(spark: SparkSession, sf: str) -> DataFrame:
    found = timeline.fuzzy_symbols(load(spark, sf, "events"), "user_id", "event_type", "ts", "R", 15)
    return found.select("user_id", F.unix_micros("last_ts").alias("last_us"), "name")


@query("""SELECT o_orderstatus, count(*) FILTER (WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS orphaned, count(*) AS total FROM orders GROUP BY o_orderstatus""")
def reconcile_orphans(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "orders").select(F.col("o_orderkey").alias("commit_sha"), "o_orderstatus", F.lit(False).alias("orphaned"))
    flagged = timeline.reconcile(events, load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("commit_sha")))
    return flagged.groupBy("o_orderstatus").agg(F.count_if("orphaned").alias("orphaned"), F.count("*").alias("total"))


@query("""SELECT c_nationkey, substr(sha256('root' || chr(0) || c_nationkey || chr(0) || 'sha'), 1, 32) AS snapshot_id, count(*) AS symbol_count, sha256(string_agg(k || chr(0), '' ORDER BY k)) AS checksum
FROM (SELECT c_nationkey, CAST(c_custkey AS VARCHAR) AS k FROM customer) GROUP BY c_nationkey""")
def release_snapshot_checksum(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.release_snapshot(load(spark, sf, "customer"), "c_nationkey", "c_custkey", "root", "sha")


@query("""WITH a AS (SELECT c_nationkey AS tag, max(c_custkey) AS sha FROM customer WHERE c_nationkey < 20 AND c_custkey % 2 = 0 GROUP BY c_nationkey), b AS (SELECT c_nationkey AS tag, max(c_custkey) AS sha FROM customer WHERE c_nationkey > 3 GROUP BY c_nationkey)
SELECT * FROM (SELECT coalesce(a.tag, b.tag) AS tag, CASE WHEN a.tag IS NULL THEN 'created' WHEN b.tag IS NULL THEN 'deleted' WHEN a.sha <> b.sha THEN 'moved' END AS change FROM a FULL JOIN b ON a.tag = b.tag) WHERE change IS NOT NULL""")
def tag_changes(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "customer").withColumnRenamed("c_nationkey", "tag")
    before = rows.where("tag < 20 and c_custkey % 2 = 0").groupBy("tag").agg(F.max("c_custkey").alias("sha"))
    return timeline.tag_changes(before, rows.where("tag > 3").groupBy("tag").agg(F.max("c_custkey").alias("sha")))


_PARTS = """p AS (SELECT p_brand || '|' || p_size AS block, p_partkey AS id, p_partkey % 2 = 1 AS gone, p_name || p_retailprice AS hash, string_split(p_name, ' ')[-1] AS leaf FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY block, hash ORDER BY id) AS place FROM p WHERE gone), a AS (SELECT *, row_number() OVER (PARTITION BY block, hash ORDER BY id) AS place FROM p WHERE NOT gone),
one AS (SELECT r.id AS removed_id, a.id AS added_id FROM r JOIN a USING (block, hash, place)),
free AS (SELECT r.id AS removed_id, a.id AS added_id FROM r JOIN a USING (block, leaf) LEFT JOIN one o ON o.added_id = a.id WHERE r.id NOT IN (SELECT removed_id FROM one) AND (o.removed_id IS NULL OR r.id < o.removed_id))"""


@query(f"""WITH {_PARTS} SELECT removed_id, added_id, 1.0::DOUBLE AS confidence, false AS is_candidate FROM one UNION ALL SELECT removed_id, min(added_id), 0.9::DOUBLE, true FROM free GROUP BY removed_id""")
def rename_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of odd keys removed and of even keys added, blocked by brand and size. No two of their last words are near each other
    without being equal, so the SQL needs no ratio; a test holds that against plain Python."""
    parts = load(spark, sf, "part").select(F.concat_ws("|", "p_brand", "p_size").alias("block"), F.when(F.col("p_partkey") % 2 == 1, "removed").otherwise("added").alias("event_type"), F.col("p_partkey").alias("symbol_id"), F.concat("p_name", F.col("p_retailprice").cast("string")).alias("content_hash"), F.translate("p_name", " ", ".").alias("qualified_name"))
    return timeline.rename_pairs(parts, "block")


@query("""WITH p AS (SELECT p_brand AS block, p_partkey AS id, 'dispatch_' || (p_partkey * 7 % 90 + 10) AS leaf, p_partkey % 2 = 1 AS gone FROM part),
m AS (SELECT r.id AS removed_id, a.id AS added_id, CASE WHEN r.leaf = a.leaf THEN 0.9::DOUBLE ELSE 20::DOUBLE / 22 END AS ratio FROM p r JOIN p a ON a.block = r.block AND r.gone AND NOT a.gone
 AND (r.leaf[10] IN (a.leaf[10], a.leaf[11]) OR r.leaf[11] IN (a.leaf[10], a.leaf[11])))
SELECT removed_id, round(max(ratio), 6) AS confidence, true AS is_candidate, arg_min(added_id, (-ratio, added_id)) AS added_id FROM m GROUP BY removed_id""")
def rename_near(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as symbols `dispatch_NN` of their brands: names of one long common beginning. Two of them have 9 letters and a digit of 11 in common, or no ratio that counts."""
    leaf = F.concat(F.lit("app.dispatch_"), (F.col("p_partkey") * 7 % 90 + 10).cast("string"))
    parts = load(spark, sf, "part").select(F.col("p_brand").alias("block"), F.when(F.col("p_partkey") % 2 == 1, "removed").otherwise("added").alias("event_type"), F.col("p_partkey").alias("symbol_id"), F.lit(None).cast("string").alias("content_hash"), leaf.alias("qualified_name"))
    return timeline.rename_pairs(parts, "block").withColumn("confidence", F.round("confidence", 6))


@query(r"""WITH q AS (SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 'what was removed since v1.2.0 in app.core.run' WHEN 1 THEN 'Changed between HEAD~3 and 0a1b2c3d' WHEN 2 THEN 'когда был добавлен app.user' WHEN 3 THEN 'что изменилось МЕЖДУ v1 и v2' WHEN 4 THEN 'where is the parser gone' ELSE 'history of a.b.c.d deletion of x.y' END AS q FROM documents),
m AS (SELECT id, q, list_filter([CASE WHEN regexp_matches(lower(q), '\b(removed|removal|deleted|deletion)\b|\bgone\s+since\b|\bmissing\s+since\b|(^|\s)удал|(^|\s)пропа[лд]') THEN 'removed_since' END,
 CASE WHEN regexp_matches(lower(q), '\bbetween\s+\S+\s+and\s+\S+\b|\bdiff\b|(^|\s)регресс|(^|\s)между\s+\S+\s+и\s+\S+') THEN 'diff' END, CASE WHEN regexp_matches(lower(q), '\bwhen\s+was\b|\bhistory\s+of\b|(^|\s)когда\s+(был|добавил|удалил)') THEN 'symbol_history' END], lambda x: x IS NOT NULL) AS kinds FROM q)
SELECT id, array_to_string(kinds, ',') AS kinds, CASE WHEN len(kinds) > 0 THEN array_to_string(regexp_extract_all(q, '\b(?:HEAD(?:~\d+)?|v\d+(?:\.\d+){0,3}(?:-[A-Za-z0-9]+)?|[0-9a-f]{7,40})\b'), ',') ELSE '' END AS refs,
 CASE WHEN len(kinds) > 0 THEN array_to_string(regexp_extract_all(q, '[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*){1,}'), ',') ELSE '' END AS symbols FROM m""")
def history_intent(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of history question, commits and symbols named, in two languages."""
    texts = ["what was removed since v1.2.0 in app.core.run", "Changed between HEAD~3 and 0a1b2c3d", "когда был добавлен app.user", "что изменилось МЕЖДУ v1 и v2", "where is the parser gone", "history of a.b.c.d deletion of x.y"]
    q = F.element_at(F.array(*map(F.lit, texts)), (F.col("doc_id") % 6 + 1).cast("int"))
    rows = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), q.alias("q"))
    return rows.select("id", *(F.array_join(f(F.col("q")), ",").alias(name) for f, name in ((timeline.history_markers, "kinds"), (timeline.history_references, "refs"), (timeline.history_symbols, "symbols"))))


@query(f"""WITH {_E}, l AS (SELECT symbol_id, arg_max(event_type, (timestamp, id)) AS name FROM (SELECT e.*, v.event_type AS name FROM e JOIN events v ON v.event_id = e.id) GROUP BY symbol_id), n AS (SELECT user_id AS symbol_id, arg_max(event_type, (ts, event_id)) AS name FROM events GROUP BY user_id),
r AS (SELECT c_custkey AS old, c_custkey + 1 AS new FROM customer WHERE c_custkey % 10 = 0) SELECT old AS old_symbol_id, new AS new_symbol_id, a.name AS old_name, b.name AS new_name FROM r LEFT JOIN n a ON a.symbol_id = old LEFT JOIN n b ON b.symbol_id = new""")
def rename_names(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.with_rename_names(_renames(spark, sf), symbol_events(spark, sf)).select("old_symbol_id", "new_symbol_id", "old_name", "new_name")


@query(f"""WITH {_E}, x AS (SELECT *, 'p' || (symbol_id % 3) AS project_root, id % 11 = 0 AS orphaned FROM e) SELECT project_root, event_type, count(*) AS n, count(*) FILTER (WHERE orphaned) AS orphaned, round(max(timestamp), 3) AS last FROM x GROUP BY GROUPING SETS ((project_root, event_type), (project_root))""")
def timeline_status(spark: SparkSession, sf: str) -> DataFrame:
    events = symbol_events(spark, sf).withColumns({"project_root": F.concat(F.lit("p"), (F.col("symbol_id") % 3).cast("string")), "orphaned": F.col("id") % 11 == 0})
    return timeline.status(events).withColumn("last", F.round("last", 3))


@query(f"""WITH {_E}, x AS (SELECT *, id % 11 = 0 AS orphaned FROM e) SELECT id, event_type FROM x WHERE timestamp BETWEEN 1704500000 AND 1705500000 AND event_type IN ('added', 'removed') AND NOT orphaned""")
def events_between(spark: SparkSession, sf: str) -> DataFrame:
    events = symbol_events(spark, sf).withColumn("orphaned", F.col("id") % 11 == 0)
    return timeline.events_between(events, F.lit(1704500000.0), F.lit(1705500000.0), ("added", "removed")).select("id", "event_type")


@query(f"""WITH {_E}, x AS (SELECT *, 'p' || (symbol_id % 3) AS project_root, id % 11 = 0 AS orphaned FROM e) SELECT id FROM x WHERE NOT (project_root = 'p1' AND timestamp < {_CUT_TS} AND orphaned)""")
def timeline_prune(spark: SparkSession, sf: str) -> DataFrame:
    events = symbol_events(spark, sf).withColumns({"project_root": F.concat(F.lit("p"), (F.col("symbol_id") % 3).cast("string")), "orphaned": F.col("id") % 11 == 0})
    return timeline.pruned(events, "p1", F.lit(_CUT_TS), only_orphaned=True).select("id")


@query("""WITH s AS (SELECT c_custkey AS k, 'f' || (c_custkey % 40) || '.py' AS path, 'm.' || c_name AS fq, c_custkey % 7 AS v FROM customer), a AS (SELECT * FROM s WHERE k % 5 <> 0), b AS (SELECT k, CASE WHEN k % 9 = 0 THEN 'moved/' || path ELSE path END AS path, fq, CASE WHEN k % 4 = 0 THEN v + 100 ELSE v END AS v FROM s WHERE k % 6 <> 0)
SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'modified' ELSE 'moved' END AS event_type, count(*) AS n FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v OR a.path <> b.path GROUP BY 1""")
def emitted_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a scan by kind. Contents differ between symbols, so no removal pairs with an addition."""
    key = F.col("c_custkey")
    rows = load(spark, sf, "customer").select(key, key.cast("string").alias("symbol_id"), F.concat(F.lit("f"), (key % 40).cast("string"), F.lit(".py")).alias("file_path"), F.lit(None).cast("string").alias("qualified_name"), (key % 7).alias("v"))
    content = F.concat_ws("/", "symbol_id", F.col("v").cast("string")).alias("content_hash")
    columns = ["symbol_id", "file_path", "qualified_name"]
    prev = rows.where(key % 5 != 0).select(*columns, content)
    after = rows.where(key % 6 != 0).withColumn("v", F.when(key % 4 == 0, F.col("v") + 100).otherwise(F.col("v"))).withColumn("file_path", F.when(key % 9 == 0, F.concat(F.lit("moved/"), "file_path")).otherwise(F.col("file_path")))
    return timeline.emitted(prev, after.select(*columns, content), "/root", 100.0)[0].groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3""")
def retention_topn(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.keep_newest(load(spark, sf, "events"), "user_id", "ts", "event_id", 3).select("event_id", "user_id")


# --- streams: the same rows as in batch ---------------------------------------------------------------------------


@query("""SELECT epoch_us(time_bucket(INTERVAL '1 day', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE ts < (SELECT time_bucket(INTERVAL '1 day', max(ts) - INTERVAL '1 day') FROM events) GROUP BY ALL""")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Days that the watermark has closed."""
    out = streams.drain(streams.tumbling(streams.event_stream(spark, f"{sf}/events.parquet"), "ts", "1 day", "event_type"), name="tumbling")
    return out.select(F.unix_micros("window_start").alias("start_us"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""WITH w AS (SELECT epoch_us(time_bucket(INTERVAL '6 hours', ts)) - 6 * 3600000000 * k AS start_us, value, ts FROM events, (VALUES (0), (1), (2), (3)) v(k))
SELECT start_us, count(*) AS n, round(sum(value), 2) AS total FROM w WHERE start_us + 86400000000 <= (SELECT epoch_us(max(ts)) - 86400000000 FROM events) GROUP BY start_us""")
def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    out = streams.drain(streams.sliding(streams.event_stream(spark, f"{sf}/events.parquet"), "ts", "1 day", "6 hours"), name="sliding")
    return out.select(F.unix_micros("window_start").alias("start_us"), "n", F.round("total", 2).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '12 hours' THEN 0 ELSE 1 END AS fresh, event_id FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, k HAVING epoch_us(max(ts)) + 43200000000 <= (SELECT epoch_us(max(ts)) - 86400000000 FROM events)""")
def stream_session(spark: SparkSession, sf: str) -> DataFrame:
    out = streams.drain(streams.sessions(streams.event_stream(spark, f"{sf}/events.parquet"), "ts", "12 hours", "user_id"), name="session")
    return out.select("user_id", F.unix_micros("window_start").alias("start_us"), "n", F.round("total", 2).alias("total"))


@query("""SELECT DISTINCT user_id, event_type FROM events""")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Each user and kind once, as the sink writes them: days of events in six files, a batch each."""
    root = f"{graph.shared_folder(spark)}/dedup-{uuid.uuid4().hex}"
    load(spark, sf, "events").repartition(6, "event_id").write.parquet(f"{root}/in")
    streams.write_once(streams.event_stream(spark, f"{root}/in", 1), f"{root}/out", f"{root}/mark", "user_id", "event_type").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("user_id", "event_type")


@query("""WITH o AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL '2 hours' THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM o)
SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, epoch_us(max(ts)) AS last_us, count(*) AS changes FROM b GROUP BY user_id, burst HAVING max(ts) + INTERVAL '2 hours' <= (SELECT max(ts) - INTERVAL '1 day' FROM events)""")
def stream_debounce(spark: SparkSession, sf: str) -> DataFrame:
    """Bursts of a user's events that ended by a pause of two hours, each with its last operation."""
    out = streams.drain(streams.debounced(streams.event_stream(spark, f"{sf}/events.parquet"), ("user_id",), "event_type", "ts", "event_id", "2 hours"), name="debounce")
    return out.select("user_id", "event_type", F.unix_micros("ts").alias("last_us"), "changes")


@query("""WITH p AS (SELECT poll, CAST(c_nationkey % 3 AS VARCHAR) AS project, c_nationkey AS tag, CAST(max(c_custkey) AS VARCHAR) AS sha FROM customer, (VALUES (0), (1), (2)) v(poll) WHERE c_custkey % 3 <= poll AND (c_nationkey + poll) % 5 <> 0 GROUP BY poll, c_nationkey),
l AS (SELECT *, lag(sha) OVER w AS before, lag(poll) OVER w AS last FROM p WINDOW w AS (PARTITION BY project, tag ORDER BY poll))
SELECT project, CAST(tag AS VARCHAR) AS tag, CASE WHEN last IS NULL OR poll > last + 1 THEN 'created' ELSE 'moved' END AS kind, sha, CASE WHEN poll = last + 1 THEN before END AS previous, CAST(poll AS BIGINT) AS poll FROM l WHERE last IS NULL OR poll > last + 1 OR sha <> before""")
def stream_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Three polls of tags (nations, at the newest customer a poll knows), a file and a batch each; some vanish and come back."""
    root = f"{graph.shared_folder(spark)}/tags-{uuid.uuid4().hex}"
    for poll in range(3):
        seen = load(spark, sf, "customer").where(f"c_custkey % 3 <= {poll} and (c_nationkey + {poll}) % 5 <> 0").groupBy("c_nationkey").agg(F.max("c_custkey").cast("string").alias("sha"))
        rows = seen.select((F.col("c_nationkey") % 3).cast("string").alias("project"), F.lit(poll).cast("long").alias("poll"), F.col("c_nationkey").cast("string").alias("tag"), "sha")
        rows.coalesce(1).write.mode("append").parquet(f"{root}/in")
    return streams.drain(streams.tag_events(streams.event_stream(spark, f"{root}/in", 1)), name="tags")


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, epoch_us(max(ts)) AS last_us FROM events GROUP BY user_id""")
def debounce_last_op(spark: SparkSession, sf: str) -> DataFrame:
    return streams.last_operations(load(spark, sf, "events"), ("user_id",), "event_type", "ts", "event_id").select("user_id", "event_type", F.unix_micros("ts").alias("last_us"))
