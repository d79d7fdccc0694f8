"""The symbol timeline: snapshot diffs, net effects, removed and changed symbols, renames, retention, snapshots."""

from __future__ import annotations

import difflib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import hashing
from .graph import kept

RENAME_THRESHOLD = 0.85


def snapshot_diff(prev: DataFrame, curr: DataFrame, key: str = "symbol_id", content: str = "content_hash", path: str = "file_path") -> DataFrame:
    """key, change: added, removed, moved (same content elsewhere) or modified; unchanged rows are left out."""
    a = prev.select(F.col(key), F.col(content).alias("c0"), F.col(path).alias("p0"), F.lit(True).alias("in0"))
    b = curr.select(F.col(key), F.col(content).alias("c1"), F.col(path).alias("p1"), F.lit(True).alias("in1"))
    same = F.col("c0").eqNullSafe(F.col("c1"))
    change = F.when(F.col("in0").isNull(), "added").when(F.col("in1").isNull(), "removed").when(same & F.col("p0").eqNullSafe(F.col("p1")), None).when(same, "moved").otherwise("modified")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change is not null")


def latest(events: DataFrame, key: str, ts: str, id_: str, *columns: str) -> DataFrame:
    """The columns of the last event of each key; a partial maximum before the shuffle, no window."""
    last = F.max_by(F.struct(*columns), F.struct(ts, id_))
    return events.groupBy(key).agg(last.alias("x")).select(key, *(f"x.{c}" for c in columns))


def latest_known(events: DataFrame, key: str, ts: str, id_: str, *columns: str) -> DataFrame:
    """Of each column the last value that is not null, independently."""
    return events.groupBy(key).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(ts, id_))).alias(c) for c in columns))


def net_effect(events: DataFrame, key: str, kind: str, ts: str, id_: str) -> DataFrame:
    """key, effect: removed if the last event removes, else added if the first one adds, else modified."""
    place = F.struct(ts, id_)
    ends = events.groupBy(key).agg(F.min_by(kind, place).alias("first"), F.max_by(kind, place).alias("last"))
    return ends.select(key, F.when(F.col("last") == "removed", "removed").when(F.col("first") == "added", "added").otherwise("modified").alias("effect"))


def ranked_buckets(rows: DataFrame, bucket: str, importance: str, ts: str, key: str, k: int) -> DataFrame:
    """The best k of each bucket by importance and recency, with the bucket's size and whether it was cut."""
    order = Window.partitionBy(bucket).orderBy(F.desc(importance), F.desc(ts), key)
    totals = rows.groupBy(bucket).agg(F.count("*").alias("total_before_limit"))  # a row for each of four buckets
    top = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return top.join(F.broadcast(totals), bucket).withColumn("truncated", F.col("total_before_limit") > k).drop("r")


def removed_since(events: DataFrame, reachable: DataFrame, renames: DataFrame, since: Column, k: int, importance: DataFrame | None = None) -> DataFrame:
    """Symbols whose last event after `since`, on a reachable commit, removes them, without confirmed renames."""
    open_ = events.where((F.col("timestamp") > since) & ~F.coalesce("orphaned", F.lit(False))).join(reachable, "commit_sha", "left_semi")
    last = latest(open_, "symbol_id", "timestamp", "id", "event_type", "timestamp", "qualified_name", "file_path").where("event_type = 'removed'")
    gone = last.join(renames.where(~F.col("is_candidate")).select(F.col("old_symbol_id").alias("symbol_id")), "symbol_id", "left_anti")
    scored = gone.join(importance, "symbol_id", "left") if importance is not None else gone.withColumn("importance", F.lit(None).cast("double"))
    ranked = scored.withColumn("importance", F.coalesce("importance", F.lit(0.0))).withColumn("bucket", F.lit("removed"))
    return ranked_buckets(ranked, "bucket", "importance", "timestamp", "symbol_id", k)


def diff(events: DataFrame, commits: DataFrame, renames: DataFrame, from_ts: Column, to_ts: Column, k: int) -> DataFrame:
    """effect, symbol_id, timestamp and bucket totals: the net effect of the events between two references."""
    open_ = events.where((F.col("timestamp") > from_ts) & (F.col("timestamp") <= to_ts)).join(commits, "commit_sha", "left_semi")
    effect = net_effect(open_, "symbol_id", "event_type", "timestamp", "id").join(open_.groupBy("symbol_id").agg(F.max("timestamp").alias("timestamp")), "symbol_id")
    confirmed = renames.where(~F.col("is_candidate"))
    hidden = confirmed.select(F.col("old_symbol_id").alias("symbol_id")).union(confirmed.select("new_symbol_id"))
    rows = effect.join(hidden, "symbol_id", "left_anti").withColumn("importance", F.lit(0.0))
    return ranked_buckets(rows, "effect", "importance", "timestamp", "symbol_id", k)


def fuzzy_symbols(events: DataFrame, key: str, name: str, ts: str, part: str, k: int) -> DataFrame:
    """Symbols whose name contains a part in any letter case, the most recent first."""
    return events.where(F.contains(F.lower(name), F.lit(part.lower()))).groupBy(key).agg(F.max(ts).alias("last_ts"), F.max(name).alias("name")).orderBy(F.desc("last_ts"), key).limit(k)


def history(events: DataFrame, key: str, value: object, ts: str, id_: str) -> DataFrame:
    return events.where(F.col(key) == F.lit(value)).orderBy(ts, id_)


@F.pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of matching characters as Python's difflib defines it (which is not the edit distance)."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else 0.0 for x, y in zip(a, b)])


GRAM = 2
BROADCAST_GRAMS = 100_000  # rows of gram frequencies that may be broadcast


def least_shared(total: int, threshold: float) -> int:
    """How many bigrams two names of together `total` letters have in common at least if their ratio reaches the threshold.

    The matching characters, threshold / 2 of all, lie in at most one run more than there are others; each run of n has n - 1 bigrams.
    """
    matched = math.ceil(threshold / 2 * total - 1e-9)
    return matched - (total - 2 * matched + 1)


def _shared(total: Column, threshold: float) -> Column:
    matched = F.ceil(F.lit(threshold / 2) * total - 1e-9)
    return matched - (total - 2 * matched + 1)


def _near_names(removed: DataFrame, added: DataFrame, threshold: float) -> DataFrame:
    """block, removed_id, added_id, ratio of pairs whose last names are different and have a ratio of the threshold or more.

    A name's bigrams (repeats numbered) are ordered by rarity over all names. Two names that must share at least s of them
    share one among the first n - s + 1 of either, so only those are keys: what most names begin with is none. Pairs meet if
    their lengths allow the ratio and the places of the common bigram leave room for s; what is left is measured.
    """
    if any(least_shared(t, threshold) < 1 for t in range(2, 200) if 2 * math.ceil(threshold / 2 * t - 1e-9) < t):  # others are equal names
        raise ValueError("names below this threshold may share no bigram")

    def grams(df: DataFrame, side: str) -> DataFrame:
        leaf = F.col(f"{side}_leaf")
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(leaf) - 1, F.lit(1))), lambda i: F.substring(leaf, i, F.lit(GRAM)))
        named = df.where(F.length(leaf) >= GRAM).select("block", F.col(f"{side}_id").alias("id"), leaf.alias("leaf"), F.posexplode(cut).alias("at", "gram"))
        place = Window.partitionBy("block", "id", "gram").orderBy("at")  # within one name
        return named.withColumn("gram", F.concat("gram", F.row_number().over(place).cast("string"))).drop("at").withColumn("side", F.lit(side))

    rows = grams(removed, "removed").unionByName(grams(added, "added"))
    counts = rows.groupBy("gram").agg(F.count("*").alias("names"))
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_GRAMS else counts
    n = F.length("leaf")
    partners = F.sequence(F.ceil(n * threshold / (2 - threshold) - 1e-9), F.floor(n * (2 - threshold) / threshold + 1e-9))
    least = F.array_min(F.transform(partners, lambda m: _shared(n + m, threshold)))
    placed = rows.join(counts, "gram").withColumn("place", F.row_number().over(Window.partitionBy("side", "block", "id").orderBy("names", "gram")))
    keys = placed.where(F.col("place") <= n - 1 - F.greatest(least, F.lit(1)) + 1)
    side = lambda name: keys.where(F.col("side") == name).select("block", "gram", F.col("id").alias(f"{name}_id"), F.col("leaf").alias(f"{name}_leaf"), F.col("place").alias(f"{name}_place"))
    a, b = F.length("removed_leaf"), F.length("added_leaf")
    fits = F.least(a, b) >= F.ceil(F.lit(threshold / 2) * (a + b) - 1e-9)
    room = 1 + F.least(a - 1 - F.col("removed_place"), b - 1 - F.col("added_place")) >= _shared(a + b, threshold)
    met = side("removed").join(side("added"), ["block", "gram"]).where((F.col("removed_leaf") != F.col("added_leaf")) & fits & room)
    pairs = met.select("block", "removed_id", "added_id", "removed_leaf", "added_leaf").distinct()
    return pairs.withColumn("ratio", name_ratio("removed_leaf", "added_leaf")).where(F.col("ratio") >= threshold).select("block", "removed_id", "added_id", "ratio")


def _candidates(removed: DataFrame, added: DataFrame, threshold: float) -> DataFrame:
    """removed_id, ratio, added_id: for each removed symbol the best added one that is not consumed, and the best of the consumed ones.

    removed: block, removed_id, removed_leaf; added: block, added_id, added_leaf, consumed_by. Only names meet, each once in
    a block, however many symbols bear it. An added symbol that is not consumed suits all removed ones of a name alike, so the
    smallest stands for all. One that is consumed suits those of smaller ids than its consumer's: sorted by id with the removed
    ones, the best of what comes later is a running minimum, made in ranges, so that no task sees a whole name.
    """
    added = added.where("added_id is not null")
    old = removed.where("removed_leaf is not null").select("block", "removed_leaf").distinct()
    new = added.where("added_leaf is not null").select("block", "added_leaf").distinct()
    equal = old.join(new.withColumnRenamed("added_leaf", "removed_leaf"), ["block", "removed_leaf"]).select("block", "removed_leaf", F.col("removed_leaf").alias("added_leaf"), F.lit(0.9).alias("ratio"))
    near = _near_names(old.withColumn("removed_id", F.col("removed_leaf")), new.withColumn("added_id", F.col("added_leaf")), threshold)
    near = near.select("block", F.col("removed_id").alias("removed_leaf"), F.col("added_id").alias("added_leaf"), "ratio")
    names = kept(equal.unionByName(near).where(F.col("ratio") >= threshold), "rename-names")
    best = F.min(F.struct((-F.col("ratio")).alias("less"), "added_id"))
    free = added.where("consumed_by is null").groupBy("block", "added_leaf").agg(F.min("added_id").alias("added_id"))
    firsts = free.join(names, ["block", "added_leaf"]).groupBy("block", "removed_leaf").agg(best.alias("best"))
    open_ = removed.join(firsts, ["block", "removed_leaf"]).select("removed_id", "best")
    taken = added.where("consumed_by is not null").join(names, ["block", "added_leaf"]).groupBy("block", "removed_leaf", F.col("consumed_by").alias("place")).agg(best.alias("own"))
    taken = kept(taken, "rename-taken")
    asking = removed.join(taken.select("block", "removed_leaf").distinct(), ["block", "removed_leaf"], "left_semi").where("removed_id is not null")
    rows = taken.withColumn("asks", F.lit(False)).unionByName(asking.select("block", "removed_leaf", F.col("removed_id").alias("place"), F.lit(True).alias("asks")), allowMissingColumns=True)
    order = [F.col("block"), F.col("removed_leaf"), F.desc("place"), F.desc("asks")]  # who asks comes before what its own id consumed
    ranged = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "rename-ranges")
    running = Window.partitionBy("block", "removed_leaf", "part").orderBy(F.desc("place"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("block", "removed_leaf").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranged.groupBy("block", "removed_leaf", "part").agg(F.min("own").alias("own")).select("block", "removed_leaf", "part", F.min("own").over(before).alias("carried"))
    met = ranged.withColumn("so_far", F.min("own").over(running)).where("asks").join(carried, ["block", "removed_leaf", "part"])
    consumed = met.select(F.col("place").alias("removed_id"), F.least("so_far", "carried").alias("best")).where("best is not null")
    return open_.unionByName(consumed).select("removed_id", (-F.col("best.less")).alias("ratio"), "best.added_id")


def rename_pairs(events: DataFrame, block: str, threshold: float = RENAME_THRESHOLD) -> DataFrame:
    """removed_id, added_id, confidence, is_candidate: the best added symbol for each removed one within a block (a project's scan).

    Equal content is 1.0, equal last names are 0.9, else the ratio of matching characters of the last names. Removed and
    added symbols are taken in the order of their ids: the n-th removed with some content takes the n-th added with it, and
    such a pair is confirmed and its added side gone for all later ones. Others are candidates and consume nothing; of equal
    confidence the smaller added id counts. Events without a qualified name pair by content only; null hashes are unequal.
    """
    def side(kind: str, prefix: str) -> DataFrame:
        leaf = F.element_at(F.split("qualified_name", r"\."), -1)
        return events.where(F.col("event_type") == kind).select(F.col(block).alias("block"), F.col("symbol_id").alias(f"{prefix}_id"), F.nullif("content_hash", F.lit("")).alias(f"{prefix}_hash"), leaf.alias(f"{prefix}_leaf"))

    removed, added = side("removed", "removed"), side("added", "added")
    place = lambda df, x: df.where(F.col(f"{x}_hash").isNotNull()).withColumn("place", F.row_number().over(Window.partitionBy("block", f"{x}_hash").orderBy(f"{x}_id"))).withColumnRenamed(f"{x}_hash", "hash")
    one = place(removed, "removed").join(place(added, "added"), ["block", "hash", "place"]).select("removed_id", "added_id")
    left = kept(removed.join(one.select("removed_id"), "removed_id", "left_anti").select("block", "removed_id", "removed_leaf"), "rename-left")
    right = kept(added.join(one.select("added_id", F.col("removed_id").alias("consumed_by")), "added_id", "left").select("block", "added_id", "added_leaf", "consumed_by"), "rename-right")
    best = _candidates(left, right, threshold).groupBy("removed_id").agg(F.max("ratio").alias("confidence"), F.min_by("added_id", F.struct(-F.col("ratio"), F.col("added_id"))).alias("added_id"))
    return one.select("removed_id", "added_id", F.lit(1.0).alias("confidence"), F.lit(False).alias("is_candidate")).unionByName(best.select("removed_id", "added_id", "confidence", F.lit(True).alias("is_candidate")))


def reconcile(events: DataFrame, commits: DataFrame | None) -> DataFrame:
    """Adds orphaned: whether the event's commit is none of the known ones (events without a commit never are). Without a
    list of commits, because git cannot tell, events stay as they are."""
    if commits is None:
        return events
    known = commits.select("commit_sha").distinct().withColumn("siltstone_known", F.lit(True))
    flag = F.col("commit_sha").isNotNull() & F.col("siltstone_known").isNull()
    return events.drop("orphaned").join(known, "commit_sha", "left").withColumn("orphaned", flag).drop("siltstone_known")


def release_snapshot(symbols: DataFrame, group: str, symbol_id: str, root: str, sha: str) -> DataFrame:
    """group, snapshot_id, symbol_count, checksum of the symbols of each tag."""
    sums = symbols.groupBy(F.col(group)).agg(F.count("*").alias("symbol_count"), hashing.checksum(F.collect_set(F.col(symbol_id).cast("string"))).alias("checksum"))
    return sums.select(group, hashing.snapshot_id(F.lit(root), F.col(group).cast("string"), F.lit(sha)).alias("snapshot_id"), "symbol_count", "checksum")


def tag_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """tag, change (created, moved, deleted) between two (tag, sha) tables."""
    both = before.select("tag", F.col("sha").alias("s0")).join(after.select("tag", F.col("sha").alias("s1")), "tag", "full")
    return both.select("tag", F.when(F.col("s0").isNull(), "created").when(F.col("s1").isNull(), "deleted").when(F.col("s0") != F.col("s1"), "moved").alias("change")).where("change is not null")


def keep_newest(rows: DataFrame, group: str, ts: str, id_: str, n: int, oldest: Column | None = None) -> DataFrame:
    """The newest n rows of each group, none older than `oldest`."""
    rows = rows if oldest is None else rows.where(F.col(ts) >= oldest)
    return rows.withColumn("siltstone_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(ts), F.desc(id_)))).where(F.col("siltstone_r") <= n).drop("siltstone_r")


# Patterns that make a query one about history, by kind.
MARKERS = {
    "removed_since": (r"\bremov(?:ed|al)\b", r"\bdelet(?:ed|ion)\b", r"\bgone\s+since\b", r"\bmissing\s+since\b", r"\bудал", r"\bпропа[лд]"),
    "diff": (r"\bbetween\s+\S+\s+and\s+\S+\b", r"\bdiff\b", r"\bchanged\s+between\b", r"\bрегресс", r"\bмежду\s+\S+\s+и\s+\S+\b"),
    "symbol_history": (r"\bwhen\s+was\b", r"\bhistory\s+of\b", r"\brenamed\s+(?:from|to)\b", r"\bпереимен", r"\bкогда\s+(?:был|была|добавил|удалил)", r"\bистори[яюи]\s+"),
}
# What names a commit or tag, and what names a symbol, in a query.
REFERENCE = r"\b(?:HEAD(?:~\d+)?|v\d+(?:\.\d+){0,3}(?:-[A-Za-z0-9]+)?|[0-9a-f]{7,40})\b"
DOTTED_NAME = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*){1,}"


def history_markers(query: Column) -> Column:
    """The kinds of history question a query asks, in a fixed order."""
    return F.array_compact(F.array(*(F.when(query.rlike("(?iuU)" + "|".join(f"(?:{p})" for p in patterns)), kind) for kind, patterns in MARKERS.items())))


def history_references(query: Column) -> Column:
    """Commits and tags named in a query about history, each once, in order; none for other queries."""
    return _named(query, REFERENCE)


def history_symbols(query: Column) -> Column:
    """Dotted names in a query about history, each once, in order; none for other queries."""
    return _named(query, DOTTED_NAME)


def _named(query: Column, pattern: str) -> Column:
    return F.when(F.size(history_markers(query)) > 0, F.array_distinct(F.regexp_extract_all(query, F.lit(pattern), F.lit(0)))).otherwise(F.array().cast("array<string>"))


# --- events between references ------------------------------------------------------------------------------------


def events_between(events: DataFrame, start: Column, end: Column, kinds: tuple[str, ...] = (), orphaned: bool = False) -> DataFrame:
    """Events of a closed interval, of some kinds (or all), without orphaned ones unless asked for, by time and id."""
    out = events.where(F.col("timestamp").between(start, end))
    out = out.where(F.col("event_type").isin(*kinds)) if kinds else out
    return (out if orphaned else out.where(~F.coalesce("orphaned", F.lit(False)))).orderBy("timestamp", "id")


def is_symbol_id(value: Column) -> Column:
    return value.rlike("^[0-9a-fA-F]{32}$")


def in_scope(path: Column, module: str) -> Column:
    """The module itself or anything below it."""
    return (path == module) | path.startswith(module.rstrip("/") + "/")


def regressions(events: DataFrame, commits: DataFrame, renames: DataFrame, from_ts: Column, to_ts: Column) -> DataFrame:
    """symbol_id of all symbols whose net effect between two references is a removal, without confirmed renames."""
    open_ = events.where((F.col("timestamp") > from_ts) & (F.col("timestamp") <= to_ts)).join(commits, "commit_sha", "left_semi")
    gone = net_effect(open_, "symbol_id", "event_type", "timestamp", "id").where("effect = 'removed'")
    confirmed = renames.where(~F.col("is_candidate"))
    return gone.join(confirmed.select(F.col("old_symbol_id").alias("symbol_id")).union(confirmed.select("new_symbol_id")), "symbol_id", "left_anti").select("symbol_id")


def with_rename_names(renames: DataFrame, events: DataFrame) -> DataFrame:
    """Rename edges with old_name and new_name, the last known names of both symbols (null where none is known)."""
    names = latest_known(events, "symbol_id", "timestamp", "id", "qualified_name")
    out = renames
    for end in ("old", "new"):
        out = out.join(names.select(F.col("symbol_id").alias(f"{end}_symbol_id"), F.col("qualified_name").alias(f"{end}_name")), f"{end}_symbol_id", "left")
    return out


def when(events: DataFrame, renames: DataFrame, symbol: str, limit: int = 10) -> tuple[str | None, DataFrame, DataFrame, DataFrame]:
    """(symbol_id, its events, its renames with names, candidates) of an id or of a part of one name.

    A part that fits several symbols gives no id and the candidates, the most recent first; one that fits none gives
    neither.
    """
    found = fuzzy_symbols(events, "symbol_id", "qualified_name", "timestamp", symbol, limit)
    known = events.where(F.col("symbol_id") == symbol).limit(1).count() if len(symbol) == 32 and all(c in "0123456789abcdefABCDEF" for c in symbol) else 0
    ids = [symbol] if known else [r["symbol_id"] for r in found.select("symbol_id").collect()]  # at most `limit`
    one = ids[0] if len(ids) == 1 else None
    own = events.where(F.col("symbol_id") == F.lit(one)).orderBy("timestamp", "id")
    edges = renames.where((F.col("old_symbol_id") == F.lit(one)) | (F.col("new_symbol_id") == F.lit(one)))
    direction = F.when(F.col("new_symbol_id") == F.lit(one), "predecessor").otherwise("successor")
    return one, own, with_rename_names(edges, events).withColumn("direction", direction), found if one is None else found.limit(0)


# --- scans: snapshots, emission, retention ------------------------------------------------------------------------


def snapshot(symbols: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """symbol_id, file_path, qualified_name, content_hash of the symbols of a scan.

    symbols: fq_name, symbol_type, file_path, start_line, end_line; files: path, text. A symbol's body is its lines with
    their endings; without a file it has no hash.
    """
    body = F.array_join(F.slice(F.split("text", r"(?<=\n)"), F.greatest("start_line", F.lit(1)), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "")
    rows = symbols.join(files.select(F.col("path").alias("file_path"), "text"), "file_path", "left")
    return rows.select(
        hashing.symbol_id(F.lit(root), F.col("file_path"), F.col("fq_name"), F.col("symbol_type")).alias("symbol_id"), "file_path", F.col("fq_name").alias("qualified_name"),
        F.when(F.col("text").isNotNull(), hashing.symbol_content_hash(F.col("fq_name"), body)).alias("content_hash"),
    )


def emitted(prev: DataFrame, curr: DataFrame, root: str, timestamp: float, commit: str | None = None, author: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, rename edges) of a scan: the difference of two snapshots, renames paired; confirmed ones lose their two events."""
    facts = curr.withColumn("now", F.lit(1)).unionByName(prev.withColumn("now", F.lit(0))).groupBy("symbol_id").agg(F.max_by(F.struct("content_hash", "file_path", "qualified_name"), "now").alias("x"))
    events = snapshot_diff(prev, curr).withColumnRenamed("change", "event_type").join(facts.select("symbol_id", "x.*"), "symbol_id")
    events = events.withColumns({"project_root": F.lit(root), "commit_sha": F.lit(commit).cast("string"), "timestamp": F.lit(float(timestamp)), "author": F.lit(author).cast("string"), "orphaned": F.lit(False)})
    pairs = rename_pairs(events, "project_root")
    sure = pairs.where(~F.col("is_candidate"))
    kept_events = events.join(sure.select(F.col("removed_id").alias("symbol_id")).union(sure.select("added_id")), "symbol_id", "left_anti")
    edges = pairs.select(F.lit(root).alias("project_root"), F.col("removed_id").alias("old_symbol_id"), F.col("added_id").alias("new_symbol_id"), F.lit(commit).cast("string").alias("commit_sha"), F.lit(float(timestamp)).alias("timestamp"), "confidence", "is_candidate")
    return kept_events, edges


def pruned(events: DataFrame, root: str, older_than: Column, only_orphaned: bool = False) -> DataFrame:
    """What a hard prune of a project's events leaves."""
    old = (F.col("project_root") == root) & (F.col("timestamp") < older_than)
    return events.where(~(old & F.coalesce("orphaned", F.lit(False))) if only_orphaned else ~old)


def reconcile_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """event_type, n: events that became orphaned."""
    fresh = after.where("orphaned").join(before.where(F.coalesce("orphaned", F.lit(False))).select("id"), "id", "left_anti")
    return fresh.groupBy("event_type").agg(F.count("*").alias("n"))


def status(events: DataFrame) -> DataFrame:
    """project_root, event_type, n, orphaned, last: what the timeline holds, with a row over all types (event_type null)."""
    sums = [F.count("*").alias("n"), F.count_if(F.coalesce("orphaned", F.lit(False))).alias("orphaned"), F.max("timestamp").alias("last")]
    return events.groupBy("project_root", "event_type").agg(*sums).unionByName(events.groupBy("project_root").agg(*sums).withColumn("event_type", F.lit(None).cast("string")))


def invalidate_tag(snapshots: DataFrame, tag: str, sha: str) -> DataFrame:
    """Snapshots after a tag has moved: those of the tag at another commit are marked."""
    stale = (F.col("tag") == tag) & (F.col("head_sha") != sha)
    return snapshots.withColumn("tag_invalidated", F.coalesce("tag_invalidated", F.lit(False)) | stale)


def latest_snapshot(snapshots: DataFrame, root: str, tag: str | None = None) -> DataFrame:
    """The newest valid snapshot of a project (or of a tag of it)."""
    own = snapshots.where((F.col("project_root") == root) & ~F.coalesce("tag_invalidated", F.lit(False)))
    return (own if tag is None else own.where(F.col("tag") == tag)).orderBy(F.desc("timestamp"), "snapshot_id").limit(1)
