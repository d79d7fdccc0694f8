"""Exact Jaccard self-join on word shingles with token-combination prefixes, and the groups its links make.

Two documents link when 100 * |x & y| >= percent * |x | y|. Documents with the same set are one class, known by a hash
of the set; the join runs over classes.

Tokens (shingle hashes) are ordered: rare ones first, frequent ones last, by hash within. A set's index rows are

- single tokens for rare ones: linked sets share their smallest common token within the first n - ceil(percent n / 100) + 1
  tokens of both, so if that token is rare, both have it in the index;
- combinations of k tokens for frequent ones: else all common tokens are frequent, and a set with more rare tokens than
  that prefix needs none. Linked sets differ in at most D tokens. The merged frequent tokens of both, cut into D + 1 blocks
  of k, hold one block without a difference: k tokens that follow one another in both sets, within the first k (D + 1) of
  each. So the prefix is extended to k (D + 1) tokens and the runs of k in it are the keys: their number is linear in the
  set. k is 4 where the frequent tokens are enough for D + 1 blocks of 4 and goes down to 1 for the smallest sets; a set
  near such a bound has keys for both. A set's own rare tokens count against D, as no linked set has them here.

Frequent are the tokens of CROWD classes or more, counted over the whole table (as 32 + b bit slots in 2**b buckets, so that
a bucket stays small); any fixed set keeps the join exact, so slots may collide, and at most MOST_FREQUENT of them, those
with the highest counts, are kept as a bit map, whose broadcast therefore does not grow.

Every index row carries what bounds the difference of a pair from below without a look at the texts: the tokens known
not to be common, the place in the order, and the number of tokens after. Links are found without pairing a group with itself:

1. star: in each posting list every class is paired with the list's centre only, the one with the fewest rare tokens; the
   links found make components;
2. rest: in lists with several components, the classes outside the centre's component meet those of other components, as far
   as the bounds allow.

A pair is then held against the parities of its sets by hash slot (two sets differ in at least as many tokens as their
parities differ) and, if still open, judged on the whole sets, made again from the texts. A centre's set travels once for
every SALT of its pairs, not with each of them.

Defined results: a text with fewer words than k is one shingle; null texts and texts without words have empty sets,
link with nothing and are their own component; repeated rows and doc_ids are kept, and rows with a null doc_id take part in
links; a component is named by the smallest doc_id in it (null if all are); an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

CROWD = 30  # classes that make a token frequent
MOST_FREQUENT = 1 << 21
MOST_K = 4
FLUSH_TOKENS = 1 << 19  # counted together in a task
BUCKET_TOKENS = 1 << 20  # counted together after the shuffle
NARROW, WIDE = 9, 12  # bits of a hash slot; sets of more than LARGE tokens have both kinds of parities
LARGE = 1200
SALT = 64
_ODD = np.uint64(1)  # set in the keys of combinations, clear in tokens


def overlap_needed(n, percent: int):
    return (percent * n + 99) // 100


def linkable(n: int, percent: int) -> bool:
    """Whether a set of n tokens can link with another one than itself."""
    return 100 * n >= percent * (n + 1)


def sets_of(buf: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; all runs of the block are hashed at once, those across texts unused."""
    starts, ends, at = common.word_spans(buf, off)
    words = common.word_hashes(buf, starts, ends)
    runs = common.shingle_hashes(words, k) & ~_ODD if len(words) >= k else words
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        else:
            yield common.shingle_hashes(words[a:b], k) & ~_ODD


def signature(tokens: np.ndarray) -> int:
    """A hash of a set, as a signed 64-bit number."""
    total = common.mix(tokens * common.BASE).sum(dtype=np.uint64)
    return int(common.signed(common.mix(np.array([total ^ np.uint64(len(tokens))], np.uint64)))[0])


def parities(tokens: np.ndarray) -> np.ndarray:
    """For each hash slot whether an odd number of tokens falls into it, as 64-bit words: narrow ones, for large sets then wide ones."""
    out = []
    for bits in (NARROW, WIDE) if len(tokens) > LARGE else (NARROW,):
        odd = np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8"))
    return np.concatenate(out)


def survey(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, class, n (tokens of the set) and parity of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, buf, off in common.blocks(batch, "text"):
                sets = list(sets_of(buf, off, k))
                words = [parities(s) for s in sets]
                ends = pa.array(np.cumsum([0, *map(len, words)]).astype(np.int32))
                columns = [block.column("doc_id"), pa.array([signature(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(words)))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "class", "n", "parity"])

    return docs.mapInArrow(run, "doc_id long, class long, n long, parity array<long>")


def _chosen_sets(batches: Iterator[pa.RecordBatch], only, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(class, set) of the documents whose id the bit map `only` lets through, or which have none; a task gives each class once."""
    seen: set[int] = set()
    for batch in batches:
        ids = batch.column("doc_id")
        batch = batch.filter(pa.array(common.lets_through(only.value, common.ints(ids)) | ids.is_null().to_numpy(zero_copy_only=False)))
        for _, buf, off in common.blocks(batch, "text"):
            for s in sets_of(buf, off, k):
                c = signature(s)
                if len(s) and c not in seen:
                    seen.add(c)
                    yield c, s


# --- counting in slots --------------------------------------------------------------------------------------------


def slot_shift(total: int) -> int:
    """By how many bits a 64-bit number is shifted to give its slot, for `total` numbers: 32 bits in 2**b buckets, none of them large."""
    return 32 - max(0, (total // BUCKET_TOKENS).bit_length())


def slot_counts(rows: DataFrame, shift: int, least: int, numbers: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]) -> DataFrame:
    """slot, n of the slots that occur `least` times or more; numbers: makes arrays of unsigned 64-bit numbers from a task's rows.

    A task sorts what it has and deals it out by bucket, four bytes for a slot; a bucket is sorted and counted whole.
    """

    def pieces(flat: np.ndarray) -> pa.RecordBatch:
        slots, n = np.unique(flat >> np.uint64(shift), return_counts=True)
        bucket, low, n = (slots >> np.uint64(32)).astype(np.int64), (slots & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.minimum(n, 0xFFFF).astype(np.uint16)
        rows = []
        for b, start, end in _groups_of(bucket):
            once = n[start:end] == 1
            rows.append((b, low[start:end][once].tobytes(), low[start:end][~once].tobytes(), n[start:end][~once].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "once", "more", "times"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for x in numbers(batches):
            held.append(x)
            size += len(x)
            if size >= FLUSH_TOKENS:
                yield pieces(np.concatenate(held))
                held, size = [], 0
        if size:
            yield pieces(np.concatenate(held))

    def total_of(bucket: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        low, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(low)
        low, n = low[order], n[order]
        first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        sums = np.add.reduceat(n.astype(np.int64), first)
        many = sums >= least
        return pa.RecordBatch.from_arrays([pa.array((bucket << 32) + low[first][many].astype(np.int64)), pa.array(sums[many])], ["slot", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, once, more, times in zip(*(batch.column(c).to_pylist() for c in ("bucket", "once", "more", "times"))):
                if held and bucket != now:
                    yield total_of(now, held)
                    held = []
                now = bucket
                ones = np.frombuffer(once, np.uint32)
                held += [(ones, np.ones(len(ones), np.uint16)), (np.frombuffer(more, np.uint32), np.frombuffer(times, np.uint16))]
        if held:
            yield total_of(now, held)

    dealt = rows.mapInArrow(deal, "bucket long, once binary, more binary, times binary").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(count, "slot long, n long")


def in_slots(rows: DataFrame, bits, shift: int) -> DataFrame:
    """The rows whose key lies in a slot that the bit map lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = common.ints(batch.column("key")).view(np.uint64) >> np.uint64(shift)
            yield batch.filter(pa.array(common.lets_through(bits.value, slots.view(np.int64))))

    return rows.mapInArrow(run, rows.schema)


def frequent_tokens(docs: DataFrame, only, total: int, k: int, percent: int):
    """(bit map of the slots of frequent tokens, bits that a token is shifted by to give its slot)."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, s in _chosen_sets(batches, only, k):
            if linkable(len(s), percent):
                yield s

    shift = slot_shift(total)
    found = common.stored(slot_counts(docs, shift, CROWD, tokens), "jaccard-frequent")
    if found.count() > MOST_FREQUENT:
        above = sum_above(found.groupBy("n").agg(F.count("*").alias("slots")), MOST_FREQUENT)
        found = found.where(F.col("n") > above)
    return common.bit_map(found.select("slot")), shift


def sum_above(counts: DataFrame, most: int) -> int:
    """The smallest n such that at most `most` slots have more; counts are (n, slots), few rows."""
    left, bound = most, 0
    for r in counts.orderBy(F.desc("n")).toLocalIterator():
        left, bound = left - r["slots"], r["n"]
        if left < 0:
            return bound
    return 0


def shared_keys(rows: DataFrame):
    """(bit map of the slots of keys with more than one index row, shift): most keys have one, and are dropped with it where they are read."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield common.ints(batch.column("key")).view(np.uint64)

    shift = slot_shift(rows.count())
    return common.bit_map(common.stored(slot_counts(rows.select("key"), shift, 2, keys), "jaccard-shared").select("slot")), shift


def _groups_of(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of the runs of equal values."""
    cuts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(values)]):
        yield int(values[a]), a, b


# --- index --------------------------------------------------------------------------------------------------------


@functools.lru_cache
def run_lengths(percent: int) -> np.ndarray:
    """For each number m of frequent tokens, the length k of the combinations: the most that m and all above have room for, D + 1 times."""
    m = np.arange(1024)
    d = (100 - percent) * m // percent
    k = np.ones(len(m), np.int64)
    for length in range(2, MOST_K + 1):
        k[length * (d + 1) <= m] = length
    return np.minimum.accumulate(k[::-1])[::-1]


def prefix_rows(tokens: np.ndarray, often: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a set's index rows as (key, bare, pos, step); often: which tokens are frequent.

    bare: tokens that a linked set which shares this key first cannot have; pos: place of the key among the others; step:
    blocks that lie before it.
    """
    n = len(tokens)
    if not linkable(n, percent):
        return []
    p = n - overlap_needed(n, percent) + 1
    rare = tokens[~often]
    first = rare[:p]
    none = np.zeros(len(first), np.int64)
    out = [(first, np.arange(len(first)), none, none)]
    if len(rare) >= p:
        return out
    f = tokens[often]
    m, table = len(f), run_lengths(percent)
    reach = max((100 - percent) * m // percent - len(rare), 0) + 1
    lowest, highest = (int(table[min(x, len(table) - 1)]) for x in (overlap_needed(m, percent), m))
    for k in range(lowest, highest + 1):
        part = f[: k * reach]
        if len(part) < k:
            continue
        h = np.full(len(part) - k + 1, np.uint64(k))
        for j in range(k):
            h = h * common.BASE + part[j : len(part) - k + 1 + j]
        pos = np.arange(len(h))
        out.append((common.mix(h) | _ODD, np.full(len(h), len(rare)), pos, pos // k))
    return out


INDEX = "key long, class long, n int, bare int, pos int, step int"


def index(docs: DataFrame, only, frequent, shift: int, k: int, percent: int) -> DataFrame:
    """The index rows of the classes of documents that the bit map `only` lets through (or without an id)."""

    def rows(held: list) -> pa.RecordBatch:
        sizes = [len(x[0]) for x in held]
        flat = [np.concatenate([x[j] for x in held]) for j in range(4)]
        own = [np.repeat(np.array([x[j] for x in held], t), sizes) for j, t in ((4, np.int64), (5, np.int32))]
        return pa.RecordBatch.from_arrays([pa.array(common.signed(flat[0])), *map(pa.array, own), *(pa.array(x.astype(np.int32)) for x in flat[1:])], [c.split()[0] for c in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for c, s in _chosen_sets(batches, only, k):
            often = common.lets_through(frequent.value, (s >> np.uint64(shift)).view(np.int64))
            for part in prefix_rows(s, often, percent):
                held.append((*part, c, len(s)))
                total += len(part[0])
            if total > 200_000:
                yield rows(held)
                held, total = [], 0
        if held:
            yield rows(held)

    return docs.mapInArrow(run, INDEX)


def may_link(x: str, y: str, percent: int) -> Column:
    """Whether the index rows of two sets in one posting list, the first that they share, leave room for a link."""
    a, b = (lambda name: F.col(f"{x}.{name}")), (lambda name: F.col(f"{y}.{name}"))
    rest = lambda c: c("n") - c("bare") - c("pos")
    least = a("bare") + b("bare") + F.greatest(F.abs(a("pos") - b("pos")), a("step"), b("step")) + F.abs(rest(a) - rest(b))
    return least * (100 + percent) <= (a("n") + b("n")) * (100 - percent)


# --- verification -------------------------------------------------------------------------------------------------


def still_open(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b, doc_a, doc_b of the pairs whose parities leave it possible that they link."""

    def end(x: str) -> DataFrame:
        return classes.select(F.col("class").alias(x), F.col("doc_id").alias(f"doc_{x}"), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"parity_{x}"))

    narrow, wide = 1 << (NARROW - 6), 1 << (WIDE - 6)

    def different(first: int, n: int) -> Column:
        bits = F.zip_with(F.slice("parity_a", first, n), F.slice("parity_b", first, n), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        return F.aggregate(bits, F.lit(0), lambda total, x: total + x)

    both_wide = (F.size("parity_a") > narrow) & (F.size("parity_b") > narrow)
    differ = F.when(both_wide, different(narrow + 1, wide)).otherwise(different(1, narrow))
    may = differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    return pairs.join(end("a"), "a").join(end("b"), "b").where(may).select("a", "b", "doc_a", "doc_b")


def judged(likely: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The linked ones (a, b) of distinct pairs (a, b, doc_a, doc_b), by their whole sets."""
    ends = likely.select(F.col("a").alias("class"), F.col("doc_a").alias("doc_id")).union(likely.select("b", "doc_b")).distinct()
    ends = common.stored(ends, "jaccard-ends")
    only, wanted = common.bit_map(ends.where("doc_id is not null").select("doc_id")), common.bit_map(ends.select("class"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, held, size = [], [], 0
        for c, s in _chosen_sets(batches, only, k):
            if not common.lets_through(wanted.value, np.array([c]))[0]:
                continue
            classes.append(c), held.append(s.tobytes())
            size += len(s)
            if size > 1 << 18:
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(held, pa.binary())], ["class", "tokens"])
                classes, held, size = [], [], 0
        if classes:
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(held, pa.binary())], ["class", "tokens"])

    sets = common.stored(docs.mapInArrow(fetch, "class long, tokens binary"), "jaccard-sets")
    stars = likely.groupBy("a").agg((F.floor(F.count("*") / SALT) + 1).alias("salts"))
    salted = likely.select("a", "b").join(stars, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    others = salted.join(sets.withColumnRenamed("class", "b"), "b").select("a", "salt", "b", "tokens")
    centres = sets.withColumnRenamed("class", "a").join(stars, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "tokens")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, x = None, np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            for a, b, tokens in zip(*(batch.column(c) for c in ("a", "b", "tokens"))):
                y, a, b = np.frombuffer(tokens.as_buffer(), np.uint64), a.as_py(), b.as_py()
                if b is None:
                    centre, x = a, y.copy()
                elif a == centre:
                    both = np.intersect1d(x, y, assume_unique=True).size
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["a", "b"])

    met = centres.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return met.select("a", "b", "tokens").mapInArrow(judge, "a long, b long").distinct()


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


# --- groups -------------------------------------------------------------------------------------------------------


def groups(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    spark = docs.sparkSession
    with common.scratch(spark):
        return common.stored(_groups(docs, k, percent), "jaccard-groups", keep=True)


def _groups(docs: DataFrame, k: int, percent: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    surveyed = common.stored(survey(docs, k), "jaccard-survey")
    classes = common.stored(surveyed.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("parity").alias("parity")), "jaccard-classes")
    members = surveyed.select("doc_id", F.col("n").alias("n_shingles"), "class")
    total = classes.agg(F.sum("n")).first()[0] or 0
    only = common.bit_map(classes.where("doc_id is not null").select("doc_id"))
    with common.scratch(docs.sparkSession):  # the index is the largest table; what lies in shared lists is all that is needed of it
        rows = common.stored(index(docs, only, *frequent_tokens(docs, only, total, k, percent), k, percent), "jaccard-index")
        lists = common.stored(in_slots(rows, *shared_keys(rows)), "jaccard-lists", keep=True)
    # Lists of combinations have the class with the fewest rare tokens in their centre: of near copies, the one they are copies of.
    rank = F.when(F.col("key") % 2 == 0, 0).otherwise(F.col("bare"))
    centres = lists.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min(F.struct(rank.alias("rank"), "class", "n", "bare", "pos", "step")).alias("c"))
    centres = common.stored(centres.where("low < high").select("key", "c.*"), "jaccard-centres")
    star = lists.alias("x").join(centres.alias("c"), "key").where(F.col("x.class") != F.col("c.class")).where(may_link("x", "c", percent))
    star = common.stored(star.select(*_ordered(F.col("x.class"), F.col("c.class"))).distinct(), "jaccard-star")
    links = common.stored(judged(common.stored(still_open(star, classes, percent), "jaccard-open"), docs, k, percent), "jaccard-links")
    labels = components(links)

    placed = lists.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    home = centres.select("key", "class").join(labels.withColumnRenamed("node", "class"), "class", "left").select("key", F.coalesce("label", "class").alias("home"))
    placed = common.stored(placed.join(home, "key"), "jaccard-placed")
    apart = common.stored(placed.where("label <> home").distinct(), "jaccard-apart")
    inside = placed.join(apart.select("key").distinct(), "key", "left_semi")
    rest = apart.alias("x").join(inside.alias("y"), "key").where("x.label <> y.label and (y.label = y.home or x.class < y.class)").where(may_link("x", "y", percent))
    rest = rest.select(*_ordered(F.col("x.class"), F.col("y.class"))).distinct().join(star, ["a", "b"], "left_anti")
    more = common.stored(judged(common.stored(still_open(rest, classes, percent), "jaccard-open"), docs, k, percent), "jaccard-links")
    if more.limit(1).count():
        labels = components(links.union(more))
    own = classes.select("class", "doc_id").join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    named = own.join(own.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select("class", "component_id")
    return members.join(named, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; documents with null doc_id stay. Rows that share a doc_id stay or go together if they share a group."""
    first = groups(docs, k, percent).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
