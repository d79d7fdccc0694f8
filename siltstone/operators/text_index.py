"""A persisted full-text index that is changed by adding to it: segments of postings, deletions, and merges by size.

Five Parquet tables below one folder, all appended to by partitions: postings (segment, bucket, word, key, n, tf), terms
(segment, word, term), docs (segment, key, n), deletes (segment, key) and segments (segment, docs, total, words, replaces). A change of some documents
writes one new segment with their postings and deletes their keys from all segments before it; no older file is touched.
A segment counts from the moment its row of `segments` is there, and no more once a later row says that it replaces it, so
a write that was cut off leaves nothing behind but files that the next one overwrites. When a tier of sizes holds MERGE_AT
segments, these are merged into one without their deleted documents. Scores are those of an index built anew.

Terms are Porter stems of the words and of their normalised forms, computed once for each word of a segment; a search finds
the terms that begin with a stem of the query, and their words' postings. Postings lie in buckets by the first two
characters of a word, sorted by it, so a search reads the buckets and row groups of its words only. Keys are unique within one change; rows without a key are left out, null texts count as empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from ..functions.porter import porter
from ..functions.text import identifier_tokens, normalize_token, word_tokens
from .fts import K1, LEAST_IDF, B, variants
from .graph import kept

BUCKETS = 64
LEAD = 2  # characters of a word that choose its bucket
SLICE_DOCS = 1 << 17  # documents of a bucket that one task writes
MERGE_AT = 4  # segments of one tier; tiers are powers of it
PUSHED_WORDS = 64  # so many words are pushed down to the scan
BROADCAST_WORDS = 10_000  # rows of words and of terms with their frequencies that may be broadcast
_SEGMENTS = "segment long, docs long, total long, words long, replaces array<long>"


def _bucket(word: Column) -> Column:
    return F.pmod(F.hash(F.substring(word, 1, LEAD)), F.lit(BUCKETS))


@F.pandas_udf(ArrayType(StructType([StructField("every", BooleanType()), StructField("terms", ArrayType(StringType()))])))
def _variants(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda text: [{"every": mode == "and", "terms": terms} for terms, mode in variants(text or "")])


class TextIndex:
    """An index in a folder; `key` names the column that tells documents apart, `kind` is its SQL type."""

    def __init__(self, spark: SparkSession, folder: str, key: str, kind: str) -> None:
        self.spark, self.folder, self.key, self.kind = spark, folder, key, kind

    @staticmethod
    def build(docs: DataFrame, key: str, text: Column, folder: str, path: Column | None = None) -> TextIndex:
        """An index of docs. With a path, documents are also found by the words of their paths."""
        index = TextIndex(docs.sparkSession, folder, key, docs.schema[key].dataType.simpleString())
        index.change(docs, text, path)
        return index

    # --- tables -------------------------------------------------------------------------------------------------------

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def segments(self) -> list:
        """The rows of all segments ever written, in their order. They are as few as there were changes."""
        try:
            return self._table("segments", _SEGMENTS).orderBy("segment").collect()
        except Exception as error:  # noqa: BLE001 - Spark has one class for all analysis errors
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return []

    @staticmethod
    def live(segments: list) -> list:
        gone = {old for s in segments for old in s["replaces"]}
        return [s for s in segments if s["segment"] not in gone]

    def _write(self, name: str, rows: DataFrame, segment: int, *parts: str) -> None:
        """A segment's rows of a table; what a cut-off write may have left of the same number is overwritten."""
        rows.write.mode("overwrite").partitionBy(*parts).parquet(f"{self.folder}/{name}/segment={segment}")

    def _alive(self, rows: DataFrame, segments: list) -> DataFrame:
        """The rows (segment, key) of live segments whose documents no later segment has deleted."""
        numbers = [s["segment"] for s in self.live(segments)]
        rows = rows.where(F.col("segment").isin(*numbers))
        if numbers == [segments[-1]["segment"]]:  # nothing came after it
            return rows
        dead = self._table("deletes", f"{self.key} {self.kind}, segment long").where(F.col("segment") > min(numbers)).select(F.col(self.key).alias("dead_key"), F.col("segment").alias("dead_from"))
        return rows.join(dead, (F.col(self.key) == F.col("dead_key")) & (F.col("segment") < F.col("dead_from")), "left_anti")

    def _docs(self, segments: list) -> DataFrame:
        return self._alive(self._table("docs", f"{self.key} {self.kind}, n int, segment long"), segments)

    def _postings(self) -> DataFrame:
        return self._table("postings", f"{self.key} {self.kind}, n int, word string, tf long, segment long, bucket int")

    def _terms(self) -> DataFrame:
        return self._table("terms", "word string, term string, segment long")

    # --- changes ------------------------------------------------------------------------------------------------------

    def change(self, docs: DataFrame, text: Column, path: Column | None = None, gone: DataFrame | None = None) -> int:
        """A new segment: docs are added or replace those of their keys, the keys of `gone` are deleted. Returns its number."""
        segments = self.segments()
        number = segments[-1]["segment"] + 1 if segments else 0
        content = F.coalesce(text, F.lit(""))
        whole = content if path is None else F.concat_ws(" ", content, path, F.array_join(identifier_tokens(path), " "))
        rows = docs.where(F.col(self.key).isNotNull()).select(self.key, word_tokens(whole).alias("tokens")).withColumn("n", F.size("tokens"))
        self._write("docs", rows.select(self.key, "n"), number)
        if segments:
            keys = rows.select(self.key) if gone is None else rows.select(self.key).union(gone.select(self.key))
            self._write("deletes", keys.where(F.col(self.key).isNotNull()).distinct(), number)
        size = self._table("docs", f"{self.key} {self.kind}, n int, segment long").where(F.col("segment") == number).count()
        # explode_outer: below a plain explode the optimizer filters by the size of the tokens, which splits every text twice.
        counted = rows.select(self.key, "n", F.explode_outer("tokens").alias("word")).where("word is not null").groupBy(self.key, "n", "word").agg(F.count("*").alias("tf"))
        self._write_postings(self._dealt(counted.withColumn("bucket", _bucket(F.col("word"))), size), number)
        cores = self.spark.sparkContext.defaultParallelism  # stems cost more than their bytes tell
        words = self._postings().where(F.col("segment") == number).select("word").distinct().repartition(cores, "word")
        both = F.array_distinct(F.array(porter(F.col("word")), porter(normalize_token(F.col("word")))))
        self._write("terms", words.select("word", F.explode(both).alias("term")), number)
        self._enter(number, size, [], segments)
        self._merge_tiers()
        return number

    def _dealt(self, postings: DataFrame, docs: int) -> DataFrame:
        """By bucket and, where documents are many, by slices of their keys: a frequent prefix is no task of its own."""
        sliced = postings.withColumn("slice", F.pmod(F.xxhash64(self.key), F.lit(max(1, docs // SLICE_DOCS))))
        return sliced.repartition("bucket", "slice")

    def _write_postings(self, rows: DataFrame, number: int) -> None:
        self._write("postings", rows.sortWithinPartitions("bucket", "word").select(self.key, "n", "word", "tf", "bucket"), number, "bucket")

    def _enter(self, number: int, docs: int, replaces: list[int], segments: list) -> None:
        """The row that makes a segment count, with the live corpus as it then is."""
        row = self.spark.createDataFrame([(number, docs, 0, 0, replaces)], _SEGMENTS)
        total = self._docs([*segments, row.first()]).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.spark.createDataFrame([(number, docs, total[0], total[1], replaces)], _SEGMENTS).coalesce(1).write.mode("append").parquet(f"{self.folder}/segments")

    def _merge_tiers(self) -> None:
        while True:
            tiers: dict[int, list] = {}
            for s in self.live(self.segments()):
                tiers.setdefault(int(math.log(max(s["docs"], 1), MERGE_AT) + 1e-9), []).append(s["segment"])
            due = next((t for t in sorted(tiers) if len(tiers[t]) >= MERGE_AT), None)
            if due is None:
                return
            self.merge(tiers[due])

    def merge(self, numbers: list[int] | None = None) -> int:
        """One segment in place of some (or all), without their deleted documents. Returns its number."""
        segments = self.segments()
        numbers = [s["segment"] for s in self.live(segments)] if numbers is None else numbers
        number = segments[-1]["segment"] + 1
        own = F.col("segment").isin(*numbers)
        self._write("docs", self._docs(segments).where(own).drop("segment"), number)
        size = self._table("docs", f"{self.key} {self.kind}, n int, segment long").where(F.col("segment") == number).count()
        self._write_postings(self._dealt(self._alive(self._postings().where(own), segments).drop("segment"), size), number)
        self._write("terms", self._terms().where(own).select("word", "term").distinct(), number)
        self._enter(number, size, numbers, segments)
        return number

    # --- searches -----------------------------------------------------------------------------------------------------

    def scores(self, wanted: DataFrame) -> DataFrame:
        """term, key, score for distinct stems (term): what each adds to the score of a document with terms that begin with it."""
        segments = self.segments()
        total = segments[-1]["total"]
        mean = segments[-1]["words"] / total if total else 1.0
        prefixes = wanted.select(F.col("term").alias("prefix"), F.substring("term", 1, LEAD).alias("lead"))
        terms = self._terms().where(F.col("segment").isin(*(s["segment"] for s in self.live(segments)))).select("word", "term").distinct()
        words = terms.join(prefixes, (F.substring("term", 1, LEAD) == F.col("lead")) & F.startswith("term", "prefix")).groupBy("prefix", "word").agg(F.count("*").alias("times"))
        words = kept(words, "index-words")
        few = words.select("word", _bucket(F.col("word")).alias("own_bucket")).limit(BROADCAST_WORDS + 1).collect()
        small = len(few) <= BROADCAST_WORDS
        buckets = {r["own_bucket"] for r in few} if small else {r[0] for r in words.select(_bucket(F.col("word"))).distinct().collect()}  # at most BUCKETS
        near = self._postings().where(F.col("bucket").isin(*buckets))
        if len(few) <= PUSHED_WORDS:
            near = near.where(F.col("word").isin(*(r["word"] for r in few)))
        met = self._alive(near, segments).join(F.broadcast(words) if small else words, "word")
        hits = met.groupBy(F.col("prefix").alias("term"), self.key, "n").agg(F.sum(F.col("tf") * F.col("times")).alias("tf"))
        hits = kept(hits, "index-hits")
        df = hits.groupBy("term").agg(F.count("*").alias("df"))
        df = F.broadcast(df) if small else df  # no more prefixes than words
        idf = F.greatest(F.log((total - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
        weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.lit(mean or 1.0)))
        return hits.join(df, "term").select("term", self.key, weight.alias("score"))

    def search_terms(self, wanted: DataFrame, k: int = 20) -> DataFrame:
        """query_id, key, score, mode, rank for queries that are given as (query_id, variant, every, term), variants from 0.

        The variants of a query are tried in their order; the first that finds something gives its best k documents: those
        with all its terms (every) or with any. A round answers all open queries at once and reads the postings of their
        terms once.
        """
        stems = wanted.withColumn("term", porter(F.lower("term"))).distinct()
        terms = kept(stems.withColumn("wanted", F.count("*").over(Window.partitionBy("query_id", "variant"))), "index-terms")
        rounds = (terms.agg(F.max("variant")).first()[0] or 0) + 1
        answers: list[DataFrame] = []
        for variant in range(rounds):
            open_ = terms.where(F.col("variant") == variant)
            for top in answers:
                open_ = open_.join(top.select("query_id").distinct(), "query_id", "left_anti")
            if variant and open_.isEmpty():
                continue
            found = open_.join(self.scores(open_.select("term").distinct()), "term")
            scored = found.groupBy("query_id", "every", "wanted", self.key).agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("matched"))
            whole = scored.where(~F.col("every") | (F.col("matched") == F.col("wanted")))
            order = Window.partitionBy("query_id").orderBy(F.desc("score"), self.key)
            top = whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            answers.append(kept(top.select("query_id", self.key, "score", F.when(F.col("every"), "and").otherwise("or").alias("mode"), "rank"), "index-top"))
        return reduce(DataFrame.unionByName, answers)

    def search_many(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """query_id, key, score, mode, rank: of each query (query_id, text) the best k documents.

        The variants of a text: stemmed terms before raw ones, all terms before any.
        """
        tried = queries.select("query_id", F.posexplode(_variants(F.coalesce("text", F.lit("")))).alias("variant", "v"))
        return self.search_terms(tried.select("query_id", "variant", "v.every", F.explode("v.terms").alias("term")), k)

    def search(self, query: str, k: int = 20) -> DataFrame:
        """key, score, mode of the best k documents for one query."""
        rows = [(0, k, mode == "and", term) for k, (terms, mode) in enumerate(variants(query)) for term in terms]
        wanted = self.spark.createDataFrame(rows, "query_id int, variant int, every boolean, term string")
        return self.search_terms(wanted, k).orderBy("rank").select(self.key, "score", "mode")
