"""Full-text search over a table as it is: BM25, the variants of a query, and the all-terms-first rule. text_index keeps an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import translations
from ..functions.text import STOPWORDS, normalize, query_terms, word_tokens
from .graph import kept

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


def variants(query: str) -> list[tuple[list[str], str]]:
    """(terms, mode) to try in this order: normalised terms, then raw ones; of each all significant terms, then any.

    The query is widened by the dictionary first. Significant terms have three characters and are no stop-words; there
    must be two. Terms that hold other signs are searched by the words in them.
    """
    words = " ".join([query, *translations(query)])
    out = []
    for text in (" ".join(normalize(w) for w in words.split()), words):
        terms = query_terms(text)
        every = [t for t in terms if len(t) >= 3 and t not in STOPWORDS]
        some = [t for t in terms if len(t) >= 2]
        plain = lambda ts: list(dict.fromkeys(p for t in ts for p in t.replace("_", " ").replace(".", " ").replace("-", " ").split()))
        if len(every) >= 2:
            out.append((plain(every), "and"))
        if some:
            out.append((plain(some), "or"))
    return out


def term_hits(docs: DataFrame, key: str, text: Column, terms: list[str]) -> DataFrame:
    """key, n (length of the document) and term, tf for each query term in it.

    The query's terms are few, so each document is reduced to their counts where it is read and nothing else is moved.
    """
    tokens = docs.select(F.col(key), word_tokens(text).alias("tokens"))
    own = F.filter("tokens", lambda x: x.isin(*terms))
    counted = F.transform(F.array(*map(F.lit, terms)), lambda t: F.struct(t.alias("term"), F.size(F.filter("own", lambda x: x == t)).cast("long").alias("tf")))
    return tokens.select(key, F.size("tokens").alias("n"), own.alias("own")).select(key, "n", F.filter(counted, lambda h: h["tf"] > 0).alias("hits"))


def _weighted(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Adds weight to (key, n, term, tf), from the corpus row (total, mean_n)."""
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # one row for each query term
    met = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(corpus))
    idf = F.greatest(F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    return met.withColumn("weight", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean_n"))))


def _hits(docs: DataFrame, key: str, text: Column, terms: list[str]) -> tuple[DataFrame, DataFrame]:
    """(key, n, term, tf; total, mean_n): every text is read and split once."""
    reduced = kept(term_hits(docs, key, text, terms), "fts-hits")
    return reduced.where(F.size("hits") > 0).select(key, "n", F.explode("hits").alias("h")).select(key, "n", "h.term", "h.tf"), reduced.agg(F.count("*").alias("total"), F.avg("n").alias("mean_n"))


def bm25(docs: DataFrame, key: str, text: Column, terms: list[str], require_all: bool = False) -> DataFrame:
    """key, score, matched for documents with a query term (or all of them), unordered."""
    scored = _weighted(*_hits(docs, key, text, terms)).groupBy(key).agg(F.round(F.sum("weight"), 6).alias("score"), F.count("*").alias("matched"))
    return scored.where(F.col("matched") == len(terms)) if require_all else scored


def bm25_many(docs: DataFrame, key: str, text: Column, queries: dict[str, list[str]]) -> DataFrame:
    """query_id, key, score for the terms of several queries; the texts are read once for all of them."""
    terms = sorted({t for ts in queries.values() for t in ts})
    own = docs.sparkSession.createDataFrame([(q, t) for q, ts in queries.items() for t in dict.fromkeys(ts)], "query_id string, term string")
    return _weighted(*_hits(docs, key, text, terms)).join(F.broadcast(own), "term").groupBy("query_id", key).agg(F.round(F.sum("weight"), 6).alias("score"))


def top_k(scores: DataFrame, key: str, k: int, score: str = "score") -> DataFrame:
    return scores.orderBy(F.desc(score), key).limit(k)


def search(docs: DataFrame, key: str, text: Column, terms: list[str], k: int) -> DataFrame:
    """Documents with all terms if there is one, else those with any; the best k with the mode that gave them."""
    scored = bm25(docs, key, text, terms)
    best = scored.agg(F.max(F.col("matched") == len(terms)).alias("some_all"))
    found = scored.crossJoin(F.broadcast(best)).where(~F.col("some_all") | (F.col("matched") == len(terms)))
    return top_k(found.select(key, "score", F.when(F.col("some_all"), "and").otherwise("or").alias("mode")), key, k)
