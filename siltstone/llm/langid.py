"""Language identification as multilingual mixture inference over byte n-grams.

Training counts hashed byte n-grams by language. A document is then a bag of n-grams drawn from a mixture of the
languages: expectation-maximisation estimates the mixture proportions, nested language sets are compared by their
log-likelihood less a penalty of half the free proportions times the log of the number of n-grams, and the best set's
largest proportion names the language.

The model knows every language of the labelled rows and holds BUCKETS numbers for each. It is fitted on a sample chosen
by a hash of doc_id and text: each language has an equal part of SAMPLE_ROWS rows to expect, LEAST_ROWS at least, all of
its rows where it has no more, and one row in any case. Every document is scored by its whole text; the score is the proportion drawn a little towards even odds, so that it says less for few n-grams.

Defined results: null texts and texts without a letter are `und` with score 0; a table without labelled rows gives
`und` with score 0 for all; rows with null or repeated doc_id are scored like any other; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 15
N_GRAM = 3
SAMPLE_ROWS = 20_000
LEAST_ROWS = 200
ITERATIONS = 8
_LETTER = re.compile(r"[^\W\d_]")


def fold(key: Column, folds: int) -> Column:
    """crc32 of an id written as text, modulo the number of folds."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def gram_buckets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the byte n-grams of each text, white space and digits and punctuation as one blank.

    A blank is put before and after each text, so that every text with a letter has an n-gram.
    """
    texts = np.arange(len(off))
    letters = np.full(len(buf) + 2 * (len(off) - 1), 32, np.uint32)
    letters[np.arange(len(buf)) + np.repeat(2 * texts[:-1] + 1, np.diff(off))] = _FOLDED[buf]
    off = off + 2 * texts
    n = len(letters) - N_GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    h = letters[:n] * np.uint32(0x01000193)
    for j in range(1, N_GRAM):
        h = (h ^ letters[j : n + j]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    ok = np.ones(n, bool)  # grams that cross from one text to the next, or begin with two blanks, are left out
    for j in range(1, N_GRAM):
        cross = off[1:-1] - j
        ok[cross[(cross >= 0) & (cross < n)]] = False
    ok &= (letters[:n] != 32) | (letters[1 : n + 1] != 32)
    index = np.flatnonzero(ok)
    return (h[index] % np.uint32(BUCKETS)).astype(np.int64), np.searchsorted(index, off, side="left")


_FOLDED = np.full(256, 32, np.uint8)
_FOLDED[97:123] = np.arange(97, 123)
_FOLDED[65:91] = np.arange(97, 123)
_FOLDED[128:] = np.arange(128, 256)


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, BUCKETS x languages probabilities) from (doc_id, text, lang) rows; lang is never null."""
    hashed = labelled.withColumn("h", F.xxhash64("doc_id", "text"))
    sizes = hashed.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("one")).collect()
    names = sorted(r["lang"] for r in sizes)
    if not names:
        return [], np.zeros((BUCKETS, 0))
    share = max(LEAST_ROWS, SAMPLE_ROWS // len(names))
    picks = labelled.sparkSession.createDataFrame([(r["lang"], max(1, -(-r["n"] // share)), r["one"]) for r in sizes], "lang string, every long, one long")
    rows = hashed.join(F.broadcast(picks), "lang").where(F.pmod("h", "every") == F.pmod("one", "every"))
    number = {name: k for k, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, buf, off in common.blocks(batch, "text", lower=True):
                grams, at = gram_buckets(buf, off)
                lang = np.array([number[x] for x in block.column("lang").to_pylist()])
                cell, n = np.unique(np.repeat(lang, np.diff(at)) * BUCKETS + grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    cells = rows.select("text", "lang").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(names), BUCKETS))
    counts.ravel()[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.float64)
    counts += 0.05
    return names, np.ascontiguousarray((counts / counts.sum(1, keepdims=True)).T)


def proportions(p: np.ndarray, start: np.ndarray, iterations: int = ITERATIONS) -> tuple[np.ndarray, float]:
    """Expectation-maximisation of mixture proportions for likelihoods p (n-grams x languages): (pi, log-likelihood)."""
    pi, n = start, len(p)
    for _ in range(iterations):
        new = pi * (p.T @ (1.0 / (p @ pi))) / n
        done = np.abs(new - pi).max() < 1e-3
        pi = new
        if done:
            break
    return pi, float(np.log(p @ pi).sum())


def infer(p: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The chosen language set of one document and its proportions, best first."""
    n, k = p.shape
    full, _ = proportions(p, np.full(k, 1.0 / k))
    order = np.argsort(-full, kind="stable")
    best = [int(order[0])], np.ones(1), float(np.log(p[:, order[0]]).sum())
    for size in range(2, k + 1):
        if full[order[size - 1]] < 1e-3:
            break
        chosen = order[:size]
        pi, ll = proportions(p[:, chosen], full[chosen] / full[chosen].sum())
        ll -= 0.5 * (size - 1) * np.log(n)
        if ll <= best[2]:
            break
        best = [int(x) for x in chosen], pi, ll
    rank = np.argsort(-best[1], kind="stable")
    return [best[0][r] for r in rank], best[1][rank]


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, languages string"


def predict(docs: DataFrame, names: list[str], model: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the language set as `lang:proportion` pairs, best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, buf, off in common.blocks(batch, "text", lower=True):
                grams, at = gram_buckets(buf, off)
                lang, score, sets = [], [], []
                for i, text in enumerate(block.column("text").to_pylist()):
                    g = grams[at[i] : at[i + 1]]
                    if not names or not text or not _LETTER.search(text):
                        lang.append("und"), score.append(0.0), sets.append("")
                        continue
                    chosen, pi = infer(model[g])
                    lang.append(names[chosen[0]])
                    score.append(float((pi[0] * len(g) + 1) / (len(g) + len(names))))
                    sets.append(",".join(f"{names[c]}:{x:.3f}" for c, x in zip(chosen, pi)))
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("held_out"), pa.array(lang), pa.array(score, pa.float64()), pa.array(sets)], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")).select("doc_id", "held_out", "text").mapInArrow(run, SCHEMA)


def identify(docs: DataFrame) -> DataFrame:
    learned = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), 4) != 2))
    names, model = train(learned.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string")))
    return predict(docs, names, model)
