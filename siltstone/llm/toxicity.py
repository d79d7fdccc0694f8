"""Toxicity scores from a factorization machine over hashed terms.

Terms are lower-cased runs of letters and their first few bytes, hashed into BUCKETS buckets; a document is the set of its buckets. The model is

    logit = w0 + sum_i w_i + 1/2 sum_f ((sum_i v_if)^2 - sum_i v_if^2)

over the terms present, so that pairs of terms (an insult together with the mention of a group) have a weight of their
own, which additive weights can't give. It is fitted in numpy by Adagrad on the logistic loss, on a sample of labelled
rows whose expected size is bounded by SAMPLE_ROWS, chosen by a hash of doc_id, over the FEATURES buckets whose
presence differs most between the labels. Every document is scored by its whole text.

Defined results: null and empty texts get the score of the bias alone; without labelled rows all scores are 0; of
repeated label rows of a document the largest label counts, and null labels are left out; rows with null or
repeated doc_id are scored like any other; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .langid import fold

BUCKETS = 1 << 20
FEATURES = 8192
PREFIXES = (4, 5, 6, 7)  # bytes; stems stand for inflected forms that the sample lacks
FACTORS = 8
SAMPLE_ROWS = 10_000
LEAST_ROWS = 3  # a bucket seen in fewer sampled rows is no feature
EPOCHS = 12
RATE, DECAY = 0.2, 1e-4
THRESHOLD = 0.3

_NO_LETTER = np.ones(256, bool)
_NO_LETTER[65:91] = False
_NO_LETTER[97:123] = False
_NO_LETTER[128:] = False


def buckets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all terms of the texts, and where each text begins (n+1 values)."""
    starts, ends, at = common.word_spans(buf, off, _NO_LETTER)
    out = np.empty((len(starts), 1 + len(PREFIXES)), np.int64)
    out[:, 0] = common.word_hashes(buf, starts, ends) % np.uint64(BUCKETS)
    for k, n in enumerate(PREFIXES, 1):
        stems = common.word_hashes(buf, starts, np.minimum(starts + n, ends)) * np.uint64(2 * k + 1)
        out[:, k] = np.where(ends - starts > n, stems >> np.uint64(44), out[:, 0])
    return out.ravel(), at * out.shape[1]


def _distinct(terms: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of each text: (terms, text numbers), by text."""
    keys = np.unique(np.repeat(np.arange(len(at) - 1), np.diff(at)) * width + terms)
    return keys % width, keys // width


class Model:
    """feature[bucket] is a row of w and v, or -1."""

    def __init__(self, feature: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray) -> None:
        self.feature, self.bias, self.w, self.v = feature, bias, w, v

    def logits(self, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(at) - 1
        known = self.feature[terms]
        doc = np.repeat(np.arange(n), np.diff(at))[known >= 0]
        keys = np.unique(doc * len(self.w) + known[known >= 0])
        rows, doc = keys % len(self.w), keys // len(self.w)
        v = self.v[rows]
        out = self.bias + np.bincount(doc, self.w[rows] - 0.5 * (v * v).sum(1), n)
        for f in range(v.shape[1]):
            out += 0.5 * np.bincount(doc, v[:, f], n) ** 2
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def feature_rows(terms: np.ndarray, seen: np.ndarray, hit: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """For each bucket its row in the model, or -1. terms: buckets, ascending, with the texts and the toxic texts that have them."""
    seen, hit = seen.astype(np.float32), hit.astype(np.float32)
    positive, negative = max(1, labels.sum()), max(1, (1 - labels).sum())
    lift = np.abs(hit / positive - (seen - hit) / negative) / np.sqrt(np.maximum(seen, 1))
    lift[seen < LEAST_ROWS] = 0
    chosen = np.argsort(-lift, kind="stable")[:FEATURES]
    chosen = terms[chosen[lift[chosen] > 0]]
    feature = np.full(BUCKETS, -1, np.int32)
    feature[chosen] = np.arange(len(chosen))
    return feature


def known_terms(feature: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the model that the texts have, and where each text begins."""
    known = feature[flat]
    return known[known >= 0].astype(np.int16), np.append(0, np.cumsum(known >= 0))[ends]


def fit(flat: np.ndarray, ends: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
    """Fits the machine on bucket sets (text i has flat[ends[i]:ends[i + 1]]) and their 0/1 labels."""
    seen, hit = np.bincount(flat, minlength=BUCKETS), np.bincount(flat[np.repeat(labels > 0, np.diff(ends))], minlength=BUCKETS)
    feature = feature_rows(np.arange(BUCKETS), seen, hit, labels)
    return machine(feature, *known_terms(feature, flat, ends), labels, seed)


def machine(feature: np.ndarray, flat: np.ndarray, at: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
    """Fits the machine on the features of texts (text i has flat[at[i]:at[i + 1]]) and their 0/1 labels."""
    rng, n = np.random.default_rng(seed), len(labels)
    chosen = np.arange(feature.max() + 1)
    w, v = np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), FACTORS))
    rate = (labels.sum() + 0.5) / (len(labels) + 1)
    bias = float(np.log(rate / (1 - rate)))
    gw, gv, gb = np.full(w.shape, 1e-3), np.full(v.shape, 1e-3), 1e-3
    for _ in range(EPOCHS if len(chosen) else 0):
        for part in np.array_split(rng.permutation(n), max(1, n // 256)):
            index = np.concatenate([np.arange(at[i], at[i + 1]) for i in part]) if len(part) else np.zeros(0, np.int64)
            k, d = flat[index], np.repeat(np.arange(len(part)), at[part + 1] - at[part])
            vk = v[k]
            sums = np.stack([np.bincount(d, vk[:, f], len(part)) for f in range(FACTORS)], 1)
            score = bias + np.bincount(d, w[k] - 0.5 * (vk * vk).sum(1), len(part)) + 0.5 * (sums * sums).sum(1)
            error = (sigmoid(score) - labels[part]) / len(part)
            features, back = np.unique(k, return_inverse=True)
            dw = np.bincount(back, error[d], len(features)) + DECAY * w[features]
            each = error[d, None] * (sums[d] - vk)
            dv = np.stack([np.bincount(back, each[:, f], len(features)) for f in range(FACTORS)], 1) + DECAY * v[features]
            gw[features] += dw * dw
            gv[features] += dv * dv
            gb += error.sum() ** 2
            w[features] -= RATE * dw / np.sqrt(gw[features])
            v[features] -= 0.3 * RATE * dv / np.sqrt(gv[features])
            bias -= 0.3 * RATE * error.sum() / np.sqrt(gb)
    return Model(feature, bias, w if len(w) else np.zeros(1), v if len(v) else np.zeros((1, FACTORS)))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fits the model on labelled documents outside the held-out fold; None without any."""
    marked = labels.where((fold(F.col("doc_id"), 4) != 2) & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("double").alias("y"))
    total = marked.count()
    if not total:
        return None
    every = max(1, -(-total // SAMPLE_ROWS))
    sampled = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(every)) == 0
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(sampled & (fold(F.col("doc_id"), 4) != 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, buf, off in common.blocks(batch, "text", lower=True):
                terms, doc = _distinct(*buckets(buf, off), BUCKETS)
                ends = np.searchsorted(doc, np.arange(block.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(terms.astype(np.int32)))], ["doc_id", "terms"])

    with common.scratch(docs.sparkSession):
        # Texts become term sets before the join with the labels; numbers of the terms, then the sample's features are what goes to the driver.
        rows = common.stored(texts.mapInArrow(run, "doc_id long, terms array<int>").join(marked.where(sampled), "doc_id").select("doc_id", "terms", "y"), "toxicity-terms")
        seen = rows.select(F.explode("terms").alias("term"), "y").groupBy("term").agg(F.count("*").cast("int").alias("seen"), F.count_if(F.col("y") > 0).cast("int").alias("hit"))
        labelled = rows.select("doc_id", "y").toArrow().sort_by("doc_id")
        counted = seen.where(F.col("seen") >= LEAST_ROWS).toArrow().sort_by("term")
        feature = feature_rows(*(counted.column(c).to_numpy() for c in ("term", "seen", "hit")), labelled.column("y").to_numpy())
        del counted

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                terms = batch.column("terms")
                known, at = known_terms(feature, terms.flatten().to_numpy(), np.append(0, np.cumsum(np.asarray(pc.list_value_length(terms)))))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(known)), batch.column("y")], ["doc_id", "terms", "y"])

        got = rows.mapInArrow(keep, "doc_id long, terms array<short>, y double").toArrow().combine_chunks().sort_by("doc_id")
        terms = got.column("terms").combine_chunks()
        return machine(feature, terms.flatten().to_numpy(), np.append(0, np.cumsum(np.asarray(pc.list_value_length(terms)))), got.column("y").to_numpy())


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, buf, off in common.blocks(batch, "text", lower=True):
                p = sigmoid(model.logits(*buckets(buf, off))) if model else np.zeros(block.num_rows)
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], [c.split()[0] for c in SCHEMA.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, buf, off in common.blocks(batch, "text", lower=True):
                if model:
                    block = block.filter(pa.array(sigmoid(model.logits(*buckets(buf, off))) < THRESHOLD))
                yield block

    return docs.mapInArrow(run, schema)
