"""Benchmark decontamination: a BM25 inverted index of the test items, queried by every training passage.

Documents are cut into passages of twice the longest item with a stride of one, so that every run of words as long as
an item lies whole in some passage. The terms of a passage are the query; an item's score is compared with its bound, a
score that every passage accepted by verification reaches (see `accepted`). Retrieval returns every item that reaches
it, by block-max WAND in batches:

* in each block, frequent terms whose impacts stay below SLACK of every item's bound are non-essential and are not
  looked up at first: no item can reach its bound by them alone;
* items are kept in blocks of similar length with the largest impact of each term in the block; a passage skips all
  blocks where the sum of these, and of the non-essential rest, stays below the smallest bound in the block;
* what is left is scored exactly, item by item.

Retrieved pairs are verified: the passage must hold at least OVERLAP of the 3-grams of the question (all but the last
sentence) and of the answer (the last sentence, or the last third of an item with only one; three terms at least; a
question shorter than that is the whole item). Letter case does not matter.

The index is broadcast while the items hold at most INDEX_BYTES of text; larger benchmarks are split by a hash of
item_id into as many indexes as it takes, each queried by all passages. The parts share the whole benchmark's document
frequencies, mean length and longest item, so passages, scores and bounds do not depend on the split. Defined results: null and empty texts and
items match nothing; equal items all match; rows with null or repeated ids are handled one by one; an empty table on
either side gives no pairs; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K1, B = 1.2, 0.75
OVERLAP = 0.5
SLACK = 0.75
BLOCK_ITEMS = 2
GRAM = 3
INDEX_BYTES = 32 << 20
DENSE = 1 << 23  # bounds kept in a full array

_BREAK = np.ones(256, bool)  # terms are runs of letters and digits
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _BREAK[_a:_b] = False


def terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, at = common.word_spans(buf, off, _BREAK)
    return common.word_hashes(buf, starts, ends), at


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    return np.unique(common.shingle_hashes(words, k))


def _share(grams: np.ndarray, present: np.ndarray) -> float:
    return float(np.isin(grams, present, assume_unique=True).mean()) if len(grams) else 1.0


class Statistics(NamedTuple):
    """What BM25 takes from a whole benchmark: items with terms, their terms and the longest's, and the items of each term of a part."""

    items: int
    words: int
    longest: int
    vocabulary: np.ndarray
    df: np.ndarray


class Index:
    """Postings of the items in CSR form, block maxima, and the parts of each item for verification.

    whole: the statistics of the benchmark of which these items are a part (else of these items).
    """

    def __init__(self, ids: list, texts: list[str], whole: Statistics | None = None) -> None:
        sequences, parts, cuts = [], [], []
        for text in texts:
            words = self._words(text)
            sentences = [s for s in re.split(r"(?<=[.?!])\s+|\n+", text) if len(self._words(s))]
            last = len(self._words(sentences[-1])) if len(sentences) > 1 else max(1, len(words) // 3)
            last = min(max(last, GRAM), len(words))
            k = max(1, min(GRAM, len(words)))
            sequences.append(words)
            question = words[: len(words) - last] if len(words) - last >= k else words
            cuts.append((len(question), len(words) - last, k))
            parts.append((_grams(question, k), _grams(words[len(words) - last :], k), k))
        order = sorted((i for i in range(len(ids)) if len(sequences[i])), key=lambda i: len(sequences[i]))
        self.ids, self.parts = [ids[i] for i in order], [parts[i] for i in order]
        lengths = np.array([len(sequences[i]) for i in order], np.float64)
        self.items = len(order)
        if not self.items:
            self.longest = 1
            return
        flat = np.concatenate([sequences[i] for i in order])
        self.vocabulary, number = np.unique(flat, return_inverse=True)
        item = np.repeat(np.arange(self.items), lengths.astype(np.int64))
        pairs, tf = np.unique(number.astype(np.int64) * self.items + item, return_counts=True)
        term, item = pairs // self.items, pairs % self.items
        whole = whole or Statistics(self.items, int(lengths.sum()), int(lengths.max()), self.vocabulary, np.bincount(term, minlength=len(self.vocabulary)))
        self.longest = whole.longest
        df = whole.df[np.searchsorted(whole.vocabulary, self.vocabulary)]
        idf = np.log(1 + (whole.items - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] * whole.items / whole.words))
        self.start, self.item, self.impact = np.searchsorted(term, np.arange(len(self.vocabulary) + 1)), item, impact
        self.own = np.bincount(item, impact, self.items)
        self.bound = np.array([self.accepted(i, sequences[k], cuts[k], pairs, impact) for i, k in enumerate(order)])
        # Of each item, the terms most frequent among the items are set aside while they make up SLACK of its bound;
        # a term stays set aside in a block if it is for all items there that have it.
        by_item = np.lexsort((-df[term], item))
        running = np.cumsum(impact[by_item])
        before = np.concatenate([[0.0], running])[np.searchsorted(item[by_item], item[by_item])]
        can = np.empty(len(item), bool)
        can[by_item] = (running - before <= SLACK * self.bound[item[by_item]]) & (df[term[by_item]] > 1)
        self.blocks = (self.items - 1) // BLOCK_ITEMS + 1
        cells, back = np.unique(term * self.blocks + item // BLOCK_ITEMS, return_inverse=True)
        needed = np.bincount(back, ~can, len(cells)) > 0
        mass = np.bincount(item, np.where(needed[back], 0.0, impact), self.items)
        top = np.zeros(len(cells))
        np.maximum.at(top, back, impact)
        firsts = np.arange(self.blocks) * BLOCK_ITEMS
        self.least, self.rest = np.minimum.reduceat(self.bound, firsts), np.maximum.reduceat(mass, firsts)
        cells, self.block_top = cells[needed], top[needed]
        self.block_start, self.block = np.searchsorted(cells // self.blocks, np.arange(len(self.vocabulary) + 1)), cells % self.blocks
        self.essential = np.diff(self.block_start) > 0
        self.hint = np.zeros(1 << 20, bool)
        self.hint[self.vocabulary >> np.uint64(44)] = True

    def accepted(self, item: int, words: np.ndarray, cut: tuple[int, int, int], pairs: np.ndarray, impact: np.ndarray) -> float:
        """A lower bound of the score of all passages with OVERLAP of the item's question grams and of its answer grams.

        Each term's impact is shared out evenly among the grams that hold it. What any grams hold of it is then at most
        the impact, so the score is at least the sum of the grams present, and that of the least grams that suffice.
        """
        stop, begin, k = cut
        number = np.searchsorted(self.vocabulary, words)
        grams = [a + np.unique(common.shingle_hashes(words[a:b], k), return_index=True)[1] for a, b in ((0, stop), (begin, len(words)))]
        held = np.concatenate(grams)[:, None] + np.arange(k)
        cells = np.unique(np.repeat(np.arange(len(held)), k) * len(self.vocabulary) + number[held].ravel())
        row, term = cells // len(self.vocabulary), cells % len(self.vocabulary)
        _, back, holders = np.unique(term, return_inverse=True, return_counts=True)
        value = np.bincount(row, impact[np.searchsorted(pairs, term * self.items + item)] / holders[back], len(held))
        split, total = len(grams[0]), 0.0
        for part in (value[:split], value[split:]):
            total += float(np.sort(part)[: int(np.ceil(OVERLAP * len(part) - 1e-9))].sum())
        return total * (1 - 1e-9)

    @staticmethod
    def _words(text: str) -> np.ndarray:
        data = np.frombuffer(common.lowered(pa.array([text]))[0].as_py().encode(), np.uint8)
        return terms(data, np.array([0, len(data)]))[0]

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Term numbers, -1 for terms of no item."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.hint[h >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
        out[maybe] = np.where(self.vocabulary[at] == h[maybe], at, -1)
        return out

    def retrieve(self, number: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(doc, first, last, item, score) of all pairs of a passage and an item that reaches its bound.

        number: term numbers of the texts, at: where each text begins.
        """
        stride, counts = self.longest, np.diff(at)
        segments = np.maximum(1, -(-counts // stride))  # a passage is two of these, or a text's only one
        first_segment = np.cumsum(segments) - segments
        here = np.flatnonzero(number >= 0)
        doc = np.repeat(np.arange(len(counts)), counts)[here]
        segment, term = first_segment[doc] + (here - at[doc]) // stride, number[here]

        def spread(row: np.ndarray, term: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Each row repeated for every posting of its term, with the posting's place."""
            n = start[term + 1] - start[term]
            ends = np.cumsum(n)
            return np.repeat(row, n), np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[term] - (ends - n), n)

        # Upper bounds by segment and block; a term that occurs twice counts twice here, which only raises a bound.
        some = self.essential[term]
        row, place = spread(segment[some], term[some], self.block_start)
        key = row * self.blocks + self.block[place]
        total = int(segments.sum())
        single = np.repeat(segments == 1, segments)
        if (total + 1) * self.blocks <= DENSE:
            upper = np.bincount(key, self.block_top[place], (total + 1) * self.blocks)
            final = np.zeros(total + 1, bool)
            final[first_segment + segments - 1] = True
            upper = upper.reshape(total + 1, self.blocks)
            both = upper[:-1] + np.where(final[:-1, None], 0.0, upper[1:]) + self.rest
            passage, block = np.nonzero(both >= self.least)
            alive = passage * self.blocks + block
        else:
            wanted, back = np.unique(key, return_inverse=True)
            upper = np.bincount(back, self.block_top[place], len(wanted))
            alive = np.unique(np.concatenate([wanted, wanted[wanted >= self.blocks] - self.blocks]))
            at_key = lambda k: np.where(wanted[np.minimum(np.searchsorted(wanted, k), len(wanted) - 1)] == k, upper[np.minimum(np.searchsorted(wanted, k), len(wanted) - 1)], 0.0)
            alive = alive[at_key(alive) + at_key(alive + self.blocks) + self.rest[alive % self.blocks] >= self.least[alive % self.blocks]] if len(wanted) else alive
        # A text's last segment is no passage of its own unless it is the only one.
        tail = np.zeros(total, bool)
        tail[first_segment + segments - 1] = True
        tail &= ~single
        alive = alive[~tail[alive // self.blocks]]
        if not len(alive):
            none = np.zeros(0, np.int64)
            return none, none, none, none, np.zeros(0)
        live = np.zeros(total, bool)
        live[alive // self.blocks] = True
        own, earlier = live[segment], np.zeros(len(segment), bool)
        earlier[segment > 0] = live[segment[segment > 0] - 1] & (segment > first_segment[doc])[segment > 0]
        keys = np.unique(np.concatenate([segment[own] * len(self.vocabulary) + term[own], (segment[earlier] - 1) * len(self.vocabulary) + term[earlier]]))
        passage, place = spread(keys // len(self.vocabulary), keys % len(self.vocabulary), self.start)
        item = self.item[place]
        key = passage * self.blocks + item // BLOCK_ITEMS
        open_block = alive[np.minimum(np.searchsorted(alive, key), len(alive) - 1)] == key
        passage, item, impact = passage[open_block], item[open_block], self.impact[place[open_block]]
        wanted, back = np.unique(passage * self.items + item, return_inverse=True)
        score = np.bincount(back, impact, len(wanted))
        passage, item = wanted // self.items, wanted % self.items
        good = score >= self.bound[item]
        passage, item = passage[good], item[good]
        doc = np.searchsorted(first_segment, passage, side="right") - 1
        low = at[doc] + (passage - first_segment[doc]) * stride
        high = np.minimum(low + 2 * stride, at[doc + 1])
        return doc, low, high, item, score[good]

    def verified(self, words: np.ndarray, item: int) -> tuple[float, float]:
        question, answer, k = self.parts[item]
        present = _grams(words, k)
        return _share(question, present), _share(answer, present)

    def matches(self, buf: np.ndarray, off: np.ndarray) -> dict[tuple[int, int], tuple[float, float, float]]:
        """{(text, item): (score as a share of the item's own, question overlap, answer overlap)}, the best passage each."""
        out: dict[tuple[int, int], tuple[float, float, float]] = {}
        if not self.items:
            return out
        words, at = terms(buf, off)
        for doc, low, high, item, score in zip(*self.retrieve(self.lookup(words), at)):
            question, answer = self.verified(words[low:high], item)
            if question >= OVERLAP and answer >= OVERLAP:
                found = (float(score / self.own[item]), question, answer)
                out[int(doc), int(item)] = max(found, out.get((int(doc), int(item)), found))
        return out


def item_terms(items: DataFrame) -> DataFrame:
    """part, term, n: the distinct terms of every item as rows (n null), and a row (term null) with its number of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, buf, off in common.blocks(batch, "text", lower=True):
                words, at = terms(buf, off)
                for part, a, b in zip(block.column("part").to_pylist(), at[:-1], at[1:]):
                    if b > a:
                        distinct = common.signed(np.unique(words[a:b]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(distinct) + 1, part, np.int64)), pa.array([None, *distinct.tolist()], pa.int64()), pa.array([int(b - a), *[None] * len(distinct)], pa.int64())], ["part", "term", "n"])

    return items.select("part", "text").mapInArrow(run, "part long, term long, n long")


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """One index for each part of the benchmark that fits into INDEX_BYTES; all score by the statistics of the whole."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()[0]["n"]
    parts = max(1, -(-size // INDEX_BYTES))
    if parts == 1:
        rows = items.orderBy("item_id", "text").collect()
        yield Index([r["item_id"] for r in rows], [r["text"] for r in rows])
        return
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    counted = common.stored(item_terms(dealt), "decontam-terms")
    n = counted.where("term is null").agg(F.count("*").alias("items"), F.sum("n").alias("words"), F.max("n").alias("longest")).collect()[0]
    df = common.stored(counted.where("term is not null").groupBy("term").agg(F.count("*").alias("df"), F.collect_set("part").alias("parts")), "decontam-df")
    for k in range(parts):
        rows = dealt.where(F.col("part") == k).orderBy("item_id", "text").collect()
        here = df.where(F.array_contains("parts", k)).select("term", "df").toArrow()
        vocabulary = here.column("term").to_numpy().view(np.uint64)
        order = np.argsort(vocabulary)
        whole = Statistics(n["items"], n["words"], n["longest"], vocabulary[order], here.column("df").to_numpy()[order]) if n["items"] else None
        yield Index([r["item_id"] for r in rows], [r["text"] for r in rows], whole)


PAIRS = "doc_id long, item_id long, score_share double, question_overlap double, answer_overlap double"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All verified pairs of a document and a benchmark item."""
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for block, buf, off in common.blocks(batch, "text", lower=True):
                    found = index.matches(buf, off)
                    if found:
                        ids = block.column("doc_id").to_pylist()
                        columns = zip(*((ids[doc], index.ids[item], *numbers) for (doc, item), numbers in sorted(found.items())))
                        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in PAIRS.split(", ")])

        part = rows.mapInArrow(run, PAIRS)
        out = part if out is None else out.unionByName(part)
    return out


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that match no item, with all their columns."""
    out, schema = docs, docs.schema
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, buf, off in common.blocks(batch, "text", lower=True):
                    bad = {doc for doc, _ in shared.value.matches(buf, off)}
                    yield block.filter(pa.array([i not in bad for i in range(block.num_rows)], pa.bool_())) if bad else block

        out = out.mapInArrow(run, schema)
    return out
