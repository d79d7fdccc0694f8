"""Language-model scores: a unigram base over exact corpus counts, and a log-bilinear neural model.

Counts cover every training document: tasks count words locally, a shuffle sums them, and the table of counts stays
distributed. Words are known by a 64-bit hash. The words with the highest counts (at most FREQUENT) are broadcast;
the counts of all others meet the documents in a join on the word.

The log-bilinear model predicts the next token's class from the two tokens before it:

    P(class | u, v) = softmax(Q (E1[v] + E2[u]) + b)

The most frequent tokens are classes of their own; every other word falls into one of the letter classes, by its first
letter, and has within it the share (c + 1) / (sum of (c + 1) over the class + 1), the last 1 being for words never
seen. Class and share make a normalised distribution over tokens. The numbers of such classes and of words with inputs
of their own grow with the training tokens (`sizes`). The parameters are fitted in numpy by noise-contrastive estimation
against the unigram distribution of the classes: a start on about SAMPLE_ROWS documents, then a pass over all training
documents, in which every partition goes on from the start and the changes of a row are averaged over partitions,
weighted by its uses. Batched matrix products with a full softmax then score all tokens of all documents.

Defined results: a null or empty text is its end token alone; without training documents all counts are 0; rows with
null or repeated doc_id are scored like any other and count as training rows where the id is null; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .langid import fold

FREQUENT = 400_000
SINGLES = 128
INPUTS = 2048
WIDTH = 16
SAMPLE_ROWS = 2_000
NOISE, EPOCHS, BATCH, RATE = 10, 3, 2048, 0.15
PASS_NOISE, PASS_BATCH = 32, 1024  # of the pass over all documents; a batch shares its noise
MERGE = 1 << 20
CHUNK = 512  # tokens scored together

END = np.uint64(0x5EED0FE2D0C0FFEE)
_CLASS_OF_BYTE = np.full(256, 31, np.int64)  # 26 letters, 5 groups of other first bytes, the rest
_CLASS_OF_BYTE[97:123] = np.arange(26)
_CLASS_OF_BYTE[65:91] = np.arange(26)
LETTER_CLASSES = 32


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and letter classes of the words with an end after each text, and where each text begins (n+1 values)."""
    starts, ends, at = common.word_spans(buf, off)
    h = common.word_hashes(buf, starts, ends)
    first = buf[starts] if len(starts) else np.zeros(0, np.uint8)
    cls = _CLASS_OF_BYTE[first]
    wide = np.flatnonzero(first >= 128)
    cls[wide] = 26 + buf[np.minimum(starts[wide] + 1, len(buf) - 1)] % 5
    stop = at[1:]
    return np.insert(h, stop, END), np.insert(cls, stop, -1), at + np.arange(len(at))


def count_words(docs: DataFrame) -> DataFrame:
    """word, cls, n over all documents; the end token has class -1."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word, cls, n = (np.concatenate(x) for x in zip(*parts))
        unique, first, back = np.unique(word, return_index=True, return_inverse=True)
        return unique, cls[first], np.bincount(back, n).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for _, buf, off in common.blocks(batch, "text"):
                h, cls, _ = tokens(buf, off)
                unique, first, n = np.unique(h, return_index=True, return_counts=True)
                parts.append((unique, cls[first], n))
                held += len(unique)
                if held > MERGE:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held > MERGE // 2:
                        yield from _count_rows(parts.pop())
                        held = 0
        if parts:
            yield from _count_rows(merged(parts))

    local = docs.select(F.col("text").cast("string")).mapInArrow(run, "word long, cls int, n long")
    return local.groupBy("word").agg(F.max("cls").alias("cls"), F.sum("n").alias("n"))


def _count_rows(counted: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    word, cls, n = counted
    for a in range(0, len(word), 100_000):
        part = slice(a, a + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(common.signed(word[part])), pa.array(cls[part].astype(np.int32)), pa.array(n[part])], ["word", "cls", "n"])


def sizes(total: int) -> tuple[int, int]:
    """(classes of a single token, words with an input of their own) for a number of training tokens."""
    return max(SINGLES, int(np.cbrt(total))), max(INPUTS, int(np.sqrt(total)))


class Vocabulary:
    """The frequent words, sorted by hash: counts, classes (singles first, then letter classes) and input numbers."""

    def __init__(self, word: np.ndarray, cls: np.ndarray, n: np.ndarray, letter_totals: np.ndarray, total: int, size: int, least: int) -> None:
        by_count = np.lexsort((word, -n))
        rank = np.empty(len(word), np.int64)
        rank[by_count] = np.arange(len(word))
        rank[word == END] = -1
        rank = np.argsort(np.argsort(rank, kind="stable"), kind="stable") if len(word) else rank
        self.word, self.n = word, n
        self.singles, self.inputs = sizes(total)
        self.cls = np.where(rank < self.singles, rank, self.singles + cls)
        self.input = np.where(rank < self.inputs, rank, self.inputs + cls)
        self.total, self.size, self.least = total, size, least
        # What the letter classes hold without the singles, one place more for words never seen.
        single = (rank < self.singles) & (cls >= 0)
        self.letters = letter_totals - np.bincount(cls[single], n[single] + 1.0, LETTER_CLASSES) + 1.0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Positions of hashes among the frequent words, -1 for others."""
        if not len(self.word):
            return np.full(len(h), -1)
        unique, back = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(self.word, unique), len(self.word) - 1)
        return np.where(self.word[at] == unique, at, -1)[back]


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Collects the words above a count that at most FREQUENT words reach, and totals by letter class."""
    step = F.floor(F.log2("n") * 8).cast("int")
    levels = {r["step"]: r for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()}
    least, words = 1 << 62, 0
    for k in sorted(levels, reverse=True):
        words += levels[k]["words"]
        if words > FREQUENT:
            break
        least = levels[k]["least"]
    sums = counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    letters = np.zeros(LETTER_CLASSES)
    for r in sums:
        if r["cls"] >= 0:
            letters[r["cls"]] = r["n"] + r["words"]
    got = counts.where((F.col("n") >= least) | (F.col("cls") == -1)).toArrow()
    word = got.column("word").to_numpy().view(np.uint64)
    order = np.argsort(word)
    return Vocabulary(word[order], got.column("cls").to_numpy().astype(np.int64)[order], got.column("n").to_numpy()[order], letters, sum(r["n"] for r in sums), sum(r["words"] for r in sums), least)


CLASSES = SINGLES + LETTER_CLASSES


def encode(v: Vocabulary, h: np.ndarray, letter: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: its place among the frequent words, its class, and the input numbers of the two tokens before."""
    place = v.find(h)
    known = place >= 0
    cls = np.where(letter >= 0, v.singles + letter, 0)
    number = np.where(letter >= 0, v.inputs + letter, 0)
    start = v.inputs + LETTER_CLASSES
    cls[known], number[known] = v.cls[place[known]], v.input[place[known]]
    before = np.empty((2, len(h)), np.int64)
    before[0, 1:], before[1, 2:] = number[:-1], number[:-2]
    first = at[:-1]
    before[:, first] = start
    second = first[np.diff(at) > 1] + 1
    before[1, second] = start
    return place, cls, before[0], before[1]


class LogBilinear:
    def __init__(self, e1: np.ndarray, e2: np.ndarray, q: np.ndarray, b: np.ndarray, sums: tuple[np.ndarray, ...] = (), noise: np.ndarray | None = None) -> None:
        """sums: squared gradients so far of e1, e2, q and b; noise: the probabilities of the noise."""
        self.e1, self.e2, self.q, self.b, self.sums, self.noise = e1, e2, q, b, sums, noise

    def log10(self, cls: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of the classes, a few hundred tokens to a matrix product, so that its rows stay in the cache."""
        out = np.empty(len(cls))
        qb = np.ascontiguousarray(np.column_stack([self.q, self.b]).T)
        h, scores = np.ones((CHUNK, self.q.shape[1] + 1), np.float32), np.empty((CHUNK, len(self.b)), np.float32)
        for a in range(0, len(cls), CHUNK):
            part = slice(a, a + CHUNK)
            n = len(cls[part])
            np.add(self.e1[one[part]], self.e2[two[part]], out=h[:n, :-1])
            s = np.matmul(h[:n], qb, out=scores[:n])
            s -= s.max(1)[:, None]
            wanted = s[np.arange(n), cls[part]].astype(np.float64)
            np.exp(s, out=s)
            out[part] = wanted - np.log(s.sum(1, dtype=np.float64))
        return out / np.log(10.0)


def fit(cls: np.ndarray, one: np.ndarray, two: np.ndarray, seed: int = 11, singles: int = SINGLES, inputs: int = INPUTS) -> LogBilinear:
    """Noise-contrastive estimation with Adagrad; the noise is the unigram distribution of the classes."""
    rng = np.random.default_rng(seed)
    classes = singles + LETTER_CLASSES
    freq = np.bincount(cls, minlength=classes) + 0.5
    noise = freq / freq.sum()
    edges = np.cumsum(noise)[:-1]
    log_kq = np.log(NOISE * noise)
    b = np.log(noise)
    q = rng.normal(0, 0.1, (classes, WIDTH))
    e1, e2 = (rng.normal(0, 0.1, (inputs + LETTER_CLASSES + 1, WIDTH)) for _ in range(2))
    sums = [np.full(x.shape, 1e-2) for x in (q, e1, e2, b)]

    def descend(x: np.ndarray, total: np.ndarray, index: np.ndarray, grad: np.ndarray) -> None:
        rows, back = np.unique(index, return_inverse=True)
        g = np.stack([np.bincount(back, grad[:, d], len(rows)) for d in range(grad.shape[1])], 1)
        g = g.reshape((len(rows), *x.shape[1:]))
        total[rows] += g * g
        x[rows] -= RATE * g / np.sqrt(total[rows])

    for _ in range(EPOCHS):
        order = rng.permutation(len(cls))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            h = e1[one[part]] + e2[two[part]]
            target = np.concatenate([cls[part, None], np.searchsorted(edges, rng.random((len(part), NOISE)))], 1)
            qt = q[target]
            s = np.einsum("nd,nkd->nk", h, qt) + b[target] - log_kq[target]
            g = 1.0 / (1.0 + np.exp(-np.clip(s, -30, 30)))
            g[:, 0] -= 1.0
            dh = np.einsum("nk,nkd->nd", g, qt)
            flat = target.ravel()
            descend(q, sums[0], flat, (g[:, :, None] * h[:, None, :]).reshape(-1, WIDTH))
            descend(b, sums[3], flat, g.reshape(-1, 1))
            descend(e1, sums[1], one[part], dh)
            descend(e2, sums[2], two[part], dh)
    return LogBilinear(*(x.astype(np.float32) for x in (e1, e2, q, b)), tuple(sums[i].astype(np.float32) for i in (1, 2, 0, 3)), noise)


class Learner:
    """Goes on with noise-contrastive estimation from a model, on its own copy; counts the uses of each row."""

    def __init__(self, m: LogBilinear, seed: int) -> None:
        self.rng, self.noise = np.random.default_rng(seed), m.noise
        self.edges = np.cumsum(m.noise)[:-1]
        self.log_kq = np.log(PASS_NOISE * m.noise).astype(np.float32)
        self.start = m.e1, m.e2, np.column_stack([m.q, m.b])  # a class's bias is the last value of its row
        self.tables = tuple(x.copy() for x in self.start)
        self.sums = m.sums[0].copy(), m.sums[1].copy(), np.column_stack([m.sums[2], m.sums[3]])
        self.uses = tuple(np.zeros(len(x), np.int64) for x in self.start)

    def descend(self, k: int, index: np.ndarray, grad: np.ndarray) -> None:
        order = np.argsort(index, kind="stable")
        rows, first = np.unique(index[order], return_index=True)
        g = np.add.reduceat(grad[order], first, axis=0)
        self.uses[k][rows] += np.diff(np.append(first, len(order)))
        self.sums[k][rows] += g * g
        self.tables[k][rows] -= np.float32(RATE) * g / np.sqrt(self.sums[k][rows])

    def learn(self, cls: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        e1, e2, qb = self.tables
        for a in range(0, len(cls), PASS_BATCH):
            part = slice(a, a + PASS_BATCH)
            h = np.column_stack([e1[one[part]] + e2[two[part]], np.ones(len(cls[part]), np.float32)])
            drawn = np.searchsorted(self.edges, self.rng.random(PASS_NOISE))
            true, false = qb[cls[part]], qb[drawn]
            g = -1.0 / (1.0 + np.exp(np.clip((h * true).sum(1) - self.log_kq[cls[part]], -30, 30)))
            gn = 1.0 / (1.0 + np.exp(-np.clip(h @ false.T - self.log_kq[drawn], -30, 30)))
            dh = (g[:, None] * true + gn @ false)[:, :-1]
            self.descend(2, np.concatenate([cls[part], drawn]), np.concatenate([g[:, None] * h, gn.T @ h]))
            self.descend(0, one[part], dh)
            self.descend(1, two[part], dh)


_VALUES = [f"v{d}" for d in range(WIDTH + 1)]
CHANGES = "kind int, place int, uses long, " + ", ".join(f"{c} float" for c in _VALUES)


def learn_all(docs: DataFrame, v, start) -> LogBilinear:
    """The model after a pass over all documents; start and v are broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(start.value, TaskContext.get().partitionId())
        for batch in batches:
            for _, buf, off in common.blocks(batch, "text", 1 << 20):
                learner.learn(*encode(v.value, *tokens(buf, off))[1:])
        for kind in range(3):
            rows = np.flatnonzero(learner.uses[kind])
            change = (learner.tables[kind][rows] - learner.start[kind][rows]) * learner.uses[kind][rows, None]
            values = [pa.array((change[:, d] if d < change.shape[1] else np.zeros(len(rows))).astype(np.float32)) for d in range(WIDTH + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int32)), pa.array(rows.astype(np.int32)), pa.array(learner.uses[kind][rows]), *values], ["kind", "place", "uses", *_VALUES])

    changes = docs.select(F.col("text").cast("string")).mapInArrow(run, CHANGES)
    got = changes.groupBy("kind", "place").agg(F.sum("uses").alias("uses"), *((F.sum(c) / F.sum("uses")).cast("float").alias(c) for c in _VALUES)).toArrow()
    kind, place = got.column("kind").to_numpy(), got.column("place").to_numpy()
    change = np.column_stack([got.column(c).to_numpy() for c in _VALUES]).astype(np.float32).reshape(len(kind), WIDTH + 1)
    m = start.value
    e1, e2, qb = m.e1.copy(), m.e2.copy(), np.column_stack([m.q, m.b])
    for k, x in enumerate((e1, e2, qb)):
        x[place[kind == k]] += change[kind == k][:, : x.shape[1]]
    return LogBilinear(e1, e2, np.ascontiguousarray(qb[:, :-1]), qb[:, -1].copy())


def sample(docs: DataFrame, v, total_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, inputs) of the tokens of about SAMPLE_ROWS documents, chosen by a hash of doc_id."""
    every = max(1, -(-total_rows // SAMPLE_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, off in common.blocks(batch, "text"):
                _, cls, one, two = encode(v.value, *tokens(buf, off))
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (cls, one, two)], ["cls", "one", "two"])

    rows = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select(F.col("text").cast("string"))
    got = rows.mapInArrow(run, "cls int, one int, two int").toArrow()
    return tuple(got.column(c).to_numpy().astype(np.int64) for c in ("cls", "one", "two"))


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, words array<long>, times array<int>"


def scored(docs: DataFrame, v, model) -> DataFrame:
    """Per document what the frequent words give, and its other words with their number of times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, voc = TaskContext.get().partitionId() << 33, 0, v.value
        log_n = np.log10(voc.n + 1.0)
        log_letters = np.log10(voc.letters)
        for batch in batches:
            for block, buf, off in common.blocks(batch, "text", 1 << 20):
                h, letter, at = tokens(buf, off)
                place, cls, one, two = encode(voc, h, letter, at)
                known = place >= 0
                share = np.where(known, log_n[place] if len(log_n) else 0.0, 0.0)
                lp = model.value.log10(cls, one, two)
                inside = cls >= voc.singles
                lp[inside] += share[inside] - log_letters[cls[inside] - voc.singles]
                counts = np.diff(at)
                base = np.add.reduceat(share, at[:-1])
                other = np.flatnonzero(~known & (letter >= 0))
                doc = np.repeat(np.arange(len(counts)), counts)[other]
                order = np.lexsort((h[other], doc))
                doc, word = doc[order], h[other][order]
                new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (word[1:] != word[:-1]))) if len(doc) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(doc)))
                ends = pa.array(np.searchsorted(doc[new], np.arange(len(counts) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part + row + np.arange(len(counts))), block.column("doc_id"), block.column("held_out"), pa.array(counts.astype(np.int64)),
                        pa.array(np.add.reduceat(known.astype(np.int64), at[:-1])), pa.array(base), pa.array(np.add.reduceat(lp, at[:-1])),
                        pa.ListArray.from_arrays(ends, pa.array(common.signed(word[new]))), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32))),
                    ],
                    [c.split()[0] for c in SCORED.split(", ")],
                )
                row += len(counts)

    return docs.select("doc_id", "held_out", F.col("text").cast("string")).mapInArrow(run, SCORED)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False)).alias("held_out"))
    learned = rows.where(~F.col("held_out"))
    counts = common.stored(count_words(learned), "lm-counts")
    v = vocabulary(counts)
    shared = spark.sparkContext.broadcast(v)
    documents = int(v.n[v.word == END].sum())
    start = spark.sparkContext.broadcast(fit(*sample(learned, shared, documents), singles=v.singles, inputs=v.inputs))
    model = spark.sparkContext.broadcast(learn_all(learned, shared, start))
    each = common.stored(scored(rows, shared, model), "lm-scored")
    other = each.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    found = other.join(counts.where(F.col("n") < v.least).select("word", "n"), "word")
    sums = found.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("found"))
    more = F.coalesce("more", F.lit(0.0))
    floor = F.lit(float(np.log10(v.total + v.size + 1.0)))
    return each.drop("words", "times").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * floor).alias("base_score"), (F.col("model") + more).alias("score"),
    )
