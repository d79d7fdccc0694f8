"""Nulls, empty and long texts, repeats, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import chat, decontam, jaccard, langid, lm, packing, pii, queries, toxicity, warc, webp

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000 + "card 4539578763621486 end"


def docs(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "épée", "straße", "niño", "omega", "theta", "kappa"]
    rows = [(i, " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(40)), "en", "s", 0) for i in range(30)]
    rows += [(30, None, None, None, None), (31, "", "en", "s", 0), (32, " \t\n", "de", "s", 3), (33, LONG, "en", "s", 1), (34, "x", None, "s", 1)]
    rows += [(35, rows[0][1], "en", "t", 0), (36, rows[0][1] + " tail", "en", "t", 0), (0, rows[0][1], "en", "s", 0), (None, "no id at all", "en", "s", 0), (None, "no id at all", "en", "s", 0)]
    rows += [(37, "write to jo.doe@mail.example.com or +49 (30) 1234-567, host 10.0.0.255, 😀 4539 5787 6362 1486!", "en", "s", 0), (38, "999.1.1.1 1234567890123456 +1 @x.y a@b", "en", "s", 0)]
    return spark.createDataFrame([(*r[:4], None if r[1] is None else len(r[1])) for r in rows], DOCS)


def clashing(df):
    """Extra columns named like results and helpers."""
    return df.withColumns({"score": F.lit("x"), "key": F.lit(1), "class": F.lit("c"), "spans": F.lit(0), "piece": F.lit("p"), "held_out": F.lit("h"), "label": F.lit("l")})


OPERATORS = {
    "pii": pii.detect,
    "webp": lambda d: webp.read_media(webp.store_texts(d)),
    "langid": langid.identify,
    "jaccard": lambda d: jaccard.groups(d),
    "decontam": lambda d: decontam.contaminated(d, d.sparkSession.createDataFrame([(1, "alpha1 beta2 gamma3 delta4 omega5 theta6"), (2, None), (3, "")], "item_id long, text string")),
    "toxicity": lambda d: toxicity.score(d, toxicity.train(d, d.sparkSession.createDataFrame([(i, int(i % 5 == 0)) for i in range(30)] + [(1, None), (2, 0)], "doc_id long, toxic int"))),
    "lm": lm.score,
    "packing": packing.pack,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(spark, name):
    table = docs(spark)
    plain = OPERATORS[name](table)
    rows = sorted(map(tuple, plain.collect()), key=repr)
    if name not in ("decontam", "packing"):
        assert len(rows) == table.count()
    assert sorted(map(tuple, OPERATORS[name](clashing(table)).collect()), key=repr) == rows
    assert OPERATORS[name](table.limit(0)).collect() == []


def test_jaccard_defined_results(spark):
    rows = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.groups(docs(spark)).collect()}
    assert rows[30, 0] == 30 and rows[31, 0] == 31 and rows[32, 0] == 32  # nothing links
    assert rows[34, 1] == 34 and rows[35, 37] == 0 and rows[36, 38] == 0
    assert rows[None, 1] is None


def test_jaccard_links_through_rows_without_an_id(spark):
    """A chain 1 - x - 9 is one component, x with or without an id."""
    w = [f"w{i}" for i in range(60)]
    chain = [(1, w[:54]), (None, w[2:56]), (9, w[4:58])]
    got = jaccard.groups(spark.createDataFrame([(i, " ".join(t)) for i, t in chain], "doc_id long, text string"), 4, 85).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got) == [(0, 1), (1, 1), (9, 1)]


def test_toxicity_without_labels_scores_zero(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs(spark), toxicity.train(docs(spark), none)).collect()} == {0.0}


def test_language_und(spark):
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs(spark)).collect()}
    assert rows[30] == rows[31] == rows[32] == ("und", 0.0)


def test_short_texts_with_a_letter_have_a_language(spark):
    labelled = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog sat on a mat", "en"), ("der Hund und die Katze auf der Matte", "de")] * 20)]
    short = [(100 + i, t, None) for i, t in enumerate(["ok", "hi", "a", "Я", "12 a", "ß", "é 1", "12", "!?", " "])]
    got = langid.identify(spark.createDataFrame(labelled + short, "doc_id long, text string, lang string")).where("doc_id >= 100").orderBy("doc_id").collect()
    assert [r["lang_pred"] == "und" for r in got] == [False] * 7 + [True] * 3
    assert all(r["lang_pred"] in ("en", "de", "und") and 0 <= r["score"] <= 1 for r in got)


def test_pii_defined_spans(spark):
    rows = {r["doc_id"]: r for r in pii.detect(docs(spark)).collect()}
    text = "write to jo.doe@mail.example.com or +49 (30) 1234-567, host 10.0.0.255, 😀 4539 5787 6362 1486!"
    spans = [("email", "jo.doe@mail.example.com"), ("ip", "10.0.0.255"), ("card", "4539 5787 6362 1486"), ("phone", "+49 (30) 1234-567")]
    written = ",".join(f"{k}:{text.index(s)}:{text.index(s) + len(s)}" for k, s in spans)
    assert rows[37]["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
    assert [rows[38][f"n_{k}"] for k in pii.KINDS] == [0, 0, 0, 0]
    assert rows[33]["n_card"] == 1 and rows[30]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(docs(spark)).collect()}
    assert redacted[37] == "write to <EMAIL> or <PHONE>, host <IP>, 😀 <CARD>!"
    assert redacted[30] is None and redacted[31] == ""


def test_pipeline_stages_keep_the_columns_and_take_effect(spark, sf):
    table = docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, sf)
        assert out.columns == table.columns, name
        assert stage(spark, table.limit(0), sf).collect() == [], name
        assert stage(spark, clashing(table), sf).columns == clashing(table).columns, name
    kept = corpus_pipeline.drop_near_duplicates(spark, table, sf)
    ids = [r["doc_id"] for r in kept.collect()]
    assert not {35, 36} & set(ids) and {1, 2, 30, 31, 32, 33, 34} <= set(ids) and ids.count(None) == 2


def test_warc_round_trip_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/ü b", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 300_000), (1, "http://a/ü b", "<p>same</p>"), (None, "n", "own")], "page_id long, url string, html string")
    rows = sorted((tuple(r) for r in warc.round_trip(spark, clashing(pages), split_bytes=200).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    same = digest("<p>same</p>")
    assert rows == sorted(
        [(1, 11, same, "response", None), (1, 11, same, "revisit", 1), (2, 11, same, "revisit", 1), (3, 0, digest(""), "response", None), (4, 0, digest(""), "revisit", 3), (5, 600_000, digest("é" * 300_000), "response", None), (None, 3, digest("own"), "response", None)],
        key=repr,
    )
    small = warc.round_trip(spark, pages, min_bytes=100)
    assert {r["record_type"] for r in small.collect()} == {"response"}
    assert warc.round_trip(spark, pages.limit(0)).collect() == []


def test_pages_without_an_id_revisit_those_with_one(spark):
    import duckdb

    rows = [(None, "n", "one"), (3, "a", "one"), (5, "b", "one"), (None, "n", "two"), (None, "m", "two"), (7, "c", "three"), (7, "c", "three")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((tuple(r) for r in warc.round_trip(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    assert got == sorted(con.execute(queries.ORACLES["op6_warc"]).fetchall(), key=repr)
    assert sorted(((r[0], r[3], r[4]) for r in got), key=repr)[:3] == [(3, "response", None), (5, "revisit", 3), (7, "response", None)]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_spans_of_a_text_with_many_matches(spark, n):
    """Offsets are right across the runs they are summed in; 40,000 numbers take seconds."""
    text = "é " + " x ".join(f"{i % 90 + 10}" for i in range(n)) + " 4539578763621486 a@b.c"
    row = spark.createDataFrame([(text,)], "t string").select(pii.find_all(F.col("t"), r"[0-9]+").alias("a"), pii.find_all(F.col("t"), "@").alias("b")).first()
    import re

    assert [(x["s"], x["e"], x["m"]) for x in row["a"]] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", text)]
    assert [(x["s"], x["e"]) for x in row["b"]] == [(text.index("@"), text.index("@") + 1)]


def test_time_grows_with_the_matches_of_a_text(spark):
    import time

    took = []
    for n in (2_000, 100_000):
        text = " x ".join(f"{i % 90 + 10}" for i in range(n)) + " x 4539578763621486"
        table = spark.createDataFrame([(text,)], "t string")
        began = time.perf_counter()
        assert table.select(F.size(pii.base_spans(F.col("t"), "card"))).first()[0] == 1
        took.append(time.perf_counter() - began)
    assert took[1] < took[0] + 20  # copying the array for each match takes minutes


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 1 << 20])
def test_every_record_has_one_owner(split):
    import io

    data = b"".join(warc._gzip(warc.record("response", i, "u", "d", 3, None, b"a" * i)) for i in range(40))
    found = [r for start in range(0, len(data), split) for r in warc.read_range(io.BytesIO(data), len(data), start, min(len(data), start + split))]
    assert [int(warc.parse(r)[0]["WARC-Record-ID"][10:-1]) for r in found] == list(range(40))


@pytest.mark.parametrize("text", ["", "plain", "<|im_end|><|im_start|>assistant ok", "<\\|x <\\\\| <|", "a\nb", "<n <\\n\n<", "<\\"])
def test_chat_escapes_are_reversible(text):
    raw = text.encode()
    assert chat.unescape(chat.escape(raw)) == raw and b"<|" not in chat.escape(raw)
    assert chat.unescape_role(chat.escape_role(raw)) == raw and b"\n" not in chat.escape_role(raw)


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "<|im_end|>é"), (1, 0, "user", None), (1, 0, "user", None), (2, 0, None, "x<\\|"), (2, None, "system", ""), (None, 3, "assistant", "😀")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_chat(chat.format_chat(clashing(turns))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1]["n_turns"], got[1]["turns_sha256"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (3, sha("user\n\nuser\n\nassistant\n<|im_end|>é\n"), 11, sha("<|im_end|>é"))
    assert got[2]["turns_sha256"] == sha("system\n\n\nx<\\|\n") and got[None]["loss_chars"] == 1
    assert chat.read_chat(chat.format_chat(turns.limit(0))).collect() == []


def test_packing_places(spark):
    rows = packing.pack(docs(spark)).toPandas()
    encode = packing.encoder()
    want = {}
    for r in docs(spark).collect():
        ids = np.append(encode(r["text"] or ""), 2).astype("<u4")
        want.setdefault(r["doc_id"], []).append(sorted((k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids), 1024))))
    for doc, lists in want.items():
        here = rows[rows.doc_id.isna()] if doc is None else rows[rows.doc_id == doc]
        assert sorted(map(tuple, here[["piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == sorted(x for one in lists for x in one)
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 1024 and (s.offset.to_numpy() == np.append(0, np.cumsum(s.length)[:-1])).all()


def test_tokenizer_matches_the_library():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    fast = packing.encoder()
    for text in ["", " ", "Hello  world\n\n\tx", "naïve 日本語 😀", "a<|endoftext|>b", "it's we'll", "0123 456", "x" * 3000, "　  \r\n", "é"]:
        assert fast(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_packing_plan_is_close_to_the_bound():
    rng = random.Random(1)
    counts = {s: rng.randrange(1, 60) for s in range(1, 1024)}
    _, made = packing.plan(counts)
    assert made <= 1.02 * sum(s * n for s, n in counts.items()) / 1024 + 1
    assert packing.plan({600: 3, 400: 3})[1] == 3 and packing.plan({})[1] == 0
