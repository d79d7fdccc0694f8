"""The persisted text index: changes in segments against an index built anew, merges, cut-off writes, many queries at once; Porter's rules."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from siltstone.functions.porter import porter, porter_sql
from siltstone.operators import text_index
from siltstone.operators.text_index import TextIndex

DOCS = "path string, text string"
WORDS = "connect connected connecting connection login logins session sessions cache cached caches retry retries query queries parser соединение соединения error errors".split()

#: word: stem, from the examples of the published algorithm.
PUBLISHED = dict(x.split(":") for x in """caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size
hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc hesitanci:hesit digitizer:digit conformabli:conform
radicalli:radic differentli:differ vileli:vile analogousli:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit
sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electriciti:electr electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop
adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt homologou:homolog communism:commun activate:activ angulariti:angular homologous:homolog effective:effect
bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll is:is a1:a1 é:é ошибки:ошибки""".split())


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def corpus(n, seed=1):
    rng = random.Random(seed)
    return {f"src/m{i % 7}/f{i}.py": " ".join(rng.choices(WORDS, k=rng.randrange(3, 30))) for i in range(n)}


def answers(index, queries):
    """By query: the best paths. All queries are one plan."""
    got = {q: [] for q in queries}
    for r in index.search_many(table(index.spark, [(q, q) for q in queries], "query_id string, text string"), 15).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["path"], round(r["score"], 4), r["mode"]))
    return got


QUERIES = ["connection errors", "retry", "cached sessions login", "src", "соединений", "nowhere at all"]


def test_stems_are_those_of_the_published_examples(spark):
    got = {r[0]: r[1] for r in table(spark, [(w,) for w in PUBLISHED], "w string").select("w", porter(F.col("w"))).collect()}
    assert got == PUBLISHED


def test_stems_in_sql_are_the_same(spark, sf):
    words = spark.read.parquet(f"{sf}/documents.parquet").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w")).distinct()
    rng = random.Random(3)
    made = table(spark, [("".join(rng.choices("aeiouybcdlst", k=rng.randrange(1, 9))) + rng.choice(["", "s", "ed", "ing", "ies", "ational", "ness", "ement", "ion", "ll", "e", "y"]),) for _ in range(3000)], "w string")
    got = {r[0]: r[1] for r in words.union(made).distinct().select("w", porter(F.col("w"))).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE words AS SELECT unnest(?) AS w", [list(got)])
    assert dict(con.execute(f"SELECT w, stem FROM {porter_sql('words', 'w')}").fetchall()) == got


def test_changed_indexes_answer_like_new_ones(spark, tmp_path):
    """Five changes with deletions: tiers are merged on the way, scores stay those of an index of the live documents."""
    docs, rng = corpus(120), random.Random(5)
    path = F.col("path")
    index = TextIndex.build(table(spark, list(docs.items())), "path", F.col("text"), f"file://{tmp_path}/live", path)
    for k in range(5):
        changed = {p: t + " parser login" for p, t in rng.sample(sorted(docs.items()), 4)} | {f"new/n{k}.py": "fresh connection session"}
        gone = [p for p in rng.sample(sorted(docs), 3) if p not in changed]
        before = {s["segment"] for s in index.live(index.segments())}
        index.change(table(spark, list(changed.items())), F.col("text"), path, table(spark, [(p,) for p in [*gone, "never/there.py"]], "path string"))
        assert index.segments()[-1]["segment"] not in before
        docs = {p: t for p, t in (docs | changed).items() if p not in gone}
    assert index.segments()[-1]["total"] == len(docs) and len(index.live(index.segments())) < 6
    fresh = TextIndex.build(table(spark, list(docs.items())), "path", F.col("text"), f"file://{tmp_path}/fresh", path)
    want = answers(fresh, QUERIES)
    assert answers(index, QUERIES) == want and want["nowhere at all"] == [] and want["connection errors"]
    index.merge()
    assert len(index.live(index.segments())) == 1 and answers(index, QUERIES) == want


def test_a_bucket_of_many_documents_is_written_by_many_tasks(spark):
    """No task gets more than the postings of a bucket in some 2^17 documents, however many there are."""
    index = TextIndex(spark, "file:///none", "key", "long")
    dealt = index._dealt(spark.range(20_000).select(F.col("id").alias("key"), F.lit(3).alias("bucket")), 3_000_000)
    counts = [r["count"] for r in dealt.groupBy("bucket", "slice").count().collect()]
    assert sum(counts) == 20_000 and len(counts) >= 20 and max(counts) < 1500


def test_no_file_of_an_old_segment_is_touched(spark, tmp_path):
    files = lambda: {r["path"]: r["modificationTime"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"file://{tmp_path}/i").select("path", "modificationTime").collect()}
    index = TextIndex.build(table(spark, list(corpus(100).items())), "path", F.col("text"), f"file://{tmp_path}/i")
    before = files()
    index.change(table(spark, [("src/m0/f0.py", "other words")]), F.col("text"), gone=table(spark, [("src/m1/f1.py",)], "path string"))
    assert before.items() <= files().items()
    assert index.segments()[-1]["total"] == 99


def test_a_write_that_was_cut_off_does_not_count(spark, tmp_path, monkeypatch):
    index = TextIndex.build(table(spark, [("a", "login"), ("b", "session")]), "path", F.col("text"), f"file://{tmp_path}/i")
    want = answers(index, ["login", "session"])

    def broken(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(TextIndex, "_enter", broken)
    with pytest.raises(RuntimeError, match="lost"):
        index.change(table(spark, [("c", "login login"), ("a", "gone")]), F.col("text"))
    monkeypatch.undo()
    assert answers(index, ["login", "session"]) == want
    index.change(table(spark, [("d", "login")]), F.col("text"))
    assert [p for p, *_ in answers(index, ["login"])["login"]] == ["a", "d"] and answers(index, ["gone"])["gone"] == []  # nothing of the lost one is left


def test_odd_documents(spark, tmp_path):
    rows = [("a", None), ("b", ""), (None, "login"), ("c", "login " * 20_000), ("d", "ein login")]
    index = TextIndex.build(table(spark, rows), "path", F.col("text"), f"file://{tmp_path}/i")
    assert index.segments()[-1]["total"] == 4
    assert {p for p, *_ in answers(index, ["login"])["login"]} == {"c", "d"}
    empty = TextIndex.build(table(spark, []), "path", F.col("text"), f"file://{tmp_path}/e")
    assert empty.search("login").collect() == []
    empty.change(table(spark, rows), F.col("text"))
    assert {p for p, *_ in answers(empty, ["login"])["login"]} == {"c", "d"}


def test_many_queries_get_the_answers_of_single_ones(spark, tmp_path, monkeypatch):
    index = TextIndex.build(table(spark, list(corpus(80).items())), "path", F.col("text"), f"file://{tmp_path}/i", F.col("path"))
    single = {q: [(r["path"], round(r["score"], 4), r["mode"]) for r in index.search(q, 15).collect()] for q in QUERIES[:1] + QUERIES[4:5]}
    queries = table(spark, [(q, q) for q in [*single, "nowhere at all", ""]] + [("none", None)], "query_id string, text string")

    def many():
        got = {}
        for r in index.search_many(queries, 15).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["path"], round(r["score"], 4), r["mode"]))
        return got

    assert many() == {q: rows for q, rows in single.items() if rows}
    monkeypatch.setattr(text_index, "BROADCAST_WORDS", 1)  # large query sets: nothing is broadcast or pushed down
    monkeypatch.setattr(text_index, "PUSHED_WORDS", 0)
    assert many() == {q: rows for q, rows in single.items() if rows}
