"""Operators that work two ways give the same either way, and what has no SQL is held against plain Python."""

from __future__ import annotations

import collections
import difflib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.functions import terms, text
from siltstone.operators import graph, impact, retrieval, timeline
from siltstone.operators.text_index import TextIndex
from siltstone.plans import corpus


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(4)
    rows = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(150)} | {("n1", "n1"), ("lone", "n3")}
    return spark.createDataFrame(sorted(rows), "src string, dst string"), rows


def hops(arrows, start, depth):
    near, found, last = collections.defaultdict(set), {start: 0}, {start}
    for a, b in arrows:
        near[a].add(b)
    for hop in range(1, depth + 1):
        last = {b for a in last for b in near[a]} - set(found)
        found.update(dict.fromkeys(last, hop))
    return found


@pytest.mark.parametrize("limit", [0, graph.SMALL_EDGES])
def test_walks_on_the_driver_and_by_joins(spark, edges, monkeypatch, limit):
    monkeypatch.setattr(graph, "SMALL_EDGES", limit)
    df, rows = edges
    seeds = spark.createDataFrame([("n1",), ("lone",), ("absent",)], "node string")
    got = {(r["seed"], r["node"]): r["hop"] for r in graph.bfs(df, seeds, 3).collect()}
    assert got == {(s, n): h for s in ("n1", "lone", "absent") for n, h in hops(rows, s, 3).items()}


@pytest.mark.parametrize("limit", [0, graph.SMALL_EDGES])
@pytest.mark.parametrize("personalized", [False, True])
def test_ranks_on_the_driver_and_by_joins(spark, edges, monkeypatch, limit, personalized):
    monkeypatch.setattr(graph, "SMALL_EDGES", limit)
    df, rows = edges
    nodes = sorted({x for e in rows for x in e})
    number = {x: i for i, x in enumerate(nodes)}
    src, dst = (np.array([number[e[k]] for e in sorted(rows)]) for k in (0, 1))
    outs = np.bincount(src, minlength=len(nodes))
    weight = np.array([float(x in ("n1", "n2")) if personalized else 1.0 for x in nodes])
    jump, rank = weight / weight.sum(), np.full(len(nodes), 1 / len(nodes))
    for _ in range(500):
        rank = 0.15 * jump + 0.85 * rank[outs == 0].sum() * jump + 0.85 * np.bincount(dst, rank[src] / outs[src], len(nodes))
    teleport = spark.createDataFrame([("n1", 2.0), ("n2", 2.0), ("absent", 5.0), ("n3", None)], "node string, weight double") if personalized else None
    got = {r["node"]: r["rank"] for r in graph.pagerank(df, teleport=teleport, iterations=40 if limit == 0 else 100).collect()}
    assert set(got) == set(nodes)
    assert np.abs(np.array([got[x] for x in nodes]) - rank).sum() < (1e-2 if limit == 0 else 1e-6)


@pytest.mark.parametrize("personalized", [False, True])
@pytest.mark.parametrize("tolerance", [1e-8, 1e-3, None])
def test_ranks_of_graphs_without_cycles_are_sums_over_walks(spark, monkeypatch, personalized, tolerance):
    """The rounds of a power iteration, with its end, without a join for each of them."""
    rng = random.Random(6)
    rows = sorted({(f"{a}{rng.randrange(30)}", f"{b}{rng.randrange(12)}") for a, b in ("pq", "pq", "qs", "ps", "st") for _ in range(30)})
    df = spark.createDataFrame(rows, "src string, dst string").repartition(3)
    teleport = spark.createDataFrame([("s1", 2.0), ("q2", 1.0), ("q2", 0.5), ("absent", 5.0), ("p3", None)], "node string, weight double") if personalized else None
    want = {r["node"]: r["rank"] for r in graph.pagerank(df, teleport=teleport, tolerance=tolerance, iterations=23).collect()}
    monkeypatch.setattr(graph, "SMALL_EDGES", 0)
    by_joins = {r["node"]: r["rank"] for r in graph._joined_ranks(*_base(graph, df, teleport), 23, tolerance, 5).collect()}
    monkeypatch.setattr(graph, "_joined_ranks", None)
    got = {r["node"]: r["rank"] for r in graph.pagerank(df, teleport=teleport, tolerance=tolerance, iterations=23).collect()}
    assert got == pytest.approx(want, rel=1e-12, abs=1e-15) and by_joins == pytest.approx(want, rel=1e-12, abs=1e-15)


def _base(graph, edges, teleport):
    """What the loop of joins starts from: (nodes with outs and jumps, edges, first rank)."""
    rows = [(r["src"], r["dst"]) for r in edges.collect()]
    names = sorted({x for e in rows for x in e})
    outs = {x: sum(a == x for a, _ in rows) or None for x in names}
    weight = dict.fromkeys(names, 1.0 if teleport is None else 0.0)
    for r in teleport.collect() if teleport is not None else []:
        if r["node"] in weight:
            weight[r["node"]] += r["weight"] or 0.0
    total = sum(weight.values())
    return edges.sparkSession.createDataFrame([(x, outs[x], weight[x] / total) for x in names], "node string, outs long, jump double"), edges, 1.0 / len(names)


def test_ranks_in_order_of_ranges(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(50)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(5)
    got = {r["k"]: r["rank"] for r in retrieval.global_rank(df, [F.desc("v"), F.col("k")]).collect()}
    assert got == {k: i + 1 for i, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert retrieval.lower_median(df, "v").collect()[0]["mid"] == sorted(v for _, v in rows)[249]


def similarity(a, b):
    if a[1] and a[1] == b[1]:
        return 1.0
    if a[2] is None or b[2] is None:
        return 0.0
    x, y = a[2].rsplit(".", 1)[-1], b[2].rsplit(".", 1)[-1]
    return 0.9 if x == y else difflib.SequenceMatcher(None, x, y).ratio()


def test_renames_against_all_pairs(spark):
    """The greedy pairing of all removed with all added symbols, in the order of their ids."""
    rng = random.Random(8)
    words = ["parse", "parser", "parsed", "load_config", "load_configs", "loadConfig", "read_file", "read_files", "read_filex", "abcdefg", "abcdefh", "xbcdefg", "send", "sends", "handler", "handlers", "alpha", "omega"]
    rows = [("p", rng.choice(["removed", "added"]), f"s{i:03}", rng.choice([f"h{rng.randrange(25)}", None, ""]), rng.choice([None, *(f"m{rng.randrange(3)}.{w}" for w in words * 2)])) for i in range(160)]
    rows += [("p", "removed", "x1", "u1", "libs.retrieval.pipeline.engine.alphabet"), ("p", "added", "x2", "u2", "libs.retrieval.pipeline.engine.zzzzz")]
    events = spark.createDataFrame(rows, "block string, event_type string, symbol_id string, content_hash string, qualified_name string").repartition(3)
    side = {k: sorted((r[2], r[3], r[4]) for r in rows if r[1] == k) for k in ("removed", "added")}
    want, gone = set(), set()
    for a in side["removed"]:
        best = max(((similarity(a, b), -i, b) for i, b in enumerate(side["added"]) if b[0] not in gone), default=(0.0, 0, None))
        if best[0] >= 0.85:
            want.add((a[0], best[2][0], round(best[0], 9), best[0] < 1))
            gone |= {best[2][0]} if best[0] == 1 else set()
    got = {(r["removed_id"], r["added_id"], round(r["confidence"], 9), r["is_candidate"]) for r in timeline.rename_pairs(events, "block").collect()}
    assert got == want and any(0.85 <= c < 0.9 or 0.9 < c < 1 for _, _, c, _ in want)


def test_renames_measure_each_name_once(spark, monkeypatch):
    """Many symbols of few names: the names meet, not the symbols, and consumed ones still suit the smaller ids alone."""
    rng = random.Random(3)
    rows = [("b", rng.choice(["removed", "added"]), i, rng.choice([f"h{i % 90}", None]), f"m.dispatch_{rng.randrange(10, 22)}") for i in range(700)]
    events = spark.createDataFrame(rows, "block string, event_type string, symbol_id long, content_hash string, qualified_name string").repartition(5)
    side = {k: sorted((r[2], r[3], r[4]) for r in rows if r[1] == k) for k in ("removed", "added")}
    want, gone = set(), set()
    for a in side["removed"]:
        best = max(((similarity(a, b), -b[0]) for b in side["added"] if b[0] not in gone), default=(0.0, 0))
        if best[0] >= 0.85:
            want.add((a[0], -best[1], round(best[0], 9), best[0] < 1))
            gone |= {-best[1]} if best[0] == 1 else set()
    measured, near = [], timeline._near_names
    monkeypatch.setattr(timeline, "_near_names", lambda a, b, t: measured.append((a.count(), b.count())) or near(a, b, t))
    got = {(r["removed_id"], r["added_id"], round(r["confidence"], 9), r["is_candidate"]) for r in timeline.rename_pairs(events, "block").collect()}
    assert got == want and len(gone) > 50 and len(want) - len(gone) > 50
    assert measured == [(12, 12)]


@pytest.mark.parametrize("threshold", [0.85, 0.92])
def test_near_names_of_one_beginning_against_all_pairs(spark, threshold):
    """Names of one block that begin alike, of repeated letters, and short ones: the pairs of a comparison of all with all."""
    rng = random.Random(4)
    made = lambda: "get_user_" + "".join(rng.choices("abst_", k=rng.randrange(0, 12)))
    names = [made() for _ in range(150)] + ["".join(rng.choices("ab", k=rng.randrange(0, 8))) for _ in range(80)] + ["aaaaaaaa", "aaaaaaaaa", "ab", "abc", "é", ""]
    ids = {side: [(f"{side}{i}", rng.choice(names)) for i in range(160)] for side in ("removed", "added")}
    frame = lambda side: spark.createDataFrame([("b", i, n) for i, n in ids[side]], f"block string, {side}_id string, {side}_leaf string")
    got = {(r["removed_id"], r["added_id"], round(r["ratio"], 9)) for r in timeline._near_names(frame("removed"), frame("added"), threshold).collect()}
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    want = {(i, j, round(ratio(x, y), 9)) for i, x in ids["removed"] for j, y in ids["added"] if x != y and x and y and ratio(x, y) >= threshold}
    assert got == want and len(want) > 100


def test_thresholds_without_common_bigrams_are_refused(spark):
    none = spark.createDataFrame([], "block string, removed_id string, removed_leaf string")
    with pytest.raises(ValueError, match="threshold"):
        timeline._near_names(none, none.withColumnsRenamed({"removed_id": "added_id", "removed_leaf": "added_leaf"}), 0.5)


def test_renames_of_the_query_have_no_near_names(sf):
    leaves = sorted({n.split()[-1] for n in pd.read_parquet(f"{sf}/part.parquet").p_name})
    assert all(difflib.SequenceMatcher(None, a, b).ratio() < 0.85 for a in leaves for b in leaves if a != b)


def test_queries_in_two_languages():
    assert terms.translations("кэш session кэша") == ["cache", "сессии"]
    assert terms.translations("cache кэша") == []
    assert terms.RUSSIAN["маршрутизация"] == "routing" and terms.ENGLISH["cache"] == "кэша"
    assert text.query_terms("getUser user_name.py") == ["getuser", "user_name.py", "get", "user", "name", "py"]


def test_index_finds_by_prefix_stem_and_dictionary(spark, tmp_path):
    docs = spark.createDataFrame([("a.py", "class UserCache: caching of users"), ("b.py", "соединения с базой"), ("c.py", "nothing here"), ("lib/session_store.py", "x")], "path string, text string")
    index = TextIndex.build(docs, "path", F.col("text"), f"file://{tmp_path}/one", F.col("path"))
    find = lambda q, i=index: {(r["path"], r["mode"]) for r in i.search(q).collect()}
    assert find("users caches") == {("a.py", "and")}
    assert find("connection") == {("b.py", "or")}  # through the dictionary
    assert find("session") == {("lib/session_store.py", "or")}  # through the path
    assert find("zzz") == set() and find("") == set()
    index.change(spark.createDataFrame([("c.py", "users now")], "path string, text string"), F.col("text"), F.col("path"), spark.createDataFrame([("a.py",)], "path string"))
    assert find("users") == {("c.py", "or")} and find("nothing") == set()
    index.change(spark.createDataFrame([("lib/session_store.py", "y")], "path string, text string"), F.col("text"), F.col("path"))
    assert find("session") == {("lib/session_store.py", "or")}  # by its path, after its own replacement too


def test_tests_of_a_module(spark):
    files = spark.createDataFrame([("app/core.py", "source"), ("app/db/__init__.py", "source"), ("tests/test_core.py", "test"), ("app/other.py", "source")], "path string, role string")
    imports = spark.createDataFrame([("tests/test_core.py", "app.core.run"), ("tests/test_core.py", "app.db"), ("tests/test_core.py", "pytest.mark"), ("app/other.py", "app.core")], "src string, ref string")
    assert {tuple(r) for r in impact.tests_for(imports, files, ("app",)).collect()} == {("tests/test_core.py", "app/core.py"), ("tests/test_core.py", "app/db/__init__.py")}


def test_impact_report_of_depth_one_is_direct(spark):
    rows = [("defines", "a.py", "x"), ("imports", "b.py", "x"), ("defines", "b.py", "y"), ("imports", "tests/t.py", "y")]
    relations = spark.createDataFrame(rows, "relation_type string, src_ref string, dst_ref string")
    files = spark.createDataFrame([("a.py", "source"), ("b.py", "source"), ("tests/t.py", "test")], "path string, role string")
    assert {(r["kind"], r["node"]) for r in impact.report(relations, files, "a.py", 1).collect()} == {("direct", "b.py"), ("risk", "a.py")}
    found = {(r["kind"], r["node"]): r["risk"] for r in impact.report(relations, files, "a.py", churn=5).collect()}
    assert found == {("direct", "b.py"): None, ("transitive", "tests/t.py"): None, ("test", "tests/t.py"): None, ("risk", "a.py"): 1.5}


def test_staged_retrieval_against_plain_python(spark, sf):
    """All ten stages of hybrid_retrieve_central."""
    files, symbols, edge_table, found, near = (x.toPandas() for x in corpus._bound(spark, sf))
    words, role = corpus._QUERY_TERMS, dict(zip(files.path, files.role))
    score: dict[str, float] = {}
    hits = []
    for name, fq, path in zip(symbols.name, symbols.fq_name, symbols.file_path):
        own, far = text.identifiers(name), text.identifiers(fq)
        s = 10.0 * (name.lower() == corpus._QUERY) + 3 * (corpus._QUERY in fq.lower()) + sum(2 if w in own else 1 if w in far else 0 for w in words)
        if s:
            hits.append((-s, fq, path))
    for s, _, path in sorted(hits)[:20]:
        score[path] = max(score.get(path, 0), -3 * s)
    for s, path in sorted((-s, p) for p, s in zip(found.path, found.score))[:20]:
        score[path] = score.get(path, 0) - s
    arrows = set(zip(edge_table.src, edge_table.dst))
    seeds = dict(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5])
    extra: dict[str, float] = {}
    for seed, s in seeds.items():
        for way in (arrows, {(b, a) for a, b in arrows}):
            for node, hop in hops({(a, b) for a, b in way if b not in seeds}, seed, 3).items():
                if hop:
                    extra[node] = max(extra.get(node, 0), round(s * 0.7**hop, 6))
        for a, b in arrows:
            if a == seed:  # a path names its own file as a module would
                extra[b] = max(extra.get(b, 0), round(s * 0.49, 6))
    for path, s in extra.items():
        score[path] = max(score.get(path, 0), s)
    top = max(score.values())
    for path in score:
        if role[path] == "config":
            score[path] = max(score[path], 0.5 * top)
        score[path] += 0.15 * (path.split("/")[0] in words)
        score[path] *= {"source": 1.0, "test": 0.95, "config": 1.15, "docs": 0.40}.get(role[path], 0.70)
    nodes = sorted({x for e in arrows for x in e})
    number = {x: i for i, x in enumerate(nodes)}
    src, dst = (np.array([number[e[k]] for e in arrows]) for k in (0, 1))
    outs = np.bincount(src, minlength=len(nodes))
    fresh = {p: 1 + c / (1 + a / 30) if c > 0 else 0.0 for p, c, a in zip(files.path, files.churn_30d, files.age_days)}
    jump = np.array([fresh[x] for x in nodes])
    jump, rank = jump / jump.sum(), np.full(len(nodes), 1 / len(nodes))
    for _ in range(300):
        rank = 0.15 * jump + 0.85 * rank[outs == 0].sum() * jump + 0.85 * np.bincount(dst, rank[src] / np.maximum(outs, 1)[src], len(nodes))
    rank /= rank.sum()
    central = {p: rank[number[p]] if p in number else 0.0 for p in score}
    values = sorted(central.values())
    mid, high = values[max(0, len(values) // 2 - 1)], values[-1]
    facts = {p: (c, a) for p, c, a in zip(files.path, files.churn_30d, files.age_days)}
    for path in score:
        if central[path] > mid and high > mid:
            score[path] *= 1 + 0.1 * (central[path] - mid) / (high - mid)
        score[path] *= (1.10 if facts[path][0] > 0 else 1) * (1.05 if facts[path][1] < 30 else 1)
    weight = min(1, max(0, (near.score.max() - 0.45) / 0.25)) * min(1, max(0, (len(files) - 100) / 400))
    if weight > 0:
        fused: dict[str, float] = collections.defaultdict(float)
        for ranking, w in ((score, 1.0), (dict(zip(near.path, near.score)), weight)):
            for i, (path, _) in enumerate(sorted(ranking.items(), key=lambda x: (-x[1], x[0]))):
                fused[path] += w / (61 + i)
        scale = max(score.values()) / max(fused.values())
        score = {p: s * scale for p, s in fused.items()}
    want = sorted(((-s, p) for p, s in score.items() if s >= 0.4 * max(score.values())))[:10]
    got = corpus.hybrid_retrieve_central(spark, sf).collect()
    assert [r["path"] for r in got] == [p for _, p in want]
    assert [r["score"] for r in got] == pytest.approx([-s for s, _ in want], abs=1e-4)
