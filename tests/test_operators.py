"""Hand-made cases for the core operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltstone.functions import hashing, paths, text
from siltstone.operators import analytics, graph, retrieval, timeline
from siltstone.sources import code


def one(df):
    return df.collect()[0][0]


def column(spark, value, expression):
    return one(spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))))


@pytest.mark.parametrize("value, expected", [("parseHTTPResponse", ["parse", "httpresponse"]), ("классПользователь_имя-x", ["классПользователь".lower(), "имя", "x"]), ("snake_case.py", ["snake", "case", "py"]), ("getUser2Name", ["get", "user2", "name"]), ("", [])])
def test_identifier_tokens(spark, value, expected):
    assert column(spark, value, text.identifier_tokens) == expected


def test_stopwords_keep_repeats(spark):
    assert column(spark, "the auth of auth", lambda c: text.without_stopwords(text.identifier_tokens(c))) == ["auth", "auth"]


@pytest.mark.parametrize(
    "path, ignored, test",
    [("src/app.py", False, False), (".git/config", True, False), ("a/node_modules/x.js", True, False), (".env", True, False), (".env.example", False, False), ("a/.env.local", True, False), ("tests/test_x.py", False, True),
     ("docs/test.md", False, False), ("src/foo.spec.tsx", False, True), ("lib/x.min.js", True, False), ("pkg/foo_test.go", False, True), ("latests/a.py", False, False)],
)
def test_path_predicates(spark, path, ignored, test):
    assert column(spark, path, paths.is_ignored) is ignored
    assert column(spark, path, paths.is_test_path) is test


@pytest.mark.parametrize("node, expected", [("app/x.py", True), ("libs/foo", True), ("./x.py", False), ("@/lib/foo", False), ("next-auth/jwt", False), ("app.services.auth", False), ("README.md", True)])
def test_looks_like_file(spark, node, expected):
    assert column(spark, node, paths.looks_like_file) is expected


def test_checksum_of_nothing_is_the_hash_of_nothing(spark):
    empty = one(spark.range(1).select(hashing.checksum(F.array().cast("array<string>"))))
    assert empty == one(spark.range(1).select(F.sha2(F.lit("").cast("binary"), 256)))


@pytest.mark.parametrize("scores, expected", [([10.0, 1.0], "high"), ([1.0], "high"), ([], "ambiguous"), ([5.0, 4.0, 4.0, 3.9], "medium"), ([5.0, 5.0, 5.0, 5.0], "ambiguous"), ([3.0, 0.0], "high")])
def test_coverage(spark, scores, expected):
    assert one(spark.createDataFrame([(scores,)], "s array<double>").select(retrieval.coverage_class(F.col("s")))) == expected


def test_symbol_scores_count_repeated_words(spark):
    symbols = spark.createDataFrame([("login", "app.auth.login"), ("User", "app.models.User"), ("x", "doc.md#h1-login")], "name string, fq_name string")
    rows = {r["name"]: r["score"] for r in retrieval.symbol_scores(symbols, "login").collect()}
    assert rows == {"login": 15.0}
    assert retrieval.symbol_scores(symbols, "the").count() == 0
    twice = {r["name"]: r["score"] for r in retrieval.symbol_scores(symbols, "auth auth").collect()}
    assert twice == {"login": 2.0}


def test_zero_weight_drops_a_ranking(spark):
    a = spark.createDataFrame([("x", 2.0), ("y", 1.0)], "k string, score double")
    b = spark.createDataFrame([("y", 9.0)], "k string, score double")
    fused = {r["k"]: r["fused"] for r in retrieval.rrf([(a, 1.0), (b, 0.0)], "k").collect()}
    assert fused == {"x": round(1 / 61, 9), "y": round(1 / 62, 9)}


def test_pagerank_sums_to_one_and_ranks_the_hub(spark):
    edges = spark.createDataFrame([("a", "hub"), ("b", "hub"), ("c", "hub"), ("d", "d"), ("hub", "gone")], "src string, dst string")
    rows = {r["node"]: r["rank"] for r in graph.pagerank(edges).collect()}
    assert abs(sum(rows.values()) - 1) < 1e-9
    assert rows["hub"] > rows["a"] == pytest.approx(rows["b"])


def test_bfs_gives_smallest_hops_and_expansion_skips_seeds(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    hops = {r["node"]: r["hop"] for r in graph.bfs(edges, spark.createDataFrame([("a",)], "node string"), 3).collect()}
    assert hops == {"a": 0, "b": 1, "c": 1, "d": 2}
    found = graph.expand(edges, spark.createDataFrame([("a", 1.0), ("b", 2.0)], "node string, score double"), 2).collect()
    assert "a" not in {r["node"] for r in found} and {r["node"]: r["score"] for r in found}["c"] == pytest.approx(1.4)


def test_impact_follows_defined_symbols(spark):
    relations = spark.createDataFrame([("a.py", "sym_a", "defines"), ("b.py", "sym_a", "imports"), ("b.py", "sym_b", "defines"), ("c.py", "sym_b", "imports")], "src_ref string, dst_ref string, relation_type string")
    deps = graph.file_dependencies(relations)
    assert {(r["node"], r["hop"]) for r in graph.dependents(deps, "a.py").collect()} == {("b.py", 1), ("c.py", 2)}


def test_snapshot_diff_classes(spark):
    schema = "symbol_id string, content_hash string, file_path string"
    prev = spark.createDataFrame([("gone", "h", "p"), ("same", "h", "p"), ("moved", "h", "p"), ("mod", "h", "p")], schema)
    curr = spark.createDataFrame([("new", "h", "p"), ("same", "h", "p"), ("moved", "h", "q"), ("mod", "i", "p")], schema)
    assert {tuple(r) for r in timeline.snapshot_diff(prev, curr).collect()} == {("gone", "removed"), ("new", "added"), ("moved", "moved"), ("mod", "modified")}


def test_rename_tiers(spark):
    rows = [("removed", "r1", "h1", "m.old"), ("added", "a1", "h1", "m.new"), ("removed", "r2", "h2", "a.leaf"), ("added", "a2", "h3", "b.leaf"), ("removed", "r3", "h4", None), ("removed", "r4", "h5", "m.zzz")]
    events = spark.createDataFrame([("p", *r) for r in rows], "block string, event_type string, symbol_id string, content_hash string, qualified_name string")
    found = {(r["removed_id"], r["added_id"], r["confidence"], r["is_candidate"]) for r in timeline.rename_pairs(events, "block").collect()}
    assert found == {("r1", "a1", 1.0, False), ("r2", "a2", 0.9, True)}


def test_removed_since_hides_confirmed_renames_only(spark):
    events = spark.createDataFrame([(1, 10.0, "s1", "removed", "c"), (2, 11.0, "s2", "removed", "c"), (3, 12.0, "s3", "removed", "x"), (4, 5.0, "s4", "removed", "c")], "id long, timestamp double, symbol_id string, event_type string, commit_sha string").withColumns({"orphaned": F.lit(False), "qualified_name": F.lit("q"), "file_path": F.lit("f")})
    renames = spark.createDataFrame([("s1", "n1", False), ("s2", "n2", True)], "old_symbol_id string, new_symbol_id string, is_candidate boolean")
    commits = spark.createDataFrame([("c",)], "commit_sha string")
    assert [r["symbol_id"] for r in timeline.removed_since(events, commits, renames, F.lit(6.0), 10).collect()] == ["s2"]


def test_evaluation_rules(spark):
    rows = spark.createDataFrame([(["a", "b"], ["a"]), (["x", "a"], ["a", "b"]), ([], []), (["x"], ["y"])], "retrieved array<string>, expected array<string>")
    assert [(r["recall"], r["precision"], r["rr"]) for r in analytics.eval_metrics(rows).collect()] == [(1.0, 0.5, 1.0), (0.5, 0.5, 0.5), (1.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_chunks_prefer_blank_lines():
    body = "a b\nc d\n\ne f\ng h\n"
    count = lambda s: len(s.split())
    assert [(a, b) for a, b, _ in analytics.chunk_lines(body, 6, count)] == [(1, 3), (4, 5)]
    assert [(a, b) for a, b, _ in analytics.chunk_lines("w " * 9 + "\nx\n", 4, count)] == [(1, 1), (2, 2)]
    assert not list(analytics.chunk_lines("  \n", 4, count))
    assert "".join(t for _, _, t in analytics.chunk_lines(body * 5, 6, count)) == body * 5


def test_scan_and_parsers(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x.py").write_text("x = 1")
    (tmp_path / "pkg" / "a.py").write_text("import os\nfrom .b import helper\nLIMIT = 3\nclass A(Base):\n    def run(self):\n        helper()\n")
    (tmp_path / "pkg" / "bad.py").write_text("def (:\n")
    (tmp_path / "key.py").write_text("AWS_KEY = 'AKIA" + "A" * 16 + "'\n")
    (tmp_path / "README.md").write_text("# Title\nSee `pkg/a.py` and pkg/none.py\n## Part two\n")
    files = code.scan_files(spark, str(tmp_path)).cache()
    assert {r["path"]: (r["role"], r["has_secrets"]) for r in files.collect()} == {"pkg/a.py": ("source", False), "pkg/bad.py": ("source", False), "key.py": ("source", True), "README.md": ("docs", False)}
    rows = code.parse_python(files).collect()
    assert {(r["fq_name"], r["symbol_type"]) for r in rows if r["kind"] == "symbol" and r["file_path"] == "pkg/a.py"} == {("pkg.a.LIMIT", "constant"), ("pkg.a.A", "class"), ("pkg.a.A.run", "method")}
    assert ("pkg.a.A.run", "pkg.b.helper", "calls") in {(r["fq_name"], r["target"], r["relation"]) for r in rows}
    assert [r["file_path"] for r in rows if r["kind"] == "error"] == ["pkg/bad.py"]
    assert [r["fq_name"] for r in code.markdown_headings(files).orderBy("start_line").collect()] == ["README.md#h1-Title", "README.md#h2-Part two"]
    docs = files.where("role = 'docs'")
    assert [tuple(r) for r in code.docs_links(docs, files).select("src_ref", "dst_ref").collect()] == [("README.md", "pkg/a.py")]
    old = files.select("path", F.when(F.col("path") == "key.py", "other").otherwise(F.col("content_hash")).alias("content_hash")).where("path <> 'pkg/bad.py'")
    assert {r["path"] for r in code.changed_files(files, old).collect()} == {"key.py", "pkg/bad.py"}


def test_upsert_and_partition_replacement(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    rows = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert {tuple(r) for r in code.upsert(table, rows, "k").collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert {tuple(r) for r in code.replace_partition(table, rows, "k").collect()} == {("a", 1), ("b", 3), ("c", 4)}


def test_usage_lines_skip_what_is_not_usage(spark):
    from siltstone.schemas import USAGE

    lines = ['{"type":"assistant","timestamp":"2024-01-01T00:00:00Z","sessionId":"s","message":{"usage":{"input_tokens":5}}}', '{"type":"user"}', "not json"]
    rows = code.usage_events(spark.createDataFrame([(x,) for x in lines], "value string"), USAGE).collect()
    assert [(r["session_id"], r["input_tokens"], r["output_tokens"]) for r in rows] == [("s", 5, 0)]


def test_import_resolution_order(spark):
    from siltstone.operators import code_graph

    files = spark.createDataFrame([(p,) for p in ("a/b.py", "a/b/__init__.py", "c/__init__.py", "web/util.ts", "web/x/index.ts", "deep/lib/tool.js")], "path string")
    rows = [("m.py", "a.b", "a/b.py"), ("m.py", "c", "c/__init__.py"), ("m.py", "a.b.name", "a/b.py"), ("web/app.ts", "./util", "web/util.ts"), ("web/y/z.ts", "../x", "web/x/index.ts"), ("m.ts", "lib/tool.js", "deep/lib/tool.js"), ("m.py", "os.path", None)]
    got = {(r["src"], r["ref"]): r["dst"] for r in code_graph.resolve_imports(spark.createDataFrame([r[:2] for r in rows], "src string, ref string"), files).collect()}
    assert got == {r[:2]: r[2] for r in rows if r[2]}


def test_mixed_walk_finds_callers_and_definitions(spark):
    from siltstone.operators import code_graph

    edges = spark.createDataFrame([("app/a.py", "app.a.run"), ("app/b.py", "app.a.run"), ("app/a.py", "lib.c.help"), ("lib/c.py", "lib.c.help"), ("app/a.py", "os.path")], "src string, dst string")
    found = {tuple(r) for r in code_graph.mixed_walk(edges, spark.createDataFrame([("app/a.py", 2.0)], "node string, score double")).collect()}
    assert found == {("app/b.py", 0.98), ("lib/c.py", 0.98)}


def test_lint_and_commit_ranges(spark):
    from siltstone.operators import code_graph

    articles = spark.createDataFrame([("a", "h", 100), ("b", "old", 100), ("c", "h", 3)], "name string, hash string, size int")
    modules = spark.createDataFrame([("a", "h"), ("b", "h"), ("d", "h")], "name string, hash string")
    index = spark.createDataFrame([("a",), ("b",), ("z",)], "name string")
    assert {tuple(r) for r in code_graph.lint(articles, modules, index).collect()} == {("orphan", "c"), ("missing", "d"), ("stale", "b"), ("empty", "c"), ("unindexed", "c"), ("dangling", "z")}
    parents = spark.createDataFrame([("c3", "c2"), ("c2", "c1"), ("c1", None), ("x", "c1"), ("c3", "x")], "sha string, parent string")
    assert {r["commit_sha"] for r in code_graph.commits_between(parents, "c2", "c3").collect()} == {"c3", "x"}


def test_sinks(spark, tmp_path):
    from siltstone.sources import sinks

    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    table = spark.createDataFrame([("b", 9)], "k string, v int")
    assert [tuple(r) for r in sinks.insert_new(table, rows, "k").collect()] == [("a", 1)]
    sinks.write_version(rows, str(tmp_path / "t"), 1)
    assert sinks.read_version(spark, str(tmp_path / "t"), 1, "k string, v int").count() == 3
    assert sinks.read_version(spark, str(tmp_path / "t"), 2, "k string, v int").collect() == []
    symbols = spark.createDataFrame([("f.py", "b", "function", 9), ("f.py", "A", "class", 2)], "file_path string, name string, symbol_type string, start_line int")
    assert sinks.symbol_index(symbols).first()["section"] == "## f.py\n- class `A`\n- function `b`"
    with pytest.raises(Exception, match="unknown event type odd"):
        sinks.valid_events(spark.createDataFrame([("odd",)], "event_type string")).collect()


def test_streams_equal_batch(spark, tmp_path):
    from siltstone.streaming import streams

    rows = spark.createDataFrame([(i, 1_700_000_000 + i * 3600, i % 3, 1.0) for i in range(200)], "id long, s long, user long, value double").select("id", F.timestamp_seconds("s").alias("ts"), "user", "value")
    rows.repartition(3).write.parquet(str(tmp_path / "events"))
    out = streams.drain(streams.tumbling(streams.event_stream(spark, str(tmp_path / "events")), "ts", "1 day"), name="test")
    batch = {(r["window_start"], r["n"]) for r in streams.tumbling(rows, "ts", "1 day").collect()}
    closed = {(r["window_start"], r["n"]) for r in out.collect()}
    assert closed and closed <= batch
    seen = []
    streams.drain_batches(streams.event_stream(spark, str(tmp_path / "events"), 1), lambda df, i: seen.append(df.count()), "test-batches")
    assert sum(seen) == 200 and len(seen) == 3


def test_streams_over_many_unordered_files(spark, tmp_path):
    """140 files, three times 64 at most to a batch, the latest times first: every closed window, session and key is whole."""
    import os

    from siltstone.streaming import streams

    hours = [(d, 1_700_000_000 + d * 86400 + h * 14400, d % 5, f"k{d}", 1.0) for d in range(140) for h in range(6)]
    frame = spark.createDataFrame(spark.sparkContext.parallelize(hours, 140), "id long, s long, user long, kind string, value double")
    frame.select("id", F.timestamp_seconds("s").alias("ts"), "user", "kind", "value").write.parquet(str(tmp_path / "events"))
    assert len(list((tmp_path / "events").glob("*.parquet"))) == 140
    for age, f in enumerate(sorted((tmp_path / "events").glob("*.parquet"), key=lambda f: f.name)):
        os.utime(f, (1_600_000_000 - age * 60,) * 2)  # the latest days are read first
    rows = spark.read.parquet(str(tmp_path / "events"))
    stream = lambda: streams.event_stream(spark, str(tmp_path / "events"))
    for name, make in (("tumbling", lambda e: streams.tumbling(e, "ts", "1 day")), ("sliding", lambda e: streams.sliding(e, "ts", "1 day", "6 hours")), ("sessions", lambda e: streams.sessions(e, "ts", "12 hours", "user"))):
        end = rows.agg(F.max("ts") - F.expr("interval 1 day")).first()[0]
        want = {tuple(r) for r in make(rows).collect() if r["window_end"] <= end}  # a filter in Spark would be moved below the sessions
        got = [tuple(r) for r in streams.drain(make(stream()), name=f"many-{name}").collect()]
        assert want and len(got) == len(set(got)) and set(got) == want
    keys = {r["kind"] for r in streams.drain(streams.deduplicated(stream(), "ts", "kind"), name="many-dedup").select("kind").collect()}
    assert keys == {f"k{d}" for d in range(140)}
