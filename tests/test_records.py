"""Stores, packs, evaluation, modules, git, parsers and the change loop, on small literal inputs."""

from __future__ import annotations

import subprocess

import pytest
from pyspark.sql import functions as F

from siltstone.operators import code_graph, evaluation, modules, packs, project, retrieval, timeline
from siltstone.operators.text_index import TextIndex
from siltstone.sources import code, gitlog, grammar, sinks, stores
from siltstone.streaming import streams


def rows(df):
    return sorted(tuple(r) for r in df.collect())


SOURCES = {
    "typescript": ("src/a.ts", 'import { x } from "./b";\nimport React from \'react\'; // class No { }\nexport const MAX_SIZE = 3;\nexport type Id = string;\nexport interface Shape extends Base<T>, Other { area(): number; }\nexport default class Circle extends Shape implements A, B {\n  private r = 1;\n  constructor(r: number) { super(); this.r = helper({a: 1}); }\n  async area(): Promise<number> { if (x) { return 1; } return compute(this.r); }\n}\nfunction helper(o) { return o.a; }\nexport const compute = (v: number) => { const s = "}{"; return helper(v); };\n"'),
    "go": ("pkg/a.go", 'package a\nimport "fmt"\nimport (\n    "os"\n    b "x/y"\n)\nconst Max = 3\ntype Server struct { name string }\ntype ID int\nfunc (s *Server) Run() error { return start(s) }\nfunc start(s *Server) error { fmt.Println("{"); return nil }\n'),
    "rust": ("src/lib.rs", "use std::io::{Read, Write};\nmod inner;\npub const LIMIT: usize = 3;\npub struct Foo { a: i32 }\nstruct Unit;\npub trait Draw: Debug { fn draw(&self); }\nimpl Draw for Foo { fn draw(&self) { helper('a') } }\nfn helper<'a>(x: char) -> i32 { 1 }\n"),
    "java": ("a/B.java", "package a;\nimport java.util.List;\n@Service\npublic class B extends C<D> implements E, F {\n  private static final int SIZE = 3;\n  public B(int x) { run(); }\n  @Override public void run() throws Exception { if (a) { help(); } }\n  abstract int help();\n  enum Kind { A, B }\n}\n"),
    "kotlin": ("a/K.kt", 'package a\nimport b.C\ndata class P(val x: Int) : Base(x), Face\nclass Q : R() {\n  private val size = 3\n  fun run(): Int { return help() }\n  fun help() = 4\n}\nobject S\nfun top(a: Int) { println("}") }\n'),
    "swift": ("a/S.swift", "import Foundation\nprotocol P: Q { func draw() }\nclass A: B, P {\n  var x: Int = 3\n  init(x: Int) { self.x = x }\n  func draw() { help() }\n  func help() { }\n}\nfunc top() { }\n"),
}
SYMBOLS = {
    "typescript": {("MAX_SIZE", "constant"), ("Id", "class"), ("Shape", "class"), ("Circle", "class"), ("constructor", "method"), ("area", "method"), ("helper", "function"), ("compute", "function")},
    "go": {("Max", "constant"), ("Server", "class"), ("ID", "class"), ("Run", "method"), ("start", "function")},
    "rust": {("inner", "module"), ("LIMIT", "constant"), ("Foo", "class"), ("Unit", "class"), ("Draw", "class"), ("draw", "method"), ("helper", "function")},
    "java": {("B", "class"), ("SIZE", "variable"), ("B", "method"), ("run", "method"), ("help", "method"), ("Kind", "class")},
    "kotlin": {("P", "class"), ("Q", "class"), ("size", "variable"), ("run", "method"), ("help", "method"), ("S", "class"), ("top", "function")},
    "swift": {("P", "class"), ("draw", "method"), ("A", "class"), ("x", "variable"), ("init", "method"), ("help", "method"), ("top", "function")},
}
RELATIONS = {
    "typescript": {("imports", "./b"), ("imports", "react"), ("inherits", "Base"), ("inherits", "Other"), ("inherits", "Shape"), ("inherits", "A"), ("inherits", "B"), ("same_file_calls", "src.a.helper"), ("same_file_calls", "src.a.compute")},
    "go": {("imports", "fmt"), ("imports", "os"), ("imports", "x/y"), ("same_file_calls", "pkg.a.start")},
    "rust": {("imports", "std::io::{Read,Write}"), ("inherits", "Debug"), ("same_file_calls", "src.lib.helper")},
    "java": {("imports", "java.util.List"), ("inherits", "C"), ("inherits", "E"), ("inherits", "F"), ("same_file_calls", "a.B.B.run"), ("same_file_calls", "a.B.B.help")},
    "kotlin": {("imports", "b.C"), ("inherits", "Base"), ("inherits", "Face"), ("inherits", "R"), ("same_file_calls", "a.K.Q.help")},
    "swift": {("imports", "Foundation"), ("inherits", "Q"), ("inherits", "B"), ("inherits", "P"), ("same_file_calls", "a.S.A.help")},
}


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_symbols_and_relations(language):
    found = grammar.parse(*SOURCES[language], language)
    assert {(r[2], r[4]) for r in found if r[0] == "symbol"} == SYMBOLS[language]
    assert {(r[9], r[8]) for r in found if r[0] == "relation" and r[9] != "defines"} == RELATIONS[language]
    assert {r[8] for r in found if r[9] == "defines"} == {r[3] for r in found if r[0] == "symbol"}


def test_scopes_end_at_their_brace_and_odd_files_do_not_break(spark):
    (circle,) = [r for r in grammar.parse(*SOURCES["typescript"], "typescript") if r[2] == "Circle"]
    assert circle[5:7] == (6, 10)
    files = spark.createDataFrame([("a.go", "}}}} func", "go"), ("b.ts", None, "typescript"), ("c.java", "class A { " * 300, "java"), ("d.txt", "x", "text")], "path string, text string, language string")
    found = grammar.parse_sources(files).where("kind = 'symbol'").groupBy("file_path").count()
    assert rows(found) == [("c.java", 300)]


def test_validity_of_settings(spark):
    files = spark.createDataFrame([("a.json", "json", "{}"), ("b.json", "json", "{"), ("c.toml", "toml", "a = 1"), ("d.toml", "toml", "a ="), ("e.yaml", "yaml", "a: 1\n---\nb: 2"), ("f.yaml", "yaml", "a: [1"), ("g.yaml", "yaml", None), ("h.py", "python", "(")], "path string, language string, text string")
    assert {r["path"] for r in stores.validity(files).where("error is not null").collect()} == {"b.json", "d.toml", "f.yaml"}


TRACE = "trace_id string, project string, query string, mode string, timestamp double, coverage string, stages array<struct<name:string,elapsed_ms:double,candidates:array<struct<path:string,score:double>>>>"


def test_traces(spark, monkeypatch):
    now = 100 * 86400.0
    stage = lambda name, ms, *paths: (name, ms, [(p, 1.0) for p in paths])
    old = spark.createDataFrame([("t1", "p", "q", "navigate", now - 40 * 86400, "high", []), ("t2", "p", "q", "edit", now - 5, "high", [stage("symbols", 2.0, "a", "b", "c"), stage("cut", 1.5, "a")])], TRACE)
    new = spark.createDataFrame([("t2", "p", "again", "edit", now - 4, "high", [stage("symbols", 2.0, "a", "b", "c"), stage("cut", 1.5, "a")]), ("t3", "o", "q", "edit", now, "high", None)], TRACE)
    table = stores.save_traces(old, new, F.lit(now))
    assert rows(table.select("trace_id", "query")) == [("t2", "again"), ("t3", "q")]
    assert [r["trace_id"] for r in stores.traces_since(table, "p", F.lit(now - 100)).collect()] == ["t2"]
    assert [tuple(r) for r in stores.explain(table, "t2").collect()] == [(0, "symbols", 2.0, 3, 2), (1, "cut", 1.5, 1, 0)]
    assert rows(table.select("trace_id", stores.latency(F.col("stages")))) == [("t2", 3.5), ("t3", 0.0)]
    assert stores.explain(table, "absent").collect() == []


def test_summaries_are_written_once(spark):
    files = spark.createDataFrame([("a", "x y", "h1"), ("b", "x y", "h1"), ("c", "z", "h2")], "path string, text string, content_hash string")
    empty = spark.createDataFrame([("h2", "m", "v", "p", "old", 1, 1, 0.5, 10.0)], "content_hash string, model string, prompt_version string, prompt_hash string, summary string, tokens_in long, tokens_out long, cost double, created_at double")
    table, totals = stores.summarize(files, empty, lambda t: (t.upper(), 2, 1), "m", "v", F.col("tokens_in") * F.lit(0.25), 20.0)
    assert rows(table.select("content_hash", "summary")) == [("h1", "X Y"), ("h2", "old")]
    assert tuple(totals.first()) == (2, 1, 3, 0.5)
    assert stores.cost_since(table, F.lit(15.0)).first()["cost"] == 0.5


def test_vectors_by_project(spark):
    schema = "project string, path string, embedding array<double>"
    have = spark.createDataFrame([("p", "a", [1.0, 0.0]), ("o", "a", [0.0, 1.0])], schema)
    table = stores.upsert_vectors(have, spark.createDataFrame([("p", "a", [0.0, 2.0]), ("p", "b", [1.0, 1.0])], schema), 2)
    assert [tuple(r) for r in stores.search_vectors(table, "p", [0.0, 1.0], 5).collect()] == [("a", 1.0), ("b", 0.707107)]
    assert rows(stores.delete_project(table, "p").select("project")) == [("o",)]
    with pytest.raises(Exception, match="another width"):
        stores.upsert_vectors(have, spark.createDataFrame([("p", "c", [1.0])], schema), 2).collect()


def test_registry_audit_prune_and_restore(spark, tmp_path):
    registry = stores.Registry(str(tmp_path / "projects.yaml"))
    for root in ("/p/used", "/p/idle", "/tmp/x", "/p/gone"):
        registry.put(root, name=root.rsplit("/", 1)[-1])
    registry.put("/p/used", added_at=5.0)
    day = 86400.0
    caches = spark.createDataFrame([("/p/used", 3, 9, 99 * day), ("/p/idle", 2, 1, 10 * day)], "root string, files long, symbols long, last_scan double")
    traces = spark.createDataFrame([("/p/used", 99 * day), ("/p/used", 50 * day)], "project string, timestamp double")
    there = spark.createDataFrame([("/p/used",), ("/p/idle",), ("/tmp/x",)], "root string")
    audited = stores.audit(registry.table(spark), caches, traces, there, F.lit(100 * day))
    assert rows(audited.select("root", "files", "packs", "packs_7d", "exists", "transient", "stale")) == [("/p/gone", 0, 0, 0, False, False, True), ("/p/idle", 2, 0, 0, True, False, True), ("/p/used", 3, 2, 1, True, False, False), ("/tmp/x", 0, 0, 0, True, True, True)]
    assert rows(stores.prune_plan(audited)) == [("/p/gone", "missing"), ("/tmp/x", "transient")]
    assert rows(stores.prune_plan(audited, stale=True)) == [("/p/gone", "missing"), ("/p/idle", "stale"), ("/tmp/x", "transient")]
    assert registry.remove(["/tmp/x", "/p/gone", "/absent"]) == ["/tmp/x", "/p/gone"]
    assert [p["root"] for p in registry.load()["projects"]] == ["/p/used", "/p/idle"]
    assert registry.restore() == ["/tmp/x", "/p/gone"] and registry.restore() == []


def test_memories(spark, tmp_path):
    folder = str(tmp_path)
    first = stores.propose_memory(folder, "How to build", "run make", ["ci", "make"], 10.0)
    second = stores.propose_memory(folder, "How to build!", "x" * 900, [], 20.0)
    assert (first, second) == ("how-to-build", "how-to-build-2")
    (tmp_path / "broken.md").write_text("no front matter")
    stores.decide_memory(folder, first, True)
    stores.decide_memory(folder, second, True)
    with pytest.raises(ValueError):
        stores.decide_memory(folder, first, False)
    got = stores.memories(spark, folder, "accepted").collect()
    assert [(r["name"], r["tags"], r["body"][:8]) for r in got] == [(second, [], "xxxxxxxx"), (first, ["ci", "make"], "run make")]
    assert stores.memories(spark, folder, "proposed").collect() == []
    section = packs.memories_section(stores.memories(spark, folder))
    assert section[2:4] == ["### How to build!", "x" * 600 + "..."] and section[5] == "### How to build  `ci make`"
    with pytest.raises(ValueError):
        stores.propose_memory(folder, " ", "x", [], 1.0)


def test_packs(spark):
    files = spark.createDataFrame([("lib/core.py", 9.0), ("tests/test_core.py", 8.5), ("app/config/x.py", 8.0), ("conf.yaml", 7.5)], "path string, score double")
    symbols = spark.createDataFrame([("lib.core.run",)], "fq_name string")
    result = retrieval.Retrieval(files, symbols, "ambiguous")
    found = packs.build(result, "demo", "core run")
    assert found.files == ["lib/core.py", "tests/test_core.py", "app/config/x.py", "conf.yaml"] and "1. `lib/core.py` (score 9.00)" in found.markdown and "Ambiguous" in found.markdown and "`config`" in found.markdown
    changed = spark.createDataFrame([("new.py",), ("lib/core.py",)], "path string")
    facts = spark.createDataFrame([("removed", f"lib.old{i}", "lib/core.py", float(i)) for i in range(200)], "kind string, name string, path string, timestamp double")
    edit = packs.build(retrieval.Retrieval(files, symbols, "high"), "demo", "core run", "edit", changed=changed, facts=facts)
    lines = edit.markdown.split("\n")
    assert lines[lines.index("## Impacted tests") + 2] == "- `tests/test_core.py`"
    assert lines[lines.index("## Impacted configs") + 2 : lines.index("## Impacted configs") + 4] == ["- `app/config/x.py`", "- `conf.yaml`"]
    assert "- `new.py` (score 5.00)" in lines and lines[lines.index("## Timeline") + 2] == "- removed: `lib.old199` in `lib/core.py`" and any(x.startswith("- and ") for x in lines)
    assert edit.size_bytes == len(edit.markdown.encode())
    nothing = packs.build(retrieval.Retrieval(files.limit(0), symbols.limit(0), "ambiguous"), "demo", "x", "edit")
    assert "_no target files identified_" in nothing.markdown and "_no symbol candidates_" in nothing.markdown


def test_evaluation_means_and_gate(spark):
    queries = [{"id": "a", "text": "x", "mode": "navigate", "expected": {"files": ["f1", "f2"], "symbols": []}}, {"id": "b", "text": "y", "mode": "edit", "expected": {"files": ["f9"]}}, {"id": "c", "text": "z", "mode": "navigate"}]
    found = {"x": (["f1", "f3"], ["s"]), "y": (["f8", "f9"], []), "z": ([], [])}
    results = evaluation.run(spark, queries, lambda text, mode: found[text], {"b"}, "p")
    m = evaluation.means(results).first().asDict()
    assert m == {"queries": 3, "recall_at_5_files": round((0.5 + 1 + 1) / 3, 6), "precision_at_3_files": round((0.5 + 0.5 + 0) / 3, 6), "recall_at_5_symbols": 1.0, "mrr_files": 0.5, "impact_recall_at_5": 1.0}
    both = results.unionByName(results.withColumn("project", F.lit("o")))
    assert {r["project"]: r["queries"] for r in evaluation.means(both, "project").collect()} == {"p": 3, "o": 3, None: 6}
    assert [r["metric"] for r in evaluation.failing(evaluation.means(results), {"mrr_files": 0.6, "recall_at_5_files": 0.5}).collect()] == ["mrr_files"]
    assert {r["change"] for r in evaluation.comparison(evaluation.means(results), evaluation.means(results)).collect()} == {0.0}
    assert evaluation.report(results).count("\n| ") == 11
    assert evaluation.means(results.limit(0)).first()["mrr_files"] == 0.0


def test_judges_scale_and_fail_softly(spark):
    few = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "path string, score double")
    assert [tuple(r) for r in evaluation.reranked(few, lambda names: [0.1, 0.5]).collect()] == [("b", 1.0), ("a", 0.4)]

    def broken(names):
        raise RuntimeError("no network")

    for judge in (None, broken, lambda names: [1.0], lambda names: [0.0, 0.0]):
        assert rows(evaluation.reranked(few, judge)) == [("a", 2.0), ("b", 1.0)]


def test_central_baseline(spark):
    edges = spark.createDataFrame([("a.py", "auth.login"), ("b.py", "auth.login"), ("c.py", "other")], "src string, dst string")
    assert evaluation.central_baseline(edges, "where is the login", 1).first()["node"] == "auth.login"


def test_modules_and_articles(spark):
    files = spark.createDataFrame([("lib/a/x.py",), ("lib/a/y.py",), ("app/b/z.py",)], "path string")
    symbols = spark.createDataFrame([(f"s{i:02}", "lib/a/x.py") for i in range(12)], "fq_name string, file_path string")
    edges = spark.createDataFrame([("lib/a/x.py", "app/b/z.py"), ("lib/a/y.py", "app/b/z.py")], "src string, dst string")
    got = {r["module"]: tuple(r)[1:] for r in modules.rollup(files, symbols, edges).collect()}
    assert got == {"lib/a": (2, 12, ",".join(f"s{i:02}" for i in range(10)), "app/b", ""), "app/b": (1, 0, "", "", "lib/a")}
    articles = spark.createDataFrame([("core", "# Core\n\n## Purpose\n\nRuns things. And more.\n\n## Rest"), ("odd", "nothing")], "name string, text string")
    assert [r["line"] for r in modules.article_index(articles).orderBy("place").collect()] == ["- [core](core.md): Runs things.", "- [odd](odd.md)"]
    state = spark.createDataFrame([("a", "h1", "current"), ("b", "h1", "current"), ("c", "h", "dirty")], "name string, hash string, status string")
    now = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("d", "h")], "name string, hash string")
    after = modules.article_states(state, now)
    assert rows(after) == [("a", "h1", "current"), ("b", "h2", "dirty"), ("c", "h", "gone"), ("d", "h", "dirty")]
    written = spark.createDataFrame([("b", "h2"), ("d", "older")], "name string, hash string")
    assert {r["name"]: r["status"] for r in modules.mark_current(after, written).collect()} == {"a": "current", "b": "current", "c": "gone", "d": "dirty"}
    assert modules.degraded(0, None, 0, 0, 10.0) == ["not indexed", "no vectors"] and modules.degraded(5, 0.0, 3, 2, 90_000.0) == ["stale index", "articles out of date"]
    page = modules.project_page(spark.createDataFrame([("python", "source"), ("python", "test"), ("yaml", "config")], "language string, role string"), "p", 7, 8)
    assert "3 files, 7 symbols, 8 relations" in page and page.index("- python: 2") < page.index("- yaml: 1")


def test_doctor(spark):
    found = {r["check"]: (r["ok"], r["detail"]) for r in modules.doctor(modules.standard_checks(spark, {"none": "/absent"}) | {"bad": lambda: 1 / 0}, spark).collect()}
    assert found["time zone"] == (True, "UTC") and found["shared folder"][0] and not found["table none"][0] and found["bad"] == (False, "division by zero")


def test_tables_are_checked(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "path string, n long").write.parquet(f"{tmp_path}/good")
    spark.createDataFrame([("a",)], "path string").write.parquet(f"{tmp_path}/short")
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.parquet").write_text("x")
    table, bad = stores.healthy(spark, {n: f"{tmp_path}/{n}" for n in ("good", "short", "broken", "absent")}, "path string, n long")
    assert rows(table) == [("a", 1, "good")] and bad == {"short": "schema: n", "broken": "broken", "absent": "missing"}


def test_notes_are_published_and_old_ones_go(spark, tmp_path):
    folder = f"file://{tmp_path}"
    notes = spark.createDataFrame([("a.md", "x"), ("sub/b.md", "ü"), ("c.md", None)], "path string, text string")
    assert sinks.publish(notes, folder) == []
    assert sinks.publish(notes.where("path <> 'a.md'"), folder) == ["a.md"]
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.md")) == ["c.md", "sub/b.md"] and (tmp_path / "sub/b.md").read_text() == "ü"


def test_links_between_notes(spark):
    text = "see [core](core.md) and [web](https://x.y/z.md), ![i](i.md) `[code](c.md)`\n```\n[in](fence.md)\n```\n[after](sub/after)"
    got = spark.createDataFrame([(text,)], "t string").select(sinks.wiki_links(F.col("t"))).first()[0]
    assert got == "see [[core|core]] and [web](https://x.y/z.md), ![i](i.md) `[code](c.md)`\n```\n[in](fence.md)\n```\n[[sub/after|after]]"


def test_states_and_cascades(spark):
    schema = "project_root string, commit_sha string, timestamp double"
    states = sinks.scan_states(spark.createDataFrame([("p", "a", 1.0)], schema), spark.createDataFrame([("p", "b", 2.0), ("o", "c", 1.0)], schema))
    assert rows(states) == [("o", "c", 1.0), ("p", "b", 2.0)]
    tables = {"files": spark.createDataFrame([("a",), ("b",)], "path string"), "symbols": spark.createDataFrame([("a", "s"), ("b", "t")], "file_path string, name string")}
    left = sinks.deleted_files(tables, spark.createDataFrame([("a",)], "path string"))
    assert rows(left["files"]) == [("b",)] and rows(left["symbols"]) == [("b", "t")]


def test_git_as_a_source(spark, tmp_path):
    def git(*a, day=1):
        env = {"GIT_AUTHOR_DATE": f"2024-01-0{day}T00:00:00Z", "GIT_COMMITTER_DATE": f"2024-01-0{day}T00:00:00Z", "HOME": str(tmp_path), "PATH": "/usr/bin:/bin:/usr/local/bin"}
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Jo", "-c", "user.email=jo@x", *a], check=True, capture_output=True, env=env)

    root = str(tmp_path)
    assert gitlog.head_sha(root) is None and gitlog.commits(spark, root) is None and gitlog.changed_files(spark, root).collect() == []
    git("init", "-q")
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "a.py").write_text("1")
    (tmp_path / "b.py").write_text("1")
    git("add", ".")
    git("commit", "-qm", "first")
    git("tag", "v1")
    (tmp_path / "lib" / "a.py").write_text("2")
    git("commit", "-qam", "second\x1fodd", day=2)
    (tmp_path / "b.py").write_text("3")
    assert rows(gitlog.changed_files(spark, root)) == [("b.py",)]
    assert gitlog.resolve(root, "v1") != gitlog.head_sha(root) == gitlog.resolve(root, "HEAD") and gitlog.resolve(root, "nope") is None
    assert gitlog.commits(spark, root).where("parent is null").count() == 1 and rows(gitlog.tags(spark, root)) == [("v1", gitlog.resolve(root, "v1"))]
    history = gitlog.history(spark, root, "r", per_partition=1)
    assert history.rdd.getNumPartitions() == 2 and rows(history) == rows(gitlog.history(spark, root, "r"))
    plain = subprocess.run(["git", "-C", root, "log", f"--pretty=format:{gitlog.LOG_FORMAT}", "--name-only"], capture_output=True, text=True, check=True).stdout.splitlines()
    stored = gitlog.changes(spark.createDataFrame([("r", i, line) for i, line in enumerate(plain)], "repository string, n long, value string"))
    assert rows(stored.drop("seq", "subject")) == rows(history.drop("seq", "subject")) and len(plain) > 4
    with pytest.raises(Exception, match="failed"):
        gitlog.history(spark, f"{root}/lib/none").count()
    assert [(r["subject"].split("\x1f")[0], r["files"]) for r in gitlog.recent(history).collect()] == [("second", ["lib/a.py"]), ("first", ["b.py", "lib/a.py"])]
    assert [r["subject"] for r in gitlog.recent(history, path="b.py").collect()] == ["first"]
    assert gitlog.recent(history, since=F.unix_timestamp(F.lit("2024-01-01 12:00:00"))).count() == 1


def test_query_sets(tmp_path):
    path = tmp_path / "q.yaml"
    path.write_text("queries:\n- {id: a, text: t, mode: edit}\n")
    assert stores.query_set(str(path)) == [{"id": "a", "text": "t", "mode": "edit"}]
    assert stores.query_set(str(tmp_path / "none.yaml"), required=False) == []
    path.write_text("queries:\n- {id: a}\n")
    with pytest.raises(ValueError, match="mode"):
        stores.query_set(str(path))


def test_usage_is_read_once(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.jsonl").write_text("1\n2\n")
    call = lambda: stores.usage_tail(spark, f"file://{logs}", f"file://{tmp_path}/cp", f"file://{tmp_path}/out")
    assert rows(call()) == [("1",), ("2",)]
    (logs / "b.jsonl").write_text("3\n")
    assert rows(call()) == [("1",), ("2",), ("3",)] == rows(call())


def test_change_loop_isolates_and_calls_hooks(spark, tmp_path):
    schema = "project string, path string, op string, ts long, id long"
    folder = f"{tmp_path}/changes"
    spark.createDataFrame([("good", "a", "modify", 1, 1), ("good", "a", "delete", 2, 2), ("bad", "x", "modify", 1, 3), ("good", "b", "modify", 1, 4)], schema).coalesce(1).write.parquet(folder)
    seen, jobs, syncs = {}, [], []

    def handle(project, changes):
        if project == "bad":
            raise KeyError("broken index")
        seen.setdefault(project, []).append(rows(changes.select("path", "op")))
        return 3

    clock = iter(range(0, 1000, 10)).__next__
    loop = streams.ChangeLoop(handle, f"{tmp_path}/quarantine", 3, 15.0, lambda p, n: jobs.append((p, n)), syncs.append, clock)
    stream = lambda: streams.event_stream(spark, folder)
    query = streams.run_loop(stream(), loop, f"{tmp_path}/cp", None)
    query.awaitTermination()
    assert [p["rows"] for p in streams.watched(query, 1.0, sleep=lambda s: None)] == [4]
    for k in range(2):
        spark.createDataFrame([("good", f"n{k}", "modify", 5, 9)], schema).coalesce(1).write.mode("append").parquet(folder)
        streams.run_loop(stream(), loop, f"{tmp_path}/cp", None).awaitTermination()
    assert seen["good"] == [[("a", "delete"), ("b", "modify")], [("n0", "modify")], [("n1", "modify")]]
    assert jobs == [("good", 3)] * 3 and syncs == ["good", "good"]
    assert [(r["project"], r["error"]) for r in spark.read.parquet(f"{tmp_path}/quarantine").collect()] == [("bad", "KeyError")]


def test_every_language_finds_its_parser(spark):
    files = [("a.py", "python", "def f():\n    pass\n"), ("b.go", "go", "func g() { }"), ("c.md", "markdown", "# Title"), ("d.json", "json", "{"), ("e.py", "python", "def ("), ("f.txt", "text", "x")]
    found = grammar.parse_files(spark.createDataFrame(files, "path string, language string, text string"))
    assert rows(found.where("kind = 'symbol'").select("file_path", "name")) == [("a.py", "f"), ("b.go", "g"), ("c.md", "Title")]
    assert rows(found.where("kind = 'error'").select("file_path")) == [("d.json",), ("e.py",)]


def test_aliases_of_imports(spark):
    settings = '{ // c\n "compilerOptions": {"baseUrl": "./web", "paths": {"@/*": ["./src/*"], "$lib": ["lib/index"], "none": []},}}'
    assert code_graph.path_aliases(settings) == {"@/": "web/src/", "$lib": "web/lib/index"}
    assert code_graph.path_aliases("{") == {} and code_graph.path_aliases("[]") == {}
    imports = spark.createDataFrame([("web/a.ts", "@/b/c")], "src string, ref string")
    files = spark.createDataFrame([("web/a.ts",), ("web/src/b/c.ts",)], "path string")
    assert rows(code_graph.resolve_imports(imports, files, code_graph.path_aliases(settings)).select("dst")) == [("web/src/b/c.ts",)]


def test_only_some_files_are_looked_at(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content_hash string")
    only = spark.createDataFrame([("b",), ("absent",)], "path string")
    assert rows(code.changed_files(new, new.limit(0), only=only)) == [("b", "2")]


def test_upsert_takes_the_last_by_its_order(spark):
    table = spark.createDataFrame([("a", 1, "old"), ("b", 1, "old")], "k string, n long, v string")
    new = spark.createDataFrame([("a", 5, "late"), ("a", 3, "early")], "k string, n long, v string").repartition(2)
    assert rows(code.upsert(table, new, "k", order="n")) == [("a", 5, "late"), ("b", 1, "old")]


def test_events_stay_where_git_cannot_tell(spark):
    events = spark.createDataFrame([(1, "c", True)], "id long, commit_sha string, orphaned boolean")
    assert rows(timeline.reconcile(events, None)) == [(1, "c", True)]


def test_when_by_id_by_name_and_by_neither(spark):
    sid = "a" * 32
    events = spark.createDataFrame([(1, sid, "added", 1.0, "m.parse", "f"), (2, "s2", "added", 2.0, "m.Parser", "f"), (3, "s3", "removed", 3.0, "m.load", "f")], "id long, symbol_id string, event_type string, timestamp double, qualified_name string, file_path string")
    renames = spark.createDataFrame([("s3", "s2", False), (sid, "s9", True)], "old_symbol_id string, new_symbol_id string, is_candidate boolean")
    one, own, edges, candidates = timeline.when(events, renames, sid)
    assert one == sid and [r["id"] for r in own.collect()] == [1] and rows(edges.select("direction", "old_name", "new_name")) == [("successor", "m.parse", None)] and candidates.collect() == []
    assert timeline.when(events, renames, "LOAD")[0] == "s3"
    one, own, _, candidates = timeline.when(events, renames, "parse")
    assert one is None and own.collect() == [] and [r["symbol_id"] for r in candidates.collect()] == ["s2", sid]
    assert timeline.when(events, renames, "zzz")[0] is None


def test_snapshots_and_emission(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    1\ndef g():\n    2")], "path string, text string")
    schema = "fq_name string, symbol_type string, file_path string, start_line int, end_line int"
    one = timeline.snapshot(spark.createDataFrame([("a.f", "function", "a.py", 1, 2), ("a.g", "function", "a.py", 3, 4), ("b.h", "function", "gone.py", 1, 1)], schema), files, "/r")
    assert one.where("content_hash is null").count() == 1 and one.select("symbol_id").distinct().count() == 3
    two = timeline.snapshot(spark.createDataFrame([("a.f", "function", "a.py", 1, 2), ("z.g", "function", "a.py", 3, 4)], schema), files, "/r")
    events, edges = timeline.emitted(one, two, "/r", 5.0, "sha")
    assert rows(events.select("event_type", "qualified_name")) == [("added", "z.g"), ("removed", "a.g"), ("removed", "b.h")]
    assert [(r["confidence"], r["is_candidate"]) for r in edges.collect()] == [(0.9, True)]
    moved = two.withColumn("content_hash", F.lit("same"))
    events, edges = timeline.emitted(one.where("qualified_name = 'a.g'").withColumn("content_hash", F.lit("same")), moved.where("qualified_name = 'z.g'"), "/r", 6.0)
    assert events.collect() == [] and [r["is_candidate"] for r in edges.collect()] == [False]


def test_a_project_answers_and_says_what_it_lacks(spark, tmp_path):
    files = spark.createDataFrame([("lib/auth/login.py", "source", "def login(user): check password"), ("tests/test_login.py", "test", "login works"), ("docs/a.md", "docs", "how to login"), ("lib/other.py", "source", "nothing")], "path string, role string, text string")
    symbols = spark.createDataFrame([("login", "lib.auth.login.login", "lib/auth/login.py"), ("other", "lib.other.other", "lib/other.py")], "name string, fq_name string, file_path string")
    edges = spark.createDataFrame([("lib/auth/login.py", "lib.auth.login.login"), ("tests/test_login.py", "lib.auth.login.login")], "src string, dst string")
    states = spark.createDataFrame([("lib", "dirty")], "name string, status string")
    one = project.Project("demo", files, symbols, edges, states=states, last_scan=0.0)
    assert one.check(10.0) == {"project": "demo", "files": 4, "symbols": 2, "edges": 2, "vectors": 0, "dirty": 1, "degraded": ["no vectors", "articles out of date"]}
    pack, lacks = one.ask("where is login", 10.0)
    assert pack.files[0] == "lib/auth/login.py" and "lib.auth.login.login" in pack.symbols and lacks == ["no vectors", "articles out of date"]
    one.index = TextIndex.build(files, "path", F.col("text"), f"file://{tmp_path}/fts", F.col("path"))
    assert one.retrieve("where is login").files.first()["path"] == "lib/auth/login.py"
    clock = iter([0.0, 0.0, 1.0, 2.0, 3.0, 100_000.0, 200_000.0]).__next__
    seen = one.watch(100_000.0, 1.0, clock, lambda s: None)
    assert [x["degraded"][0] for x in seen] == ["no vectors", "stale index"] or len(seen) == 1
    empty = project.Project("none", files.limit(0), symbols.limit(0))
    pack, lacks = empty.ask("x y z", 0.0, "edit")
    assert pack.files == [] and pack.coverage == "ambiguous" and lacks == ["not indexed", "no vectors"]


def test_health_of_projects(spark):
    files = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "b"), ("o", "c")], "project string, path string")
    scans = spark.createDataFrame([("p", 10.0), ("p", 99_000.0)], "project string, timestamp double")
    found = project.health(files, files.select("project").limit(2), scans, F.lit(100_000.0))
    assert rows(found.select("project", "files", "symbols", "stale")) == [("o", 1, 0, True), ("p", 2, 2, False)]
