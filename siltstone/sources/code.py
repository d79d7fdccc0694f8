"""Code-corpus sources: binary file scans, parsers, the documentation linker, logs, and incremental merges."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, paths


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """path, content, content_hash, size_bytes, language, role, has_secrets of the files that a scan keeps."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = raw.select(paths.relative_path(F.col("path"), root).alias("path"), "content", F.col("length").alias("size_bytes")).where(F.col("path").isNotNull() & ~paths.is_ignored(F.col("path")))
    small = rel.where(~(F.col("path").endswith(".json") & (F.col("size_bytes") > paths.LARGEST_JSON)))
    text = small.withColumn("language", paths.language(F.col("path"))).where("language is not null").withColumn("text", F.try_validate_utf8(F.col("content").cast("string")))
    return text.select("path", F.coalesce("text", F.lit("")).alias("text"), hashing.content_hash(F.col("content")).alias("content_hash"), "size_bytes", "language", paths.role(F.col("path"), F.col("language")).alias("role"), paths.has_secret(F.coalesce("text", F.lit(""))).alias("has_secrets"))


def changed_files(new: DataFrame, old: DataFrame, key: str = "path", content: str = "content_hash", only: DataFrame | None = None) -> DataFrame:
    """Rows of `new` that are not in `old` with the same content; only: a table of the keys to look at."""
    if only is not None:
        new = new.join(only.select(key).distinct(), key, "left_semi")
    before = old.select(key, F.col(content).alias("siltstone_old"))
    return new.join(before, key, "left").where(~F.col(content).eqNullSafe(F.col("siltstone_old"))).drop("siltstone_old")


def vanished_files(new: DataFrame, old: DataFrame, key: str = "path") -> DataFrame:
    return old.join(new.select(key), key, "left_anti")


def replace_partition(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with all rows of the touched keys replaced."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def upsert(table: DataFrame, rows: DataFrame, *keys: str, order: str | None = None) -> DataFrame:
    """The table with rows of equal keys replaced by the new ones. Of equal new ones the last by `order`; without an order keys must be unique."""
    if order is not None:
        others = [c for c in rows.columns if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("siltstone_x")).select(*keys, *(F.col(f"siltstone_x.{c}").alias(c) for c in others))
    return table.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows)


PARSED = "kind string, file_path string, name string, fq_name string, symbol_type string, start_line int, end_line int, parent string, target string, relation string, confidence double"


class _Python(ast.NodeVisitor):
    """Symbols and relations of one Python module."""

    def __init__(self, path: str) -> None:
        self.path, self.rows, self.scope = path, [], []
        module = path.removesuffix(".py").replace("/", ".")
        self.module = module.removesuffix(".__init__")
        self.names: dict[str, str] = {}

    def symbol(self, node: ast.AST, name: str, kind: str) -> str:
        fq = ".".join([self.module, *self.scope, name])
        parent = ".".join([self.module, *self.scope]) if self.scope else None
        self.rows.append(("symbol", self.path, name, fq, kind, node.lineno, node.end_lineno or node.lineno, parent, None, None, None))
        self.relate(self.path, fq, "defines", 1.0)
        return fq

    def relate(self, src: str, target: str, relation: str, confidence: float) -> None:
        self.rows.append(("relation", self.path, None, src, None, None, None, None, target, relation, confidence))

    def visit_Import(self, node: ast.Import) -> None:
        for item in node.names:
            self.names[(item.asname or item.name).split(".")[0]] = item.name if item.asname else item.name.split(".")[0]
            self.relate(self.path, item.name, "imports", 1.0)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = node.module or ""
        if node.level:
            package = self.module.split(".")[: -node.level]
            base = ".".join([*package, base] if base else package)
        for item in node.names:
            target = f"{base}.{item.name}" if base else item.name
            self.names[item.asname or item.name] = target
            self.relate(self.path, target, "imports", 1.0)

    def resolve(self, node: ast.expr) -> str | None:
        parts = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        if not isinstance(node, ast.Name):
            return None
        head = self.names.get(node.id)
        return ".".join([head or f"{self.module}.{node.id}", *reversed(parts)])

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        fq = self.symbol(node, node.name, "class")
        for base in node.bases:
            if target := self.resolve(base):
                self.relate(fq, target, "inherits", 1.0)
        self.inside(node)

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        in_class = bool(self.scope) and self.scope[-1][:1].isupper()
        fq = self.symbol(node, node.name, "method" if in_class else "function")
        for call in (n for n in ast.walk(node) if isinstance(n, ast.Call)):
            if target := self.resolve(call.func):
                self.relate(fq, target, "same_file_calls" if target.startswith(self.module + ".") else "calls", 0.8)
        self.inside(node)

    visit_FunctionDef = visit_AsyncFunctionDef = function

    def inside(self, node: ast.AST) -> None:
        self.scope.append(node.name)
        self.generic_visit(node)
        self.scope.pop()

    def visit_Assign(self, node: ast.Assign) -> None:
        if not self.scope:
            for target in node.targets:
                if isinstance(target, ast.Name) and target.id.isupper():
                    self.symbol(node, target.id, "constant")
        self.generic_visit(node)


def parse_python(files: DataFrame) -> DataFrame:
    """Tagged rows (symbol, relation, error) of Python files; a file with a syntax error gives one error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in PARSED.split(", ")]
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"]):
                try:
                    visitor = _Python(path)
                    visitor.visit(ast.parse(text))
                    rows += visitor.rows
                except (SyntaxError, ValueError, RecursionError) as error:
                    rows.append(("error", path, str(error), *[None] * 8))
            yield pd.DataFrame(rows, columns=columns).astype({"start_line": "Int32", "end_line": "Int32", "confidence": "float64"})

    return files.where("language = 'python'").select("path", "text").mapInPandas(run, PARSED)


def markdown_headings(files: DataFrame) -> DataFrame:
    """file_path, level, title, fq_name (path#hN-title) of Markdown headings."""
    lines = files.where("language = 'markdown'").select(F.col("path").alias("file_path"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    found = lines.where(F.col("text").rlike("^#{1,6} +\\S")).select("file_path", (F.col("line") + 1).alias("start_line"), F.length(F.regexp_extract("text", "^(#+)", 1)).alias("level"), F.trim(F.regexp_extract("text", "^#+ +(.*)$", 1)).alias("title"))
    return found.withColumn("fq_name", F.concat(F.col("file_path"), F.lit("#h"), F.col("level").cast("string"), F.lit("-"), F.col("title")))


# References to files and to modules in documentation.
FILE_REFERENCE = r"""(?m)(?:^|\s|`|"|\()([a-z][a-z0-9_/]+\.(?:py|js|html|yaml|yml))"""
MODULE_REFERENCE = r"""(?m)(?:^|\s|`|"|\()((?:libs|apps|src|bot)\.[a-z][a-z0-9_.]+)"""


def docs_links(docs: DataFrame, files: DataFrame) -> DataFrame:
    """src_ref, dst_ref: documentation files and the existing files they name, by path or by module."""
    by_path = docs.select(F.col("path").alias("src_ref"), F.explode(F.regexp_extract_all("text", F.lit(FILE_REFERENCE), F.lit(1))).alias("dst_ref"))
    by_module = docs.select(F.col("path").alias("src_ref"), F.explode(F.regexp_extract_all("text", F.lit(MODULE_REFERENCE), F.lit(1))).alias("m")).select("src_ref", F.concat(F.translate(F.regexp_replace("m", r"\.+$", ""), ".", "/"), F.lit(".py")).alias("dst_ref"))
    return by_path.union(by_module).join(files.select(F.col("path").alias("dst_ref")), "dst_ref", "left_semi").where("src_ref <> dst_ref").distinct()


def commit_log(lines: DataFrame) -> DataFrame:
    """sha, author, ts, subject from log lines whose fields are separated by \\x1f."""
    f = F.split("value", "\x1f")
    return lines.where(F.size(f) >= 4).select(f[0].alias("sha"), f[1].alias("author"), F.unix_timestamp(F.to_timestamp(f[2])).cast("double").alias("ts"), f[3].alias("subject"))


def file_git_stats(changes: DataFrame, now: Column) -> DataFrame:
    """Per file: commits, churn in 30 days, last change, age in days, authors, most frequent and last author.

    changes: file_path, author, ts, seq (place in the log, newest first).
    """
    age = F.floor((now - F.min("ts")) / 86400).cast("long")
    sums = changes.groupBy("file_path").agg(
        F.count("*").alias("commit_count"), F.sum((F.col("ts") >= now - 30 * 86400).cast("long")).alias("churn_30d"), F.max("ts").alias("last_modified_ts"), age.alias("age_days"),
        F.array_sort(F.collect_set("author")).alias("authors"), F.min_by("author", "seq").alias("last_author"),
    )
    by_author = changes.groupBy("file_path", "author").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    primary = by_author.groupBy("file_path").agg(F.min_by("author", F.struct(-F.col("n"), F.col("seq"))).alias("primary_author"))
    return sums.join(primary, "file_path")


def usage_events(lines: DataFrame, schema: str) -> DataFrame:
    """Token usage from JSON lines: assistant rows with a usage object; malformed lines are skipped, missing counts are 0."""
    x = lines.select(F.from_json("value", schema).alias("x")).where("x.type = 'assistant' and x.message.usage is not null")
    u = "x.message.usage."
    return x.select(F.unix_timestamp(F.to_timestamp("x.timestamp")).cast("double").alias("ts"), F.col("x.sessionId").alias("session_id"), *(F.coalesce(F.col(u + c), F.lit(0)).alias(c) for c in ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens")))
