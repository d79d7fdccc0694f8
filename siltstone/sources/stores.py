"""Stores as tables: traces, summaries, vectors, scan states, memories, the project registry, usage, checks of stored tables."""

from __future__ import annotations

import json
import os
import re
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import is_transient
from ..functions.hashing import prompt_hash
from ..operators.analytics import cosine, is_stale
from ..operators.timeline import keep_newest
from .code import upsert
from .sinks import TRACE_DAYS, TRACES_KEPT

DAY = 86400.0

# --- traces -------------------------------------------------------------------------------------------------------


def save_traces(traces: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """The trace table after new traces: the last days, at most the newest two thousand of a project; an id occurs once."""
    return keep_newest(upsert(traces, new, "trace_id"), "project", "timestamp", "trace_id", TRACES_KEPT, now - TRACE_DAYS * DAY)


def traces_since(traces: DataFrame, project: str, since: Column) -> DataFrame:
    return traces.where((F.col("project") == project) & (F.col("timestamp") >= since)).orderBy("timestamp", "trace_id")


def latency(stages: str | Column) -> Column:
    """The milliseconds of a trace, over its stages."""
    return F.aggregate(F.coalesce(stages, F.array()), F.lit(0.0), lambda total, s: total + F.coalesce(s["elapsed_ms"], F.lit(0.0)))


def explain(traces: DataFrame, trace_id: str) -> DataFrame:
    """stage, elapsed_ms, candidates, dropped of one trace, in order; dropped: candidates of the stage that the last one lacks."""
    own = traces.where(F.col("trace_id") == trace_id)
    final = F.transform(F.coalesce(F.element_at("stages", -1)["candidates"], F.array()), lambda c: c["path"])
    rows = own.select(final.alias("final"), F.posexplode("stages").alias("place", "s"))
    paths = F.transform("s.candidates", lambda c: c["path"])
    return rows.select("place", F.col("s.name").alias("stage"), F.col("s.elapsed_ms").alias("elapsed_ms"), F.size("s.candidates").alias("candidates"), F.size(F.array_except(paths, F.col("final"))).alias("dropped")).orderBy("place")


# --- summaries ----------------------------------------------------------------------------------------------------


def missing_summaries(files: DataFrame, summaries: DataFrame, model: str, version: str) -> DataFrame:
    """Files (path, text, content_hash) without a summary for their content, this model and this prompt."""
    known = summaries.where((F.col("model") == model) & (F.col("prompt_version") == version)).select("content_hash")
    return files.join(known.distinct(), "content_hash", "left_anti")


def summarize(files: DataFrame, summaries: DataFrame, write: Callable[[str], tuple[str, int, int]], model: str, version: str, price: Column, now: float) -> tuple[DataFrame, DataFrame]:
    """(summaries with the missing ones added, totals: cached, new, tokens, cost). write: text -> (summary, tokens in, tokens out).

    Equal contents are written once.
    """
    todo = missing_summaries(files, summaries, model, version).dropDuplicates(["content_hash"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [write(t or "") for t in batch["text"]]
            yield pd.DataFrame({"content_hash": batch["content_hash"], "summary": [m[0] for m in made], "tokens_in": [m[1] for m in made], "tokens_out": [m[2] for m in made]})

    new = todo.select("content_hash", "text").mapInPandas(run, "content_hash string, summary string, tokens_in long, tokens_out long")
    new = new.select("content_hash", F.lit(model).alias("model"), F.lit(version).alias("prompt_version"), prompt_hash(F.lit(version), F.col("content_hash")).alias("prompt_hash"), "summary", "tokens_in", "tokens_out", price.alias("cost"), F.lit(float(now)).alias("created_at"))
    counts = files.agg(F.count("*").alias("files")).crossJoin(F.broadcast(new.agg(F.count("*").alias("new"), F.coalesce(F.sum(F.col("tokens_in") + F.col("tokens_out")), F.lit(0)).alias("tokens"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 8).alias("cost"))))
    return summaries.unionByName(new), counts.select((F.col("files") - F.col("new")).alias("cached"), "new", "tokens", "cost")


def cost_since(summaries: DataFrame, since: Column) -> DataFrame:
    return summaries.agg(F.round(F.coalesce(F.sum(F.when(F.col("created_at") >= since, F.col("cost"))), F.lit(0.0)), 8).alias("cost"))


# --- vectors ------------------------------------------------------------------------------------------------------


def upsert_vectors(vectors: DataFrame, new: DataFrame, width: int) -> DataFrame:
    """Vectors (project, path, embedding) after new ones; a vector of another width fails the write."""
    checked = new.withColumn("embedding", F.when(F.size("embedding") == width, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("a vector of another width: "), F.size("embedding").cast("string")))))
    return upsert(vectors, checked, "project", "path")


def delete_project(vectors: DataFrame, project: str) -> DataFrame:
    return vectors.where(~F.col("project").eqNullSafe(F.lit(project)))


def search_vectors(vectors: DataFrame, project: str, query: list[float], k: int) -> DataFrame:
    """path, score of the nearest vectors of one project."""
    literal = F.array(*(F.lit(float(x)) for x in query))
    return vectors.where(F.col("project") == project).select("path", F.round(cosine(F.col("embedding"), literal), 6).alias("score")).orderBy(F.desc("score"), "path").limit(k)


# --- projects -----------------------------------------------------------------------------------------------------


def audit(registry: DataFrame, caches: DataFrame, traces: DataFrame, roots: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """One row for each registered project (root, added_at): files, symbols, last_scan, packs, packs_7d, exists, transient, stale.

    caches: root, files, symbols, last_scan; traces: project, timestamp; roots: root of folders that exist.
    """
    packs = traces.groupBy(F.col("project").alias("root")).agg(F.count("*").alias("packs"), F.count_if(F.col("timestamp") >= now - 7 * DAY).alias("packs_7d"))
    there = roots.select("root").distinct().withColumn("exists", F.lit(True))
    rows = registry.join(caches, "root", "left").join(packs, "root", "left").join(there, "root", "left").na.fill(0, ["files", "symbols", "packs", "packs_7d"])
    return rows.withColumns({"exists": F.coalesce("exists", F.lit(False)), "transient": is_transient(F.col("root")), "stale": is_stale(F.col("packs"), F.col("last_scan"), now, days)})


def prune_plan(audited: DataFrame, missing: bool = True, transient: bool = True, stale: bool = False) -> DataFrame:
    """root, reason of the projects to take out of the registry, the first reason that holds: missing, transient, stale."""
    reason = F.coalesce(*(F.when(F.lit(on) & condition, name) for on, condition, name in ((missing, ~F.col("exists"), "missing"), (transient, F.col("transient"), "transient"), (stale, F.col("stale"), "stale"))))
    return audited.select("root", reason.alias("reason")).where("reason is not null")


class Registry:
    """The list of projects in a YAML file, written whole and moved into place; a prune keeps a copy to restore."""

    def __init__(self, path: str) -> None:
        self.path = Path(path)

    def load(self) -> dict:
        import yaml

        data = yaml.safe_load(self.path.read_text()) if self.path.exists() else None
        return {"projects": [], **(data or {})}

    def save(self, data: dict) -> None:
        import yaml

        write_whole(self.path, yaml.safe_dump(data, sort_keys=False, allow_unicode=True))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(p["root"], p.get("name"), float(p["added_at"]) if p.get("added_at") is not None else None) for p in self.load()["projects"]]
        return spark.createDataFrame(rows, "root string, name string, added_at double")

    def put(self, root: str, **facts: object) -> None:
        """Adds a project or updates what is known of it."""
        data = self.load()
        own = next((p for p in data["projects"] if p["root"] == root), None)
        if own is None:
            data["projects"].append({"root": root, **facts})
        else:
            own.update(facts)
        self.save(data)

    def remove(self, roots: list[str]) -> list[str]:
        """Takes projects out; the file as it was is kept beside it. Returns those that were there."""
        data = self.load()
        gone = [p["root"] for p in data["projects"] if p["root"] in set(roots)]
        if gone:
            write_whole(self.backup, self.path.read_text())
            self.save(data | {"projects": [p for p in data["projects"] if p["root"] not in gone]})
        return gone

    @property
    def backup(self) -> Path:
        return self.path.with_suffix(self.path.suffix + ".bak")

    def restore(self) -> list[str]:
        """Puts back the projects of the copy that are missing now; returns them."""
        if not self.backup.exists():
            return []
        now, then = self.load(), Registry(str(self.backup)).load()
        known = {p["root"] for p in now["projects"]}
        back = [p for p in then["projects"] if p["root"] not in known]
        if back:
            self.save(now | {"projects": now["projects"] + back})
        return [p["root"] for p in back]


def write_whole(path: Path, text: str) -> None:
    """Writes a file beside its place and moves it there, so that no reader sees half of it."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    with os.fdopen(handle, "w") as out:
        out.write(text)
    os.replace(name, path)


# --- memories -----------------------------------------------------------------------------------------------------

MEMORY = "name string, topic string, status string, tags array<string>, created double, body string"


def memories(spark: SparkSession, folder: str, status: str | None = None) -> DataFrame:
    """Memory files (front matter between `---` lines, then the body), the newest first; a file without a topic, status and time is skipped."""
    raw = spark.read.text(f"{folder}/*.md", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("name"), "value")
    head, body = F.regexp_extract("value", r"^---\n([\s\S]*?)\n---\n?", 1), F.regexp_replace("value", r"^---\n[\s\S]*?\n---\n?", "")
    entry = lambda key: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{key}:[ \t]*(.*)$", 1)), F.lit(""))
    listed = F.split(F.regexp_replace(F.coalesce(entry("tags"), F.lit("")), r"[\[\]]", ""), ",")
    tags = F.filter(F.transform(listed, lambda t: F.trim(t)), lambda t: t != "")
    rows = raw.select("name", entry("topic").alias("topic"), entry("status").alias("status"), tags.alias("tags"), entry("created").try_cast("double").alias("created"), body.alias("body"))
    good = rows.where("topic is not null and created is not null and status in ('proposed', 'accepted', 'rejected')")
    return (good if status is None else good.where(F.col("status") == status)).orderBy(F.desc("created"), "name")


def propose_memory(folder: str, topic: str, body: str, tags: list[str], now: float) -> str:
    """Writes a memory that waits for approval; returns its name."""
    if not topic.strip() or not body.strip():
        raise ValueError("a memory needs a topic and a body")
    slug = re.sub(r"[^a-z0-9]+", "-", topic.lower()).strip("-") or "memory"
    name, k = slug, 2
    while (Path(folder) / f"{name}.md").exists():
        name, k = f"{slug}-{k}", k + 1
    head = f"topic: {' '.join(topic.split())}\nstatus: proposed\ntags: [{', '.join(tags)}]\ncreated: {now}"
    write_whole(Path(folder) / f"{name}.md", f"---\n{head}\n---\n{body.strip()}\n")
    return name


def decide_memory(folder: str, name: str, accepted: bool) -> None:
    """Accepts or rejects a proposed memory; another state is an error."""
    path = Path(folder) / f"{name}.md"
    text = path.read_text()
    if not re.search(r"(?m)^status: proposed$", text.split("\n---\n")[0]):
        raise ValueError(f"{name} is not waiting for a decision")
    write_whole(path, re.sub(r"(?m)^status: proposed$", f"status: {'accepted' if accepted else 'rejected'}", text, count=1))


# --- query sets and usage -----------------------------------------------------------------------------------------


def query_set(path: str, required: bool = True) -> list[dict]:
    """Queries (id, text, mode, expected) of a YAML file; a file that is not required may be missing."""
    import yaml

    if not required and not Path(path).exists():
        return []
    out = (yaml.safe_load(Path(path).read_text()) or {}).get("queries", [])
    for q in out:
        if missing := {"id", "text", "mode"} - set(q):
            raise ValueError(f"a query lacks {sorted(missing)}")
    return out


def usage_tail(spark: SparkSession, folder: str, checkpoint: str, out: str) -> DataFrame:
    """Reads what has been added to JSON lines of a folder since the last call into a table, and returns the table.

    The stream's checkpoint keeps the files seen; a file is read once, so logs must be rolled, not appended to.
    """
    lines = spark.readStream.schema("value string").text(folder)
    query = lines.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("value string").parquet(out)


# --- checks -------------------------------------------------------------------------------------------------------


def checked(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame | None, str | None]:
    """(table, None), or (None, why it cannot be read): missing, broken, or of another schema. Extra columns are left out."""
    wanted = spark.createDataFrame([], schema).schema
    try:
        found = spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001 - Spark has one class for all of these
        return None, "missing" if "PATH_NOT_FOUND" in str(error) else "broken"
    kinds = {f.name: f.dataType for f in found.schema}
    wrong = [f.name for f in wanted if kinds.get(f.name) != f.dataType]
    return (None, "schema: " + ", ".join(wrong)) if wrong else (found.select(*wanted.names), None)


def healthy(spark: SparkSession, paths: dict[str, str], schema: str) -> tuple[DataFrame | None, dict[str, str]]:
    """The tables of several projects that can be read, as one with a column project, and what is wrong with the others."""
    out, bad = None, {}
    for project, path in paths.items():
        table, why = checked(spark, path, schema)
        if table is None:
            bad[project] = why
        else:
            part = table.withColumn("project", F.lit(project))
            out = part if out is None else out.unionByName(part)
    return out, bad


def validity(files: DataFrame) -> DataFrame:
    """path, role, error (null if well formed) of YAML, JSON and TOML files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tomllib

        import yaml

        parse = {"json": json.loads, "toml": tomllib.loads, "yaml": lambda t: list(yaml.safe_load_all(t))}
        for batch in batches:
            errors = []
            for language, text in zip(batch["language"], batch["text"]):
                try:
                    parse[language](text or "")
                    errors.append(None)
                except (ValueError, yaml.YAMLError, RecursionError) as error:
                    errors.append(str(error).split("\n")[0])
            yield pd.DataFrame({"path": batch["path"], "role": "config", "error": errors})

    return files.where("language in ('json', 'toml', 'yaml')").select("path", "language", "text").mapInPandas(run, "path string, role string, error string")
