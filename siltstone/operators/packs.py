"""Context packs: the Markdown that hands the result of a retrieval on, for finding one's way and for editing."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_test_path
from .retrieval import Retrieval, disambiguators

MEMORIES, MEMORY_CHARS, TIMELINE_BYTES = 5, 600, 3000
#: The score of a file that is in an edit pack only because it is changed and not committed.
CHANGED_SCORE = 5.0
_CONFIG_ENDINGS = (".yaml", ".yml", ".json", ".toml")


@dataclass
class Pack:
    mode: str
    markdown: str
    files: list[str]
    symbols: list[str]
    coverage: str

    @property
    def size_bytes(self) -> int:
        return len(self.markdown.encode())


def _listed(items: Iterable[str], empty: str) -> list[str]:
    return list(items) or [f"_{empty}_"]


def hint(tokens: DataFrame, of: int) -> str | None:
    """What to add to a query whose candidates are all alike, from (token, coverage) rows, at most three."""
    found = [f"`{r['token']}` ({r['coverage']} of {of})" for r in tokens.collect()]
    return "Words that tell the candidates apart: " + ", ".join(found) if found else None


def memories_section(memories: DataFrame | None) -> list[str]:
    """The newest accepted memories (topic, tags, body, created), shortened."""
    if memories is None:
        return []
    rows = memories.where("status = 'accepted'").orderBy(F.desc("created"), "topic").limit(MEMORIES).collect()
    out = ["## Approved memories", ""] if rows else []
    for r in rows:
        body = r["body"].strip()
        tags = f"  `{' '.join(r['tags'])}`" if r["tags"] else ""
        out += [f"### {r['topic']}{tags}", body if len(body) <= MEMORY_CHARS else body[:MEMORY_CHARS].rstrip() + "...", ""]
    return out


def timeline_section(facts: DataFrame | None) -> list[str]:
    """Lines about history (kind, name, path, timestamp), the most recent first, within TIMELINE_BYTES; says how many are left out."""
    if facts is None:
        return []
    rows = facts.orderBy(F.desc("timestamp"), "name").limit(TIMELINE_BYTES).collect()  # more never fit
    lines, size = [], 0
    for r in rows:
        line = f"- {r['kind']}: `{r['name']}` in `{r['path']}`"
        size += len(line.encode()) + 1
        if size > TIMELINE_BYTES:
            lines.append(f"- and {facts.count() - len(lines)} more")
            break
        lines.append(line)
    return ["## Timeline", "", *lines, ""] if lines else []


def build(result: Retrieval, project: str, query: str, mode: str = "navigate", memories: DataFrame | None = None, changed: DataFrame | None = None, facts: DataFrame | None = None) -> Pack:
    """The pack of a retrieval, whose files are few. changed: path of files that are changed and not committed (edit mode)."""
    spark = result.files.sparkSession
    scores = {r["path"]: r["score"] for r in result.files.collect()}
    symbols = [r["fq_name"] for r in result.symbols.collect()]
    edit = mode == "edit"
    dirty = sorted(r["path"] for r in changed.select("path").distinct().collect()) if edit and changed is not None else []
    for path in dirty:
        scores.setdefault(path, CHANGED_SCORE)
    files = list(scores)
    out = [f"# Context pack — {mode}", "", f"**Project:** `{project}`", f"**{'Intent' if edit else 'Query'}:** {query}", f"**Coverage:** {result.coverage}", ""]
    if result.coverage == "ambiguous":
        table = spark.createDataFrame([(p,) for p in files], "path string")
        advice = hint(disambiguators(table, "path", query), len(files))
        out += ["> **Ambiguous coverage:** many files scored alike. Ask again with more specific words" + (" before changing anything." if edit else "."), *([f"> {advice}"] if advice else []), ""]
    elif edit:
        out += ["> Files by role, for a small change that can be undone. Run the checks after every step.", ""]
    out += memories_section(memories)
    if not edit:
        out += ["## Top files", "", *_listed((f"{i}. `{p}` (score {s:.2f})" for i, (p, s) in enumerate(scores.items(), 1)), "no files retrieved"), ""]
        out += ["## Top symbols", "", *_listed((f"{i}. `{s}`" for i, s in enumerate(symbols, 1)), "no symbols retrieved"), ""]
    else:
        parts = sections(spark.createDataFrame([(p,) for p in files], "path string")) if files else {}
        if dirty:
            out += ["## Currently modified (uncommitted)", "", *(f"- `{p}`" for p in dirty), ""]
        out += ["## Target files", "", *_listed((f"- `{p}` (score {scores[p]:.2f})" for p in files if parts[p] == "targets"), "no target files identified"), ""]
        out += ["## Impacted tests", "", *_listed((f"- `{p}`" for p in files if parts[p] == "tests"), "no tests matched"), ""]
        out += ["## Impacted configs", "", *_listed((f"- `{p}`" for p in files if parts[p] == "configs"), "no config files matched"), ""]
        out += ["## Candidate symbols", "", *_listed((f"- `{s}`" for s in symbols), "no symbol candidates"), ""]
    out += timeline_section(facts)
    return Pack(mode, "\n".join(out), files, symbols, result.coverage)


def section(path):
    """The part of an edit pack a file goes to: tests before configs before targets."""
    config = F.contains(path, F.lit("/config/"))
    for ending in _CONFIG_ENDINGS:
        config = config | path.endswith(ending)
    return F.when(is_test_path(path), "tests").when(config, "configs").otherwise("targets")


def sections(files: DataFrame) -> dict[str, str]:
    return {r["path"]: r["part"] for r in files.select("path", section(F.col("path")).alias("part")).collect()}
