"""Code-graph operators: import resolution, the mixed walk, module dependencies, lint checks, commit ranges."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import looks_like_file, module_of
from .graph import bfs, kept

# Endings tried for a relative import, in this order.
RELATIVE_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """src, ref, dst: the file each import (src, ref) means.

    Candidates with priorities meet the table of paths in one equi-join: a dotted module as a file or a package, ever
    shorter prefixes of it, relative paths with the usual endings, aliases, at last paths that end with the reference
    (the smallest one). The lowest priority that exists wins.
    """
    src, ref = F.col("src"), F.col("ref")
    dotted = F.translate(ref, ".", "/")
    parts = F.split(ref, r"\.")
    base = F.array_join(F.slice(F.split(src, "/"), 1, F.greatest(F.size(F.split(src, "/")) - 1, F.lit(0))), "/")
    up = F.length(F.regexp_extract(ref, r"^((?:\.\./)*)", 1)) / 3
    folder = F.array_join(F.slice(F.split(base, "/"), 1, F.greatest(F.size(F.split(base, "/")) - up.cast("int"), F.lit(0))), "/")
    relative = F.regexp_replace(F.concat_ws("/", folder, F.regexp_replace(ref, r"^(\.\.?/)+", "")), "^/", "")
    option = lambda priority, path: F.struct(F.lit(priority).alias("priority"), path.alias("dst"))
    module = [option(0, F.concat(dotted, F.lit(".py"))), option(1, F.concat(dotted, F.lit("/__init__.py")))]
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.struct((i + 1).alias("priority"), F.concat(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - i, F.lit(1))), "/"), F.lit(".py")).alias("dst")))
    near = [option(100 + i, F.concat(relative, F.lit(s))) for i, s in enumerate(("", *RELATIVE_SUFFIXES))]
    other = [option(200 + i, F.concat(F.regexp_replace(ref, "^" + re.escape(a), b), F.lit(s))) for a, b in (aliases or {}).items() for i, s in enumerate(("", *RELATIVE_SUFFIXES))]
    plain = F.when(ref.startswith("."), F.array(*near)).when(F.contains(ref, F.lit("/")), F.array(*other) if other else F.array().cast("array<struct<priority:int,dst:string>>")).otherwise(F.concat(F.array(*module), prefixes))
    wanted = imports.select("src", "ref", F.explode(plain).alias("x")).select("src", "ref", "x.priority", "x.dst")
    exact = wanted.join(files.select(F.col("path").alias("dst")), "dst", "left_semi")
    pieces = F.split("path", "/")
    tails = files.select(F.col("path").alias("dst"), F.explode(F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, i, F.size(pieces) - i + 1), "/"))).alias("tail"))
    slashed = imports.where(F.contains(ref, F.lit("/")) & ~ref.startswith(".")).withColumn("tail", ref)
    by_tail = slashed.join(tails, "tail").groupBy("src", "ref").agg(F.min("dst").alias("dst")).select("src", "ref", F.lit(1000).alias("priority"), "dst")
    return exact.select("src", "ref", "priority", "dst").unionByName(by_tail).groupBy("src", "ref").agg(F.min_by("dst", "priority").alias("dst")).where("src <> dst")


def path_aliases(settings: str) -> dict[str, str]:
    """Prefixes of imports and the folders they stand for, from a tsconfig.json; comments and trailing commas are allowed, broken ones give none."""
    plain = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m[1] or "", settings)
    try:
        options = json.loads(re.sub(r",(\s*[}\]])", r"\1", plain)).get("compilerOptions") or {}
    except (ValueError, AttributeError):
        return {}
    base = (options.get("baseUrl") or ".").strip("./")
    out = {}
    for name, targets in (options.get("paths") or {}).items():
        if targets:
            target = "/".join(x for x in (base, re.sub(r"^\./", "", targets[0]).removesuffix("*").rstrip("/")) if x)
            out[name.removesuffix("*")] = target + ("/" if name.endswith("*") and target else "")
    return out


def mixed_walk(edges: DataFrame, seeds: DataFrame, decay: float = 0.7, *by: str) -> DataFrame:
    """node, score: files two hops from a seed file through symbols. by: columns of the seeds that tell walks apart.

    Callers: files that point at the symbols below the seed's own module; dependencies: files that define the modules the
    seed's other symbols name. Seeds may be reached.
    """
    module = F.translate(F.regexp_replace("node", r"\.[^./]+$", ""), "/", ".")
    own = seeds.withColumn("module", module).join(edges.withColumnRenamed("src", "node"), "node").withColumnRenamed("dst", "symbol")
    own = kept(own, "walk-own")  # the smaller side of the joins below, which only its size tells
    mine = F.startswith(F.col("symbol"), F.concat("module", F.lit(".")))
    callers = own.where(mine).join(edges.select(F.col("src").alias("found"), F.col("dst").alias("symbol")), "symbol").where(looks_like_file(F.col("found")))
    parts = F.split("symbol", r"\.")
    target = F.concat(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"), F.lit(".py"))
    known = edges.select(F.col("src").alias("found")).union(edges.select("dst")).distinct()
    defining = own.where(~mine & (F.size(parts) >= 2)).withColumn("found", target).join(known, "found")
    both = callers.select(*by, "node", "found", "score").unionByName(defining.select(*by, "node", "found", "score")).where("node <> found")
    return both.groupBy(*by, F.col("found").alias("node")).agg(F.round(F.max("score") * decay**2, 6).alias("score"))


def module_dependencies(edges: DataFrame) -> DataFrame:
    """src, dst, n: dependencies between modules (two path segments), with the number of file edges behind each."""
    return edges.select(module_of(F.col("src")).alias("src"), module_of(F.col("dst")).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def lint(articles: DataFrame, modules: DataFrame, index: DataFrame, least: int = 50) -> DataFrame:
    """issue, name: orphan articles, modules without one, stale and empty articles, and index lines that do not match either way."""
    a, m, i = articles.select("name", "hash", "size"), modules.select("name", F.col("hash").alias("now")), index.select("name")
    issue = lambda df, kind: df.select(F.lit(kind).alias("issue"), "name")
    out = issue(a.join(m, "name", "left_anti"), "orphan").unionByName(issue(m.join(a, "name", "left_anti"), "missing"))
    out = out.unionByName(issue(a.join(m, "name").where("hash <> now"), "stale")).unionByName(issue(a.where(F.col("size") < least), "empty"))
    return out.unionByName(issue(a.join(i, "name", "left_anti"), "unindexed")).unionByName(issue(i.join(a, "name", "left_anti"), "dangling"))


def commits_between(parents: DataFrame, old: str, new: str) -> DataFrame:
    """commit_sha of the commits reachable from `new` and not from `old`; parents: (sha, parent). Histories of any length."""
    edges = parents.select(F.col("sha").alias("src"), F.col("parent").alias("dst")).where("dst is not null")
    depth = parents.select("sha").distinct().count() + 1  # no path is longer; walks end when nothing new is found
    reach = lambda sha: bfs(edges, parents.sparkSession.range(1).select(F.lit(sha).alias("node")), depth).select(F.col("node").alias("commit_sha"))
    return reach(new).join(reach(old), "commit_sha", "left_anti")
