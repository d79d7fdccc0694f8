"""Modules: rollups for notes, articles and their index, the state of articles, project pages, checks of a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import module_of
from .code_graph import module_dependencies


def rollup(files: DataFrame, symbols: DataFrame, edges: DataFrame, first: int = 10) -> DataFrame:
    """module, files, symbols, first_symbols, dependencies, dependents: sorted lists, joined by commas; modules of files (path).

    symbols: fq_name, file_path; edges between files: src, dst. The first symbols are the smallest names.
    """
    counted = files.select(module_of(F.col("path")).alias("module")).groupBy("module").agg(F.count("*").alias("files"))
    owned = symbols.select(module_of(F.col("file_path")).alias("module"), "fq_name").groupBy("module", "fq_name").agg(F.count("*").alias("n"))
    by_module = owned.groupBy("module").agg(F.sum("n").alias("symbols"))
    # The smallest names of each module, by partial minima: no list of all of them is made.
    names = smallest(owned, "module", "fq_name", first)
    pairs = module_dependencies(edges)
    listed = lambda by, of, name: pairs.groupBy(F.col(by).alias("module")).agg(F.array_join(F.array_sort(F.collect_set(of)), ",").alias(name))
    out = counted
    for part in (by_module, names, listed("src", "dst", "dependencies"), listed("dst", "src", "dependents")):
        out = out.join(part, "module", "left")
    return out.select("module", "files", F.coalesce("symbols", F.lit(0)).alias("symbols"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("first_symbols", "dependencies", "dependents")))


def smallest(rows: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """group, first_symbols: the n smallest values of each group, joined by commas."""
    from pyspark.sql import Window

    top = rows.withColumn("siltstone_r", F.row_number().over(Window.partitionBy(group).orderBy(value))).where(F.col("siltstone_r") <= n)
    return top.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(value)), ",").alias("first_symbols"))


def purpose(text: Column) -> Column:
    """The first sentence below the heading Purpose; empty where there is none."""
    body = F.regexp_extract(text, r"(?m)^##+ +Purpose[ \t]*\n+([^\n#][^\n]*)", 1)
    return F.trim(F.regexp_extract(body, r"^(.*?[.!?](?=\s|$)|.*)", 1))


def article_index(articles: DataFrame, *by: str) -> DataFrame:
    """by, line, place: the index of articles (name, text): one line for each, in the order of the names."""
    line = F.concat(F.lit("- ["), "name", F.lit("]("), "name", F.lit(".md)"), F.when(F.length("p") > 0, F.concat(F.lit(": "), "p")).otherwise(""))
    return articles.withColumn("p", purpose(F.col("text"))).select(*by, line.alias("line"), F.col("name").alias("place"))


def article_states(state: DataFrame, modules: DataFrame) -> DataFrame:
    """name, hash, status after a look at the modules (name, hash): dirty where it is new or has changed, gone where it is no more."""
    old = state.select("name", F.col("hash").alias("old_hash"), F.col("status").alias("old_status"))
    both = old.join(modules.select("name", F.col("hash").alias("new_hash")), "name", "full")
    status = F.when(F.col("new_hash").isNull(), "gone").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), F.col("old_status")).otherwise("dirty")
    return both.select("name", F.coalesce("new_hash", "old_hash").alias("hash"), status.alias("status"))


def mark_current(state: DataFrame, written: DataFrame) -> DataFrame:
    """The state after articles (name, hash) have been written: current, if the module is still the one they were written for."""
    done = written.select("name", F.col("hash").alias("siltstone_hash"))
    return state.join(done, "name", "left").withColumn("status", F.when(F.col("siltstone_hash") == F.col("hash"), "current").otherwise(F.col("status"))).drop("siltstone_hash")


def project_page(files: DataFrame, project: str, symbols: int, relations: int) -> str:
    """A Markdown page with numbers of files by language and role, the largest first. There are a dozen of either."""
    out = [f"# {project}", "", f"{files.count()} files, {symbols} symbols, {relations} relations", ""]
    for column in ("language", "role"):
        rows = files.groupBy(column).count().orderBy(F.desc("count"), column).collect()
        out += [f"## By {column}", "", *(f"- {r[column]}: {r['count']}" for r in rows), ""]
    return "\n".join(out)


def degraded(files: int, last_scan: float | None, vectors: int, dirty: int, now: float, old_hours: float = 24.0) -> list[str]:
    """What a project's answers must do without."""
    out = [] if files else ["not indexed"]
    if files and (last_scan is None or now - last_scan > old_hours * 3600):
        out.append("stale index")
    if not vectors:
        out.append("no vectors")
    if dirty:
        out.append("articles out of date")
    return out


def doctor(checks: dict[str, object], spark) -> DataFrame:
    """check, ok, detail: each check is a function that returns a detail or raises."""
    rows = []
    for name, check in checks.items():
        try:
            rows.append((name, True, str(check() or "")))
        except Exception as error:  # noqa: BLE001 - a failing check is a result here
            rows.append((name, False, str(error).split("\n")[0]))
    return spark.createDataFrame(rows, "check string, ok boolean, detail string")


def standard_checks(spark, tables: dict[str, str]) -> dict[str, object]:
    """Checks of a session and of the tables (name: path) of a project."""
    from .graph import shared_folder

    def rows(path: str):
        return lambda: f"{spark.read.parquet(path).count()} rows"

    def zone() -> str:
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            raise ValueError("times are not UTC")
        return "UTC"

    def writes() -> str:
        path = f"{shared_folder(spark)}/doctor"
        spark.range(1).write.mode("overwrite").parquet(path)
        return path

    adaptive = lambda: spark.conf.get("spark.sql.adaptive.enabled") == "true" or 1 / 0
    return {"session": lambda: spark.version, "time zone": zone, "shared folder": writes, "adaptive execution": adaptive, **{f"table {n}": rows(p) for n, p in tables.items()}}
