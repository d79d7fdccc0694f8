"""Impact of a change: dependents, affected tests and risk; tests by name; relations brought down to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, module_of
from .graph import dependents, file_dependencies, kept, risk


def is_affected_test(path: Column, role: Column) -> Column:
    return (F.coalesce(role, F.lit("")) == "test") | F.contains(path, F.lit("/test")) | path.startswith("test")


def report(relations: DataFrame, files: DataFrame, target: str, depth: int = 4, churn: int = 0) -> DataFrame:
    """kind, node, risk: direct and transitive dependents, tests among them, and one row with the risk of the target.

    relations: relation_type, src_ref, dst_ref; files: path, role. A depth of 1 has direct dependents only.
    """
    dependencies = kept(file_dependencies(relations), "dependencies")
    near = kept(dependents(dependencies, target, depth), "dependents")
    kinds = near.select(F.when(F.col("hop") == 1, "direct").otherwise("transitive").alias("kind"), "node")
    roles = near.join(files.select(F.col("path").alias("node"), "role"), "node", "left")
    tests = roles.where(is_affected_test(F.col("node"), F.col("role"))).select(F.lit("test").alias("kind"), "node")
    fans = dependencies.agg(F.count_distinct(F.when(F.col("dst") == target, F.col("src"))).alias("i"), F.count_distinct(F.when(F.col("src") == target, F.col("dst"))).alias("o"))
    own = fans.select(F.lit("risk").alias("kind"), F.lit(target).alias("node"), F.round(risk(F.col("i"), F.col("o"), F.lit(churn)).cast("double"), 6).alias("risk"))
    return kinds.unionByName(tests).withColumn("risk", F.lit(None).cast("double")).unionByName(own)


def risks(dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """path, fan_in, fan_out, risk of all files (path, churn), from their dependencies (src, dst)."""
    fans = dependencies.select(F.col("dst").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(dependencies.select("src", F.lit(0), F.lit(1)))
    fans = fans.groupBy("path").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    known = files.join(fans, "path", "left").na.fill(0, ["fan_in", "fan_out"])
    return known.select("path", "fan_in", "fan_out", risk(F.col("fan_in"), F.col("fan_out"), F.coalesce("churn", F.lit(0))).cast("double").alias("risk"))


def test_presence(files: DataFrame) -> DataFrame:
    """path, has_tests of source files: a test file's path ends with `test_<name>` or with the name made `_test.py`.

    The test's path ends with the name, so the name is what follows one of its places where `test_` begins, or its own
    file name; these few endings of each test meet the names in one equi-join.
    """
    sources = files.where("role = 'source'").select("path", basename(F.col("path")).alias("base"))
    tests = files.where("role = 'test'").select(F.col("path").alias("test"))
    places = F.filter(F.sequence(F.lit(1), F.length("test")), lambda i: F.substring("test", i, F.lit(5)) == "test_")
    after = F.transform(places, lambda i: F.substring(F.col("test"), i + 5, F.length("test")))
    # A name made `_test.py` may be any ending of the path; a file name has no slash, so endings of the last segment do.
    leaf = basename(F.col("test"))
    made = F.when(leaf.endswith("_test.py"), F.transform(F.sequence(F.lit(1), F.length(leaf)), lambda i: F.concat(F.regexp_replace(F.substring(leaf, i, F.length(leaf)), r"_test\.py$", ""), F.lit(".py")))).otherwise(F.array().cast("array<string>"))
    names = tests.select(F.explode(F.array_distinct(F.concat(after, made))).alias("base")).distinct().withColumn("siltstone_found", F.lit(True))
    plain = tests.select(leaf.alias("base")).distinct().withColumn("siltstone_same", F.lit(True))  # a name without .py ends a test's path as it is
    found = sources.join(names, "base", "left").join(plain, "base", "left")
    same = ~F.contains("base", F.lit(".py")) & F.col("siltstone_same").isNotNull()
    return found.select("path", (F.col("siltstone_found").isNotNull() | same).alias("has_tests"))


def file_edges(relations: DataFrame, defines: DataFrame) -> DataFrame:
    """src, dst for each relation whose ends are files or symbols of a file; parallel edges stay, self-edges go.

    A symbol belongs to the file that defines it; of several the last by name.
    """
    owner = defines.where("relation_type = 'defines' and src_type = 'file' and dst_type = 'symbol'").groupBy(F.col("dst_ref").alias("symbol")).agg(F.max("src_ref").alias("file"))
    out = relations
    for end in ("src", "dst"):
        own = owner.select(F.col("symbol").alias(f"{end}_ref"), F.col("file").alias(f"{end}_file"))
        out = out.join(own, f"{end}_ref", "left").withColumn(end, F.when(F.col(f"{end}_type") == "file", F.col(f"{end}_ref")).otherwise(F.col(f"{end}_file")))
        if end == "dst":
            out = out.withColumn(end, F.coalesce(end, F.when(F.col("dst_type") == "symbol", F.col("dst_file"))))
    return out.where("src is not null and dst is not null and src <> dst").select("src", "dst")


def tests_for(imports: DataFrame, files: DataFrame, roots: tuple[str, ...]) -> DataFrame:
    """src (a test file), dst: the files that a test's imports (src, ref) of the project's own packages stand for.

    roots: first segments that are the project's own. A reference names a module or something in it, so it is tried whole
    and without its last part, as a file and as a package.
    """
    tests = files.where("role = 'test'").select(F.col("path").alias("src"))
    own = imports.join(tests, "src", "left_semi").where(F.split("ref", r"\.")[0].isin(*roots))
    whole = F.translate("ref", ".", "/")
    shorter = F.regexp_replace(whole, "/[^/]*$", "")
    tried = F.array(*(F.concat(base, F.lit(end)) for base in (whole, shorter) for end in (".py", "/__init__.py")))
    wanted = own.select("src", "ref", F.posexplode(tried).alias("priority", "dst"))
    real = wanted.join(files.select(F.col("path").alias("dst")), "dst", "left_semi")
    return real.groupBy("src", "ref").agg(F.min_by("dst", "priority").alias("dst")).select("src", "dst").distinct()


def first_pairs(edges: DataFrame, k: int) -> DataFrame:
    """src, dst, n: the first k pairs of different modules of file edges (seq, src, dst), in the order of their first edge."""
    pairs = edges.select("seq", module_of(F.col("src")).alias("src"), module_of(F.col("dst")).alias("dst")).where("src <> dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("n"), F.min("seq").alias("first")).orderBy("first", "src", "dst").limit(k).drop("first")
