"""Refreshes the articles of modules: one page for each module of a corpus, written anew where the module has changed.

    python -m jobs.module_articles --source DOCUMENTS --output ARTICLES --config jobs/module_articles.json

A module is what rows of one value of the module column make up. Its fingerprint is a sum over its rows of 60 bits of a
digest of key and text, so it needs no order and no list of a module's rows. A run compares the fingerprints with those of
the published articles: modules that are new or changed are dirty and get a new article (files, bytes, files with secrets,
languages, most frequent words), modules without rows any more keep a row that says `gone`, all others are not touched. An
article is made of its module's rows alone, so a refresh gives what a whole run would give. Texts never move: they are
counted where they are read, and only numbers of words meet by module. Up to MOST_SENT dirty modules are sent to the readers,
which leave other modules out; if more are dirty, all rows are counted and the counts of other modules are left out.

Output is partitioned by module, and a run overwrites the partitions of dirty and gone modules only; running it again
changes nothing. A null or empty module is `none`, a null text counts as empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import command, log, read_or_empty
from siltstone.functions import hashing, paths
from siltstone.functions.text import STOPWORDS, strings, word_tokens
from siltstone.operators.modules import article_states

MOST_SENT = 10_000  # names of modules that are broadcast


@dataclass(frozen=True)
class Config:
    """module, key, text, language: columns of the source; words, languages: how many an article names; least_letters: of a named word."""

    module: str = "source"
    key: str = "doc_id"
    text: str = "text"
    language: str = "lang"
    words: int = 12
    languages: int = 5
    least_letters: int = 3


ARTICLES = "name string, status string, hash string, files long, bytes long, secrets long, languages string, words string, text string, module string"


def _named(column: str) -> Column:
    value = F.col(column).cast("string")
    return F.coalesce(F.when(F.length(value) > 0, value), F.lit("none"))


def fingerprint(key: Column, text: Column) -> Column:
    """An aggregate that is equal for equal sets of rows, in any order."""
    digest = F.sha2(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), hashing.content_hash(text)).cast("binary"), 256)
    return F.sum(F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")


def best(rows: DataFrame, item: str, k: int, name: str) -> DataFrame:
    """name, `name`: the k most frequent items of each module with their numbers. Rows are counted before they meet by module."""
    counted = rows.groupBy("name", item).agg(F.count("*").alias("n"))
    order = Window.partitionBy("name").orderBy(F.desc("n"), item)
    top = counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("r", item, "n"))), lambda x: F.concat(x[item], F.lit(":"), x["n"].cast("string")))
    return top.groupBy("name").agg(F.array_join(listed, ", ").alias(name))


def articles(rows: DataFrame, dirty: DataFrame, config: Config, number: int) -> DataFrame:
    """The articles of the dirty modules (name, hash); number: how many there are."""
    text = F.coalesce(F.col(config.text), F.lit(""))
    own = rows.withColumn("name", _named(config.module))
    if number <= MOST_SENT:  # else what is counted of other modules goes where the counts meet the dirty ones
        own = own.join(F.broadcast(dirty.select("name")), "name", "left_semi")
    sizes = own.groupBy("name").agg(F.count("*").alias("files"), F.sum(F.octet_length(text)).cast("long").alias("bytes"), F.count_if(paths.has_secret(text)).alias("secrets"))
    telling = F.filter(word_tokens(text), lambda w: (F.length(w) >= config.least_letters) & ~F.array_contains(strings(STOPWORDS), w))
    words = best(own.select("name", F.explode_outer(telling).alias("word")).where("word is not null"), "word", config.words, "words")
    languages = best(own.select("name", _named(config.language).alias("language")), "language", config.languages, "languages")
    whole = dirty.join(sizes, "name").join(languages, "name", "left").join(words, "name", "left").withColumn("words", F.coalesce("words", F.lit("")))
    page = F.concat(F.lit("# "), "name", F.lit("\n\n"), F.col("files").cast("string"), F.lit(" files, "), F.col("bytes").cast("string"), F.lit(" bytes, "), F.col("secrets").cast("string"), F.lit(" with secrets\n\nLanguages: "), "languages", F.lit("\n\nWords: "), "words", F.lit("\n"))
    return whole.withColumns({"status": F.lit("current"), "text": page, "module": F.col("name")})


def refresh(spark: SparkSession, source: str, output: str, config: Config) -> dict:
    """Writes the articles that are due; returns and logs what was read and written."""
    rows = spark.read.parquet(source)
    text = F.coalesce(F.col(config.text), F.lit(""))
    modules = rows.groupBy(_named(config.module).alias("name")).agg(fingerprint(F.col(config.key), text).alias("hash"), F.count("*").alias("n")).persist()  # a row for each module; the texts are read once for it
    published = read_or_empty(spark, output, ARTICLES)
    states = article_states(published.select("name", "hash", "status"), modules)
    known = published.select("name", F.col("status").alias("was"))
    # A row that says gone has no hash, so that a module that comes back is due again.
    due = states.join(known, "name", "left").withColumn("status", F.when((F.col("status") == "gone") & (F.col("was") == "gone"), "known").otherwise(F.col("status")))
    due = due.join(modules.select("name", "n"), "name", "left").select("name", "hash", "status", "n")
    try:
        is_ = lambda status: F.count_if(F.col("status") == status).alias(status)
        counts = due.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("read"), F.count("n").alias("modules"), is_("dirty"), is_("gone")).first().asDict()
        columns = [c.split()[0] for c in ARTICLES.split(", ")]
        gone = due.where("status = 'gone'").select("name", "status", F.lit("").alias("hash"), F.lit(0).cast("long").alias("files"), F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("secrets"), F.lit("").alias("languages"), F.lit("").alias("words"), F.lit("").alias("text"), F.col("name").alias("module"))
        if counts["dirty"] or counts["gone"]:
            out = articles(rows, due.where("status = 'dirty'").select("name", "hash"), config, counts["dirty"]).select(*columns).unionByName(gone.select(*columns))
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("module").parquet(output)
    finally:
        modules.unpersist()
    log.info("module_articles: read %d rows of %s, %d modules; wrote %d articles and %d marks of gone modules to %s", counts["read"], source, counts["modules"], counts["dirty"], counts["gone"], output)
    return counts


if __name__ == "__main__":
    command("module_articles", __doc__.splitlines()[0], ("source", "output"), Config, refresh)
