"""The jobs as queries over the test tables: each runs twice into one new folder; the second run must change nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import module_articles, scan_corpus
from jobs.common import read_or_empty
from siltstone.functions.paths import SECRETS
from siltstone.functions.text import STOPWORDS
from siltstone.operators.graph import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_scan_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions of documents after two scans, without the numbers of the batches they came in."""
    folder, source, config = _folder(spark, "job1"), f"{sf_dir}/documents.parquet", scan_corpus.Config()
    for _ in range(2):
        scan_corpus.scan(spark, source, f"{folder}/versions", f"{folder}/checkpoint", config)
    return scan_corpus.versions(spark, source, f"{folder}/versions", config).drop("batch", "part")


def job2_module_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles of the sources of documents after two refreshes."""
    folder, config = _folder(spark, "job2"), module_articles.Config()
    for _ in range(2):
        module_articles.refresh(spark, f"{sf_dir}/documents.parquet", f"{folder}/articles", config)
    return read_or_empty(spark, f"{folder}/articles", module_articles.ARTICLES).drop("module")


QUERIES = {"job1_scan_corpus": job1_scan_corpus, "job2_module_articles": job2_module_articles}

_SECRET = f"regexp_matches(coalesce(text, ''), '{'|'.join(SECRETS)}')"
_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"

_SCAN_SQL = f"""WITH f AS (SELECT doc_id, source, lang, sha256(coalesce(text, '')) AS content_hash, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size_bytes, CAST(len({_WORDS}) AS BIGINT) AS words, {_SECRET} AS has_secret FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, source, lang, 'added' AS event, content_hash, size_bytes, words, has_secret FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY content_hash DESC, source DESC NULLS LAST, lang DESC NULLS LAST) = 1"""


def _best_sql(item: str, k: int) -> str:
    return f"(SELECT name, string_agg({item} || ':' || n, ', ' ORDER BY r) AS items FROM (SELECT name, {item}, count(*) AS n, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, {item}) AS r FROM {item}s GROUP BY name, {item}) WHERE r <= {k} GROUP BY name)"


_ARTICLES_SQL = f"""WITH d AS (SELECT coalesce(nullif(source, ''), 'none') AS name, coalesce(nullif(lang, ''), 'none') AS language, coalesce(text, '') AS text, sha256(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || sha256(coalesce(text, ''))) AS digest FROM documents),
s AS (SELECT name, CAST(sum(('0x' || substr(digest, 1, 15))::BIGINT) AS VARCHAR) AS hash, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) FILTER (WHERE {_SECRET}) AS secrets FROM d GROUP BY name),
words AS (SELECT name, word FROM (SELECT name, unnest({_WORDS}) AS word FROM d) WHERE len(word) >= 3 AND word NOT IN ({", ".join(f"'{w}'" for w in STOPWORDS)})), languages AS (SELECT name, language FROM d)
SELECT s.name, 'current' AS status, hash, files, bytes, secrets, l.items AS languages, coalesce(w.items, '') AS words,
 '# ' || s.name || chr(10) || chr(10) || files || ' files, ' || bytes || ' bytes, ' || secrets || ' with secrets' || chr(10) || chr(10) || 'Languages: ' || l.items || chr(10) || chr(10) || 'Words: ' || coalesce(w.items, '') || chr(10) AS text
FROM s LEFT JOIN {_best_sql("language", 5)} l ON l.name = s.name LEFT JOIN {_best_sql("word", 12)} w ON w.name = s.name"""

ORACLES = {"job1_scan_corpus": _SCAN_SQL, "job2_module_articles": _ARTICLES_SQL}
