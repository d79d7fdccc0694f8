"""Identifier tokens, stop-words, query expansion and normalisation as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .terms import ENGLISH, RUSSIAN

# Words that carry no meaning in a query.
STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "shall", "can", "to", "of", "in", "on", "at", "by", "for", "with", "from", "and", "or", "but",
    "not", "no", "nor", "so", "yet", "how", "where", "which", "what", "when", "who", "that", "i", "it", "its", "if", "as", "up",
)
# Path words too common to tell candidates apart.
GENERIC_TOKENS = ("src", "lib", "libs", "app", "apps", "test", "tests", "docs", "doc", "py", "ts", "js", "go", "rs", "pkg", "internal", "main", "init", "index")


def strings(values: tuple[str, ...] | list[str]) -> Column:
    """An array literal."""
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def word_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


_IDENTIFIER = "[a-zA-Zа-яА-ЯёЁ0-9]"


def identifier_tokens(text: Column) -> Column:
    """Latin and Cyrillic letters and digits, split at everything else and before a capital that follows a small letter or digit, in lower case.

    Runs of capitals stay together: `HTTPServer` is one token.
    """
    token = f"{_IDENTIFIER}(?:[a-z0-9а-яА-ЯёЁ]++|(?<![a-z0-9])[A-Z])*+"  # one pattern, which stops before a hump
    return F.transform(F.regexp_extract_all(text, F.lit(token), F.lit(0)), F.lower)


def identifiers(text: str) -> list[str]:
    """identifier_tokens for a query, which is one string and lives on the driver."""
    return [t.lower() for t in re.findall(f"{_IDENTIFIER}+", re.sub("(?<=[a-z0-9])(?=[A-Z])", " ", text))]


def query_terms(text: str) -> list[str]:
    """The lower-case raw terms of a query (with `_`, `.` and `-` in them) and its identifier tokens, each once, in this order."""
    raw = [t.lower() for t in re.findall("[a-zA-Zа-яА-ЯёЁ0-9_.-]+", text)]
    return list(dict.fromkeys(raw + identifiers(text)))


def without_stopwords(tokens: Column) -> Column:
    """Keeps repeats: a word that occurs twice in a query counts twice."""
    stop = strings(STOPWORDS)
    return F.filter(tokens, lambda t: ~F.array_contains(stop, t))


def expand_terms(text: Column) -> Column:
    """The raw lower-case terms and the identifier tokens, each once, first occurrence first."""
    raw = F.regexp_extract_all(F.lower(text), F.lit("[a-zа-яё0-9_.-]+"), F.lit(0))
    return F.array_distinct(F.concat(raw, identifier_tokens(text)))


def translate_terms(tokens: Column, dictionary: dict[str, str] | None = None) -> Column:
    """Adds the dictionary's word for each token that has one and lacks it, after the tokens."""
    pairs = [F.lit(x) for item in ((RUSSIAN | ENGLISH) if dictionary is None else dictionary).items() for x in item]
    if not pairs:
        return tokens
    table = F.create_map(*pairs)
    return F.array_distinct(F.concat(tokens, F.filter(F.transform(tokens, lambda t: F.try_element_at(table, t)), lambda t: t.isNotNull())))


# Suffixes of the light stemmer, longest first; an approximation where no morphological dictionary is at hand.
_SUFFIXES = ("ational", "ization", "ations", "ation", "ments", "ment", "ness", "ings", "ing", "edly", "ed", "ies", "es", "ly", "s")
_SUFFIXES_RU = ("иями", "ями", "ами", "ого", "ему", "ому", "ыми", "ими", "ая", "яя", "ое", "ее", "ые", "ие", "ов", "ев", "ей", "ий", "ый", "ой", "ам", "ям", "ах", "ях", "ом", "ем", "ы", "и", "а", "я", "о", "е", "у", "ю", "ь")


def _stem_pattern(suffixes: tuple[str, ...]) -> str:
    return f"^(.{{3,}}?)(?:{'|'.join(suffixes)})$"


def normalize(token: str) -> str:
    """normalize_token for the words of a query."""
    low = token.lower()
    return low if len(low) < 5 else re.sub(_stem_pattern(_SUFFIXES_RU if re.search("[а-яё]", low) else _SUFFIXES), r"\1", low)


def normalize_token(token: Column) -> Column:
    """Lower case without inflection; approximates dictionary lemmas by taking the longest known suffix off words of five letters up."""
    low = F.lower(token)
    stemmed = F.when(low.rlike("[а-яё]"), F.regexp_replace(low, _stem_pattern(_SUFFIXES_RU), "$1")).otherwise(F.regexp_replace(low, _stem_pattern(_SUFFIXES), "$1"))
    return F.when(F.length(low) < 5, low).otherwise(stemmed)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")
