"""Porter's stemmer (1980, with its author's two later departures) as a Column expression and as SQL over a column of words.

A word is [C](VC){m}[V]: C and V are runs of consonants and vowels, a y is a vowel behind a consonant. The tests of the
published rules (m > 0, m > 1, a vowel in the stem, ends like *o) are regular expressions over that form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
M_GT_0, M_GT_1, M_EQ_1 = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$"
HAS_VOWEL, STAR_O = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"
DOUBLED = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"
STEMMED = "^[a-z0-9]{3,64}$"

# The suffixes of steps 2 to 4 of the published algorithm.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _suffixes(names) -> str:
    """The longest suffix is matched first, as a lazy stem leaves it."""
    return f"^(.+?)({'|'.join(names)})$"


def _replaced(word: Column, table: dict[str, str]) -> Column:
    pattern = _suffixes(table)
    pairs = F.create_map(*(F.lit(x) for item in table.items() for x in item))
    stem = F.regexp_extract(word, pattern, 1)
    return F.when(stem.rlike(M_GT_0), F.concat(stem, F.element_at(pairs, F.regexp_extract(word, pattern, 2)))).otherwise(word)


def _step1b(word: Column) -> Column:
    def mended(stem: Column) -> Column:
        return (
            F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e"))).when(stem.rlike(DOUBLED), F.substring(stem, F.lit(1), F.length(stem) - 1))
            .when(stem.rlike(STAR_O), F.concat(stem, F.lit("e"))).otherwise(stem)
        )

    def cut(stem: Column) -> Column:
        return F.when(stem.rlike(HAS_VOWEL), mended(stem)).otherwise(word)

    eed = F.when(F.regexp_extract(word, "^(.+?)eed$", 1).rlike(M_GT_0), F.regexp_replace(word, "eed$", "ee")).otherwise(word)
    return F.when(word.rlike("eed$"), eed).when(word.rlike(".(ed|ing)$"), _let(F.regexp_extract(word, "^(.+?)(ed|ing)$", 1), cut)).otherwise(word)


def _step4(word: Column) -> Column:
    pattern = _suffixes((*STEP4, "(?<=[st])ion"))
    stem = F.regexp_extract(word, pattern, 1)
    return F.when(stem.rlike(M_GT_1), stem).otherwise(word)


def _step5a(word: Column) -> Column:
    def cut(stem: Column) -> Column:
        return F.when(stem.rlike(M_GT_1) | (stem.rlike(M_EQ_1) & ~stem.rlike(STAR_O)), stem).otherwise(word)

    return F.when(word.rlike(".e$"), _let(F.regexp_extract(word, "^(.+)e$", 1), cut)).otherwise(word)


def porter(word: Column) -> Column:
    """The stem of a lower-case word of 3 to 64 letters a-z and digits; any other word stays as it is."""
    steps: list[Callable[[Column], Column]] = [
        lambda w: F.when(w.rlike("(ss|i)es$"), F.regexp_replace(w, "es$", "")).when(w.rlike("[^s]s$"), F.regexp_replace(w, "s$", "")).otherwise(w),
        _step1b,
        lambda w: F.when(F.regexp_extract(w, "^(.+)y$", 1).rlike(HAS_VOWEL), F.regexp_replace(w, "y$", "i")).otherwise(w),
        lambda w: _replaced(w, STEP2),
        lambda w: _replaced(w, STEP3),
        _step4,
        _step5a,
        lambda w: F.when(w.rlike(M_GT_1) & w.rlike("ll$"), F.regexp_replace(w, "l$", "")).otherwise(w),
    ]

    def run(w: Column, rest: list) -> Column:
        return w if not rest else _let(rest[0](w), lambda x: run(x, rest[1:]))

    return F.when(word.rlike(STEMMED), run(word, steps)).otherwise(word)


def porter_sql(source: str, word: str) -> str:
    """Nested SELECTs that add `stem` to the rows of a relation, in SQL whose regular expressions have no look-around."""
    def table(pairs: dict[str, str], w: str) -> str:
        cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items())
        p = _suffixes(pairs)
        return f"CASE WHEN regexp_matches(regexp_extract({w}, '{p}', 1), '{M_GT_0}') THEN regexp_extract({w}, '{p}', 1) || CASE regexp_extract({w}, '{p}', 2) {cases} END ELSE {w} END"

    ed = "regexp_extract(w1, '^(.+?)(ed|ing)$', 1)"
    steps = [
        f"CASE WHEN regexp_matches({word}, '(ss|i)es$') THEN regexp_replace({word}, 'es$', '') WHEN regexp_matches({word}, '[^s]s$') THEN regexp_replace({word}, 's$', '') ELSE {word} END",
        f"CASE WHEN regexp_matches(w1, 'eed$') THEN CASE WHEN regexp_matches(regexp_extract(w1, '^(.+?)eed$', 1), '{M_GT_0}') THEN regexp_replace(w1, 'eed$', 'ee') ELSE w1 END "
        f"WHEN regexp_matches(w1, '.(ed|ing)$') THEN CASE WHEN NOT regexp_matches({ed}, '{HAS_VOWEL}') THEN w1 WHEN regexp_matches({ed}, '(at|bl|iz)$') THEN {ed} || 'e' WHEN regexp_matches({ed}, '{DOUBLED}') THEN {ed}[:-2] WHEN regexp_matches({ed}, '{STAR_O}') THEN {ed} || 'e' ELSE {ed} END ELSE w1 END",
        f"CASE WHEN regexp_matches(regexp_extract(w2, '^(.+)y$', 1), '{HAS_VOWEL}') THEN regexp_replace(w2, 'y$', 'i') ELSE w2 END",
        table(STEP2, "w3"),
        table(STEP3, "w4"),
        f"CASE WHEN regexp_matches(w5, '[st]ion$') THEN CASE WHEN regexp_matches(w5[:-4], '{M_GT_1}') THEN w5[:-4] ELSE w5 END WHEN regexp_matches(regexp_extract(w5, '{_suffixes(STEP4)}', 1), '{M_GT_1}') THEN regexp_extract(w5, '{_suffixes(STEP4)}', 1) ELSE w5 END",
        f"CASE WHEN regexp_matches(w6, '.e$') AND (regexp_matches(w6[:-2], '{M_GT_1}') OR (regexp_matches(w6[:-2], '{M_EQ_1}') AND NOT regexp_matches(w6[:-2], '{STAR_O}'))) THEN w6[:-2] ELSE w6 END",
        f"CASE WHEN NOT regexp_matches({word}, '{STEMMED}') THEN {word} WHEN regexp_matches(w7, '{M_GT_1}') AND regexp_matches(w7, 'll$') THEN w7[:-2] ELSE w7 END",
    ]
    out = f"(SELECT * FROM {source})"
    for k, step in enumerate(steps, 1):
        out = f"(SELECT *, {step} AS {'stem' if k == len(steps) else f'w{k}'} FROM {out})"
    return out
