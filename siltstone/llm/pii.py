"""Personal data: high-recall candidates scored by boosted trees, in DataFrame expressions only.

Base spans come from four fixed patterns with validators and always count. Wider generators propose further spans of
the same kinds (obfuscated addresses, national phone numbers, grouped or short card numbers, defanged address quads) and of
keys and passwords (kind secret), which may overlap. Each candidate gets small integer features of its format, of the text
before it and of its document; gradient boosted trees score it and a threshold for its kind selects it, unless it overlaps
a base span or a selected span of an earlier kind.

The trees learn what the base patterns do not decide. Labels come from the table's own base spans, rewritten: a phone
number in its national forms, an address with its signs spelt out, a card number in other groups or a digit shorter (with
its check digit put right), a quad in brackets are positives, plain and behind a telling word; a card number with a wrong
check digit, a quad with a part over 255, a number behind an order or serial word, and plain words with a number instead of
keys are negatives, as is every candidate of the texts that no base span touches (for secrets: of no known format). Candidates
are counted by feature vector in the cluster; features take few values, so only those counts, a few thousand rows at most,
reach the driver. Documents of one fold in FOLDS are kept from the trees; on them the threshold of each kind is
set to the lowest score from which on the share of positives is PRECISION or more, and half way down to the next. The ensemble becomes a Column
expression, so scoring needs no Python on executors.

Format limits of the generators: local parts up to 64 and domain labels up to 63 characters, at most 8 dots, card numbers
of 13 to 19 digits, keys of 16 characters at least. Base spans know no such limits.

Patterns match in linear time on long runs: possessive repeats, and a match may start only where a run starts or where
the previous match ended. Defined results: null texts are empty; rows with null or repeated doc_id are handled like any
other; an empty table gives no rows (and no trees); offsets count code points, ends are exclusive; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold before the pattern of a kind is worth trying.
_HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Kinds with generators: the base kinds, and secrets, which have no base pattern.
ALL_KINDS = (*KINDS, "secret")
_AT, _DOT = r"(?:@|\(at\)|\[at\])", r"(?:\.|\(dot\)|\[dot\])"
_KEY = "[A-Za-z0-9+/_-]"
GENERATORS = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+ ?{_AT} ?[A-Za-z0-9-]{{1,63}}+(?: ?{_DOT} ?[A-Za-z0-9-]{{1,63}}+){{1,8}}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ .-]?[0-9]){12,18}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+?[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "secret": rf"(?<!{_KEY})(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z]){_KEY}{{16,}}+",
}
_GENERATOR_HINT = {"email": r"@|\(at\)|\[at\]", "ip": r"[0-9]\[?\.\]?[0-9]", "card": "[0-9]", "phone": r"[0-9][ .-][0-9]{4}", "secret": "[0-9]"}
#: Formats of keys whose meaning is public, and what stands before a written-out password or token.
KNOWN_SECRET = r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[0-9A-Za-z]{36}$|^xox[abprs]-[0-9A-Za-z-]{10,}$"
SECRET_BEFORE = r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key) ?[=:] ?[\x22']?$"
#: Words in the 24 characters before a candidate, most telling first.
CONTEXT = (SECRET_BEFORE, r"(?i)phone|tel\b|call|fax|mobile|whatsapp", r"(?i)card|visa|credit|payment", r"(?i)\bip\b|host|server|address", r"(?i)mail|contact|write to", r"(?i)order|ref\b|\bid\b|isbn|sku|serial|version")
FEATURES = ("kind", "digits", "separators", "lead", "before", "context", "check", "company")

ROUNDS, DEPTH, SHRINKAGE, PENALTY = 24, 3, 0.4, 4.0
PRECISION, LEAST_SUPPORT, FOLDS = 0.97, 20, 5
_SPAN = "array<struct<s:int,e:int,m:string>>"


RUN = 256  # matches whose offsets are summed in one go


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def find_all(text: Column, pattern: str) -> Column:
    """All matches of a pattern with their offsets: the parts between them are what split() leaves.

    Appending to an array copies it, so offsets are summed run by run: first where each run begins, then within it.
    """
    parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(parts, hits, lambda a, b: F.struct(F.length(a).alias("gap"), b.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + F.length(x["m"])
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out")))

    def spans(pairs: Column) -> Column:
        runs = F.sequence(F.lit(0), ((F.size(pairs) - 1) / RUN).cast("int"))
        own = lambda j: F.slice(pairs, j * RUN + 1, F.lit(RUN))
        length = lambda j: F.aggregate(own(j), F.lit(0), lambda total, x: total + x["gap"] + F.coalesce(F.length(x["m"]), F.lit(0)))
        begins = F.aggregate(F.transform(runs, length), F.array(F.lit(0)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))
        within = lambda at: lambda j: F.aggregate(own(j), F.struct(F.element_at(at, j + 1).alias("at"), F.array().cast(_SPAN).alias("out")), step, lambda acc: acc["out"])
        return _let(begins, lambda at: F.flatten(F.transform(runs, within(at))))

    return F.when(text.isNotNull(), _let(both, spans))


def _none() -> Column:
    return F.array().cast(_SPAN)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(back, i, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """The validators of the base patterns."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        plain = lambda part: F.regexp_replace(part, "^0+(?=.)", "")
        return F.forall(F.split(m, r"\."), lambda part: (F.length(plain(part)) <= 3) & (F.substring(plain(part), 1, 3).try_cast("int") <= 255))
    n = F.length(digits_of(m))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits_of(m))).otherwise(False)
    return n.between(8, 15)


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(find_all(text, BASE[kind]), lambda x: valid(kind, x["m"]))
    hint = F.contains(text, F.lit(_HINT[kind])) if _HINT[kind] else text.rlike("[0-9][0-9 -]{14,}[0-9]")
    return F.when(hint, found).otherwise(_none())


def _separators(m: Column) -> Column:
    """0 none, 1 blanks, 2 hyphens, 3 dots, 4 several, 5 brackets."""
    kinds = F.length(F.concat(*(F.when(F.contains(m, F.lit(c)), F.lit(c)).otherwise("") for c in " -.")))
    return F.when(m.rlike(r"[\[(](?:at|dot)|\[\."), 5).when(kinds == 0, 0).when(kinds > 1, 4).when(F.contains(m, F.lit(" ")), 1).when(F.contains(m, F.lit("-")), 2).otherwise(3)


def _check(kind: str, m: Column) -> Column:
    """Whether the digits are such as the kind can have: the check digit of a card, the parts of a quad, the format of a key."""
    if kind == "card":
        return luhn(digits_of(m))
    if kind == "ip":
        return valid("ip", F.regexp_replace(m, r"[\[\]]", ""))
    return m.rlike(KNOWN_SECRET) if kind == "secret" else F.lit(True)


def features(kind: str, text: Column, x: Column, company: Column) -> Column:
    """Small integers that describe a candidate, the characters before it, and how many base spans the document has."""
    m, first = x["m"], F.substring(x["m"], 1, 1)
    before = F.when(x["s"] == 0, F.lit(" ")).otherwise(F.substring(text, x["s"], F.lit(1)))
    ahead = F.substring(text, F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24)))
    context = F.lit(0)
    for k in range(len(CONTEXT), 0, -1):
        context = F.when(ahead.rlike(CONTEXT[k - 1]), k).otherwise(context)
    mix = F.when(m.rlike("^[0-9]+$"), 0).when(m.rlike("^[0-9a-f]+$"), 1).when(m.rlike("^[0-9A-Z]+$"), 2).when(m.rlike("^[0-9A-Za-z]+$"), 3).otherwise(4)
    size = F.least(F.length(digits_of(m)), F.lit(24)) if kind != "secret" else F.least(F.floor(F.length(m) / 8), F.lit(8)).cast("int")
    return F.struct(
        F.lit(ALL_KINDS.index(kind)).alias("kind"),
        (F.lit(0) if kind == "email" else size).alias("digits"),
        (mix if kind == "secret" else _separators(m)).alias("separators"),
        F.when(first == "+", 0).when(first == "(", 1).when(first.between("3", "6"), 2).when(first.between("0", "9"), 3).otherwise(4).alias("lead"),
        F.when(before.rlike(r"[\s|]"), 0).when(before.rlike(r"[\w@]"), 2).otherwise(1).alias("before"),
        context.alias("context"),
        _check(kind, m).cast("int").alias("check"),
        F.least(company, F.lit(3)).alias("company"),
    )


def candidates(text: Column, kind: str, company: Column) -> Column:
    """Proposed spans of a kind with features f."""
    found = F.transform(find_all(text, GENERATORS[kind]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), features(kind, text, x, company).alias("f")))
    none = F.array().cast("array<struct<s:int,e:int,f:struct<" + ",".join(f"{n}:int" for n in FEATURES) + ">>>")
    return F.when(text.rlike(_GENERATOR_HINT[kind]), found).otherwise(none)


# --- labels -------------------------------------------------------------------------------------------------------


def _with_check_digit(digits: Column) -> Column:
    back = F.reverse(F.concat(digits, F.lit("0")))

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(back, i, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add)
    return F.concat(digits, ((10 - total % 10) % 10).cast("string"))


def _forms(kind: str, m: Column) -> list[tuple[Column, bool, str]]:
    """(rewritten span, whether it is personal data, the words put before it) for a base span of a kind."""
    d = digits_of(m)
    cut = lambda x, a, n: F.substring(x, F.lit(a), F.lit(n))
    if kind == "email":
        spelt = [F.replace(F.replace(m, F.lit("@"), F.lit(at)), F.lit("."), F.lit(dot)) for at, dot in ((" (at) ", " (dot) "), ("[at]", "[dot]"))]
        return [(x, True, words) for x in [*spelt, F.replace(m, F.lit("@"), F.lit(" @ "))] for words in ("", "mail ")]
    if kind == "phone":
        ten = F.substring(d, F.length(d) - 9, F.lit(10))
        parts = cut(ten, 1, 3), cut(ten, 4, 3), cut(ten, 7, 4)
        shapes = [F.concat(F.lit("("), parts[0], F.lit(") "), parts[1], F.lit("-"), parts[2]), F.concat_ws("-", *parts), F.concat_ws(".", *parts), F.concat_ws(" ", *parts)]
        return [(x, words not in ("order ", "serial no. "), words) for x in shapes for words in ("", "call ", "order ", "serial no. ")]
    if kind == "card":
        sixteen, fifteen = cut(d, 1, 16), _with_check_digit(cut(d, 1, 14))
        fours = [cut(sixteen, a, 4) for a in (1, 5, 9, 13)]
        amex = [cut(fifteen, 1, 4), cut(fifteen, 5, 6), cut(fifteen, 11, 5)]
        wrong = F.concat(cut(sixteen, 1, 15), ((F.substring(sixteen, F.lit(16), F.lit(1)).cast("int") + 1) % 10).cast("string"))
        good = [F.concat_ws(".", *fours), F.concat_ws(" ", *amex), F.concat_ws("-", *amex), fifteen]
        return [(x, True, words) for x in good for words in ("", "card ")] + [(x, False, words) for x in (wrong, F.concat_ws("-", *(cut(wrong, a, 4) for a in (1, 5, 9, 13)))) for words in ("", "order ")]
    octets = F.split(m, r"\.")
    high = F.concat_ws("[.]", octets[0], octets[1], F.lit("300"), octets[3])
    return [(F.concat_ws("[.]", octets), True, ""), (F.concat_ws("[.]", octets), True, "host "), (high, False, ""), (high, False, "version ")]


def _secret_forms(m: Column) -> list[tuple[Column, bool, str]]:
    """A key keeps its meaning without its context; a number behind plain words is none."""
    number = F.substring(F.translate(F.sha2(m.cast("binary"), 256), "abcdef", "314159"), F.lit(1), F.lit(6))
    plain = [F.concat(F.lit("invoice-2024-"), number), F.concat(F.lit("section_12/item-"), number), F.concat(F.lit("Paragraph"), number, F.lit("Annex1"))]
    return [(m, True, words) for words in ("", "key ")] + [(x, False, words) for x in plain for words in ("", "order ")]


def labelled(docs: DataFrame) -> DataFrame:
    """The features of FEATURES, y (0 or 1), fold and n: candidates of rewritten base spans, and those of the texts themselves."""
    text, total = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("total")
    rows = docs.select(text.alias("text")).withColumns({f"base_{k}": base_spans(F.col("text"), k) for k in KINDS})
    rows = rows.withColumn("total", sum((F.size(f"base_{k}") for k in KINDS), F.lit(0))).withColumn("fold", F.crc32(F.col("text").cast("binary")) % FOLDS)
    secrets = F.filter(find_all(F.col("text"), GENERATORS["secret"]), lambda x: x["m"].rlike(KNOWN_SECRET) | F.substring(F.col("text"), F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24))).rlike(SECRET_BEFORE))
    rows = rows.withColumn("base_secret", F.when(F.col("text").rlike(_GENERATOR_HINT["secret"]), secrets).otherwise(_none()))
    hit = lambda k: F.transform(F.col(f"base_{k}"), lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))
    hits = rows.where(" or ".join(f"size(base_{k}) > 0" for k in ALL_KINDS)).select("text", "fold", "total", F.explode(F.concat(*(hit(k) for k in ALL_KINDS))).alias("x"))
    around = hits.select(F.col("x.kind").alias("kind"), F.col("x.m").alias("m"), "fold", F.greatest(total - F.when(F.col("x.kind") == "secret", 0).otherwise(1), F.lit(0)).alias("total"), F.substring("text", F.greatest(F.col("x.s") - 23, F.lit(1)), F.least(F.col("x.s"), F.lit(24))).alias("ahead"), F.substring(F.col("text"), F.col("x.e") + 1, F.lit(12)).alias("after"))
    around = common.stored(around, "pii-hits")
    out = None
    for kind in ALL_KINDS:
        forms = _secret_forms(F.col("m")) if kind == "secret" else _forms(kind, F.col("m"))
        made = F.explode(F.array(*(F.struct(form.alias("form"), F.lit(int(y)).alias("y"), F.lit(words).alias("words")) for form, y, words in forms)))
        clear = F.regexp_replace("ahead", r"\S+$", "") if kind == "secret" else F.col("ahead")
        some = around.where((F.col("kind") == kind) & ((F.length(digits_of(F.col("m"))) >= 10) if kind == "phone" else F.lit(True))).select("fold", "total", clear.alias("ahead"), "after", made.alias("x"))
        front = F.concat(F.col("ahead"), F.col("x.words"))
        some = some.select("fold", "total", F.col("x.y").alias("y"), F.length(front).alias("s"), (F.length(front) + F.length("x.form")).alias("e"), F.concat(front, F.col("x.form"), F.col("after")).alias("text"))
        some = some.select("fold", "y", F.explode(F.filter(candidates(F.col("text"), kind, total), lambda x: (x["s"] < F.col("e")) & (F.col("s") < x["e"]))).alias("x"))
        counted = some.groupBy(*(F.col(f"x.f.{n}").alias(n) for n in FEATURES), "y", "fold").agg(F.count("*").alias("n"))
        out = counted if out is None else out.unionByName(counted)
    base = F.concat(*(F.transform(F.col(f"base_{k}"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in ALL_KINDS))
    own = rows.select("fold", F.explode(F.filter(F.concat(*(candidates(F.col("text"), k, total) for k in ALL_KINDS)), _clear_of(base))).alias("x"))
    own = own.groupBy(*(F.col(f"x.f.{n}").alias(n) for n in FEATURES), "fold").agg(F.count("*").alias("n"))
    return out.unionByName(own.withColumn("y", F.lit(0)))


# --- boosting on counted feature vectors --------------------------------------------------------------------------


class Ensemble:
    """Trees as nested tuples (feature, bound, at most bound, above) with leaf values, and a threshold for each kind."""

    def __init__(self, bias: float, trees: list, thresholds: dict[int, float]) -> None:
        self.bias, self.trees, self.thresholds = bias, trees, thresholds

    def score(self, f: tuple[int, ...]) -> float:
        total = self.bias
        for tree in self.trees:
            while isinstance(tree, tuple):
                tree = tree[2] if f[tree[0]] <= tree[1] else tree[3]
            total += tree
        return total

    def selected(self, kind: str, f: Column) -> Column:
        """Whether a candidate's score reaches its kind's threshold, as an expression."""
        bound = self.thresholds.get(ALL_KINDS.index(kind))
        if bound is None:
            return F.lit(False)

        own = ALL_KINDS.index(kind)

        def within(tree, low: dict[int, int], high: dict[int, int]):
            """The tree without the branches that a candidate of this kind, on this side of earlier bounds, cannot reach."""
            while isinstance(tree, tuple):
                k, bound, left, right = tree
                if high.get(k, 1 << 30) <= bound:
                    tree = left
                elif low.get(k, -1) > bound:
                    tree = right
                else:
                    a, b = within(left, low, high | {k: bound}), within(right, low | {k: bound + 1}, high)
                    return a if a == b else (k, bound, a, b)
            return tree

        def expression(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(f[FEATURES[tree[0]]] <= tree[1], expression(tree[2])).otherwise(expression(tree[3]))

        # What always holds for the kind is added up here, the rest is an expression.
        total, open_ = self.bias, []
        for tree in self.trees:
            tree = within(tree, {0: own}, {0: own})
            if isinstance(tree, tuple):
                open_.append(tree)
            else:
                total += tree
        return reduce(lambda x, tree: x + expression(tree), open_, F.lit(total)) >= bound - 1e-9


def boost(rows: list[tuple[tuple[int, ...], float, float]], held_out: list[tuple[tuple[int, ...], float, float]] | None = None) -> Ensemble:
    """Newton boosting of small trees on the logistic loss; rows: (feature vector, weight of positives, of negatives).

    The thresholds are set on the rows held out (else on the same).
    """
    if not rows:
        return Ensemble(0.0, [], {})
    positive, negative = (sum(r[k] for r in rows) + 0.5 for k in (1, 2))
    bias = math.log(positive / negative)
    scores, trees = [bias] * len(rows), []

    def grow(members: list[int], g: list[float], h: list[float], depth: int):
        total_g, total_h = sum(g[i] for i in members), sum(h[i] for i in members)
        leaf = -SHRINKAGE * total_g / (total_h + PENALTY)
        if not depth:
            return leaf
        best = (1e-6, None)
        for k in range(len(FEATURES)):
            by: dict[int, list[float]] = {}
            for i in members:
                cell = by.setdefault(rows[i][0][k], [0.0, 0.0])
                cell[0] += g[i]
                cell[1] += h[i]
            left_g = left_h = 0.0
            for value in sorted(by)[:-1]:
                left_g += by[value][0]
                left_h += by[value][1]
                right_g, right_h = total_g - left_g, total_h - left_h
                gain = left_g**2 / (left_h + PENALTY) + right_g**2 / (right_h + PENALTY) - total_g**2 / (total_h + PENALTY)
                if gain > best[0]:
                    best = (gain, (k, value))
        if best[1] is None:
            return leaf
        k, value = best[1]
        left = [i for i in members if rows[i][0][k] <= value]
        right = [i for i in members if rows[i][0][k] > value]
        return (k, value, grow(left, g, h, depth - 1), grow(right, g, h, depth - 1))

    for _ in range(ROUNDS):
        g, h = [], []
        for (_, p, n), s in zip(rows, scores):
            q = 1 / (1 + math.exp(-s))
            g.append((p + n) * q - p)
            h.append((p + n) * q * (1 - q))
        tree = grow(list(range(len(rows))), g, h, DEPTH)
        trees.append(tree)
        one = Ensemble(0.0, [tree], {})
        scores = [s + one.score(r[0]) for s, r in zip(scores, rows)]
    return calibrated(Ensemble(bias, trees, {}), rows if held_out is None else held_out)


def calibrated(model: Ensemble, rows: list[tuple[tuple[int, ...], float, float]]) -> Ensemble:
    """The model with, for each kind, the lowest threshold above which the share of positives is PRECISION or more, half way to the next score."""
    for kind in range(len(ALL_KINDS)):
        by_score: dict[float, list[float]] = {}
        for f, p, n in rows:
            if f[0] == kind:
                cell = by_score.setdefault(round(model.score(f), 9), [0.0, 0.0])
                cell[0] += p
                cell[1] += n
        good = bad = 0.0
        scores = sorted(by_score, reverse=True)
        for s, lower in zip(scores, [*scores[1:], scores[-1] - 2 if scores else 0.0]):
            good, bad = good + by_score[s][0], bad + by_score[s][1]
            if good + bad >= LEAST_SUPPORT and good >= PRECISION * (good + bad):
                model.thresholds[kind] = (s + lower) / 2
    return model


def train(docs: DataFrame) -> Ensemble:
    """Fits the trees to the candidates of all folds but one, the thresholds to that one."""
    with common.scratch(docs.sparkSession):
        counted = labelled(docs).collect()
    parts: tuple[dict, dict] = ({}, {})
    for r in counted:
        parts[r["fold"] == 0].setdefault(tuple(r[n] for n in FEATURES), [0.0, 0.0])[0 if r["y"] else 1] += r["n"]
    fitted, held = (sorted((f, p, n) for f, (p, n) in x.items()) for x in parts)
    return boost(fitted, held)


# --- spans and redaction ------------------------------------------------------------------------------------------


def _selects(model: Ensemble, kind: str) -> Callable[[Column], Column]:
    return lambda x: model.selected(kind, x["f"])


def _clear_of(spans: Column) -> Callable[[Column], Column]:
    return lambda x: ~F.exists(spans, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))


def _as_text(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string"))


def _as_tag(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"<{kind.upper()}>").alias("tag"))


def with_spans(docs: DataFrame, model: Ensemble) -> DataFrame:
    """Adds base_<kind> and all_<kind>: sorted arrays of structs (s, e); for secrets all_secret alone."""
    pair = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))
    out = docs.withColumns({f"base_{k}": F.transform(base_spans(F.col("text"), k), pair) for k in KINDS})
    out = out.withColumn("base_any", F.concat(*(F.col(f"base_{k}") for k in KINDS))).withColumn("base_secret", F.array().cast("array<struct<s:int,e:int>>"))
    for i, kind in enumerate(ALL_KINDS):
        earlier = [F.col(f"all_{k}") for k in ALL_KINDS[:i]]
        taken = F.concat(F.col("base_any"), *earlier) if earlier else F.col("base_any")
        if i in model.thresholds:
            out = out.withColumn(f"more_{kind}", F.transform(F.filter(candidates(F.col("text"), kind, F.size("base_any")), _selects(model, kind)), pair))
            free = F.filter(F.col(f"more_{kind}"), _clear_of(taken))
            out = out.withColumn(f"all_{kind}", F.array_sort(F.concat(F.col(f"base_{kind}"), free))).drop(f"more_{kind}")
        else:
            out = out.withColumn(f"all_{kind}", F.col(f"base_{kind}"))
    return out.drop("base_any", "base_secret")


def _written(spans: list[tuple[str, Column]]) -> Column:
    return F.array_join(F.concat(*(F.transform(c, _as_text(k)) for k, c in spans)), ",")


def detect(docs: DataFrame, model: Ensemble | None = None) -> DataFrame:
    """doc_id, n_<kind> and base_sha256 of the base spans, all spans as kind:start:end, the secrets, and the number of them all."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = with_spans(rows, model or train(docs))
    return found.select(
        "doc_id",
        *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_written([(k, F.col(f"base_{k}")) for k in KINDS]).cast("binary"), 256).alias("base_sha256"),
        _written([(k, F.col(f"all_{k}")) for k in KINDS]).alias("spans"),
        _written([("secret", F.col("all_secret"))]).alias("secrets"),
        sum((F.size(f"all_{k}").cast("long") for k in ALL_KINDS), F.lit(0)).alias("n_spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by <KIND>; where spans overlap, the one that starts first is named."""
    columns = docs.columns
    found = with_spans(docs.withColumn("text", F.col("text").cast("string")).withColumn("siltstone_null", F.col("text").isNull()).withColumn("text", F.coalesce("text", F.lit(""))), train(docs))
    tagged = F.array_sort(F.concat(*(F.transform(F.col(f"all_{k}"), _as_tag(k)) for k in ALL_KINDS)))
    text = F.col("text")

    def step(acc: Column, x: Column) -> Column:
        skip = F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))
        take = F.struct(x["e"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), x["tag"]).alias("out"))
        return F.when(x["s"] < acc["at"], skip).otherwise(take)

    cleaned = F.aggregate(F.col("siltstone_spans"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    out = found.withColumn("siltstone_spans", tagged).withColumn("text", F.when(F.col("siltstone_null"), F.lit(None)).when(F.size("siltstone_spans") == 0, text).otherwise(cleaned))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.size("siltstone_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*columns)
