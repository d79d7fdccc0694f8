"""Symbols and relations of languages with braces: one scanner, a table of rules for each language.

The scanner blanks comments and strings out, walks the text once with a stack of scopes, and reads a header at every
opening brace and at every end of a statement. A header that fits a rule makes a symbol, whose scope lasts to its closing
brace. It is no compiler: macros, templates and headers that depend on types are read by their shape.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .code import PARSED, markdown_headings, parse_python
from .stores import validity

_COMMENT = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|$)"
_STRING = r'"""(?:[^"]|"(?!""))*(?:"""|$)|"(?:[^"\\\n]|\\.)*"?|`[^`]*`?'
_QUOTE = r"|'(?:[^'\\\n]|\\.)*'?"
_CHAR = r"|'(?:[^'\\\n]|\\.)'"


@dataclass
class Language:
    """blocks: (kind, pattern) for headers before a brace; lines: for whole statements; members: kinds inside a class.

    The first group of a pattern is the name. heritage finds what a class takes from others, imports what a file uses;
    newline: a statement ends with its line.
    """

    blocks: list[tuple[str, str]]
    lines: list[tuple[str, str]]
    imports: list[str]
    heritage: list[str] = field(default_factory=list)
    members: dict[str, str] = field(default_factory=dict)
    method: str | None = None
    quotes: str = _CHAR
    newline: bool = True


_NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "function", "match", "when", "guard", "else", "do", "try", "new", "await", "super", "this", "self"}
_MODIFIERS = r"(?:(?:public|private|protected|internal|open|final|abstract|static|override|async|suspend|inline|sealed|data|inner|companion|mutating|required|convenience|export|default|declare|readonly|synchronized|native|fileprivate|operator|infix|lateinit|const|weak|lazy|get|set)\s+)*"

LANGUAGES = {
    "typescript": Language(
        blocks=[("class", r"\b(?:class|interface|enum)\s+([A-Za-z_$][\w$]*)"), ("function", r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)"), ("function", r"\b(?:const|let)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*(?::\s*[^=]+)?=>\s*$")],
        lines=[("constant", r"\bconst\s+([A-Z][A-Z0-9_]*)\b\s*[:=]"), ("class", r"\btype\s+([A-Za-z_$][\w$]*)\s*(?:<[^=]*>)?\s*=")],
        imports=[r"""\bimport\s+(?:[^'"();]*?\sfrom\s+)?['"]([^'"\n]+)['"]""", r"""\bexport\s+[^'"();]*?\sfrom\s+['"]([^'"\n]+)['"]""", r"""\brequire\(\s*['"]([^'"\n]+)['"]\s*\)"""],
        heritage=[r"\bextends\s+([\w$.]+(?:\s*<[^{]*?>)?(?:\s*,\s*[\w$.]+)*)", r"\bimplements\s+([\w$.<>, ]+)"],
        method=rf"^{_MODIFIERS}(?:\*\s*)?([A-Za-z_$#][\w$]*)\s*(?:<[^()]*>)?\([^{{}}]*\)\s*(?::[^{{}}]*)?$", quotes=_QUOTE,
    ),
    "go": Language(
        blocks=[("method", r"\bfunc\s+\([^)]*\)\s*(\w+)"), ("function", r"\bfunc\s+(\w+)"), ("class", r"\btype\s+(\w+)\b[^=]*\b(?:struct|interface)\s*$")],
        lines=[("class", r"^type\s+(\w+)\s+\S"), ("constant", r"^const\s+(\w+)\b")],
        imports=[r'\bimport\s+(?:[\w.]+\s+)?"([^"\n]+)"', r'(?m)^\s+(?:[\w.]+\s+)?"([^"\n]+)"\s*$'],
    ),
    "rust": Language(
        blocks=[("class", r"\b(?:struct|enum|trait|union)\s+(\w+)"), ("function", r"\bfn\s+(\w+)"), ("module", r"\bmod\s+(\w+)\s*$"), ("impl", r"\bimpl\b(?:<[^>]*>)?\s+(?:[\w:<>,' ]+\s+for\s+)?(\w+)")],
        lines=[("function", r"\bfn\s+(\w+)"), ("constant", r"\b(?:const|static)\s+(?:mut\s+)?(\w+)\s*:"), ("class", r"\bstruct\s+(\w+)"), ("module", r"\bmod\s+(\w+)\s*$")],
        imports=[r"\buse\s+(\w+(?:::\w+)*(?:::\{[^}]*\}|::\*)?)"], members={"function": "method"}, newline=False, heritage=[r"\btrait\s+\w+\s*:\s*([\w:+ ]+)"],
    ),
    "java": Language(
        blocks=[("class", r"\b(?:class|interface|enum|record)\s+(\w+)")], lines=[("variable", rf"^(?:@\w+(?:\([^)]*\))?\s+)*{_MODIFIERS}(?:[\w.]+(?:<[^=;]*>)?(?:\[\])*)\s+(\w+)\s*(?:=|$)")],
        imports=[r"\bimport\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;"], heritage=[r"\bextends\s+([\w.<>, ]+?)(?=\bimplements\b|$)", r"\bimplements\s+([\w.<>, ]+)"],
        method=rf"^(?:@\w+(?:\([^)]*\))?\s+)*{_MODIFIERS}(?:<[^>]*>\s+)?(?:[\w.]+(?:<[^()]*>)?(?:\[\])*\s+)?(\w+)\s*\([^{{}}]*\)\s*(?:throws\s+[\w., ]+)?$", newline=False,
    ),
    "kotlin": Language(
        blocks=[("class", r"\b(?:class|interface|object)\s+(\w+)"), ("function", r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?(\w+)\s*\(")],
        lines=[("class", r"\b(?:class|interface|object)\s+(\w+)"), ("function", r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?(\w+)\s*\("), ("variable", rf"^{_MODIFIERS}(?:val|var)\s+(\w+)")],
        imports=[r"(?m)^\s*import\s+([\w.]+(?:\.\*)?)"], heritage=[r"\b(?:class|object|interface)\s+\w+(?:<[^>]*>)?\s*(?:\([^{}]*?\))?\s*:\s*([^{]+)$"], members={"function": "method"},
    ),
    "swift": Language(
        blocks=[("class", r"\b(?:class|struct|enum|protocol|extension|actor)\s+(?!func\b|var\b|let\b)(\w+)"), ("function", r"\bfunc\s+(\w+)"), ("method", r"\b(init|deinit)\b\??\s*(?:\([^{}]*\)\s*)?(?:throws\s*)?$")],
        lines=[("function", r"\bfunc\s+(\w+)"), ("variable", rf"^(?:@\w+\s+)*{_MODIFIERS}(?:let|var)\s+(\w+)")],
        imports=[r"(?m)^\s*(?:@\w+\s+)?import\s+(?:\w+\s+)?([\w.]+)\s*$"], heritage=[r"\b(?:class|struct|enum|protocol|extension|actor)\s+\w+(?:<[^>]*>)?\s*:\s*([^{]+)$"], members={"function": "method"},
    ),
}
LANGUAGES["javascript"] = LANGUAGES["typescript"]


def _blank(text: str, pattern: str) -> str:
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _names(clause: str) -> list[str]:
    """The types of a list such as `A<X>, b.C()` without their arguments."""
    flat = clause
    while (shorter := re.sub(r"<[^<>]*>|\([^()]*\)", "", flat)) != flat:
        flat = shorter
    return [m[0] for part in re.split(r"[,+&]", flat) if (m := re.match(r"[\w$.:]+", part.strip()))]


class Scanner:
    """rows: tuples as PARSED has them."""

    def __init__(self, path: str, text: str, name: str) -> None:
        self.path, self.rules = path, LANGUAGES[name]
        self.rows: list[tuple] = []
        self.module = re.sub(r"\.[^./]+$", "", path).replace("/", ".")
        self.told = self._without_comments(text)
        self.code = _blank(self.told, _STRING + self.rules.quotes)

    def _without_comments(self, text: str) -> str:
        """Comments made blank, strings kept."""
        return re.sub(f"(?P<s>{_STRING}{self.rules.quotes})|(?:{_COMMENT})", lambda m: m[0] if m["s"] else re.sub(r"[^\n]", " ", m[0]), text)

    def relate(self, src: str, target: str, relation: str, confidence: float = 1.0) -> None:
        self.rows.append(("relation", self.path, None, src, None, None, None, None, target, relation, confidence))

    def scan(self) -> list[tuple]:
        for pattern in self.rules.imports:
            for m in re.finditer(pattern, self.told):
                self.relate(self.path, re.sub(r"\s+", "", m[1]), "imports")
        stack: list[dict] = []
        bodies: list[tuple[str, str, int, int]] = []
        begin, line, parens = 0, 1, 0
        for at, c in enumerate(self.code):
            if c == "\n":
                line += 1
                if self.rules.newline and not parens and self.statement(begin, at, stack, line - 1):
                    begin = at + 1
            elif c in "([":
                parens += 1
            elif c in ")]":
                parens = max(0, parens - 1)
            elif c == "{" and (not parens or self.code[begin:at].count("(") == self.code[begin:at].count(")")):
                stack.append(self.block(begin, at, stack, line) | {"at": at + 1, "parens": parens})
                begin, parens = at + 1, 0
            elif c == "{":  # an object or closure among arguments
                stack.append({"kind": None, "name": None, "at": at + 1, "parens": parens, "inner": True})
            elif c == "}" and stack:
                self.statement(begin, at, stack, line)
                scope = stack.pop()
                if scope.get("fq"):
                    self.rows[scope["row"]] = (*self.rows[scope["row"]][:6], line, *self.rows[scope["row"]][7:])
                    bodies.append((scope["fq"], scope["kind"], scope["at"], at))
                parens = scope["parens"]
                if not scope.get("inner"):
                    begin = at + 1
            elif c == ";" and not parens:
                self.statement(begin, at, stack, line)
                begin = at + 1
        self.statement(begin, len(self.code), stack, line)
        self.calls(bodies)
        return self.rows

    def header(self, begin: int, end: int) -> tuple[str, int]:
        raw = self.code[begin:end]
        return " ".join(raw.split()), len(raw) - len(raw.lstrip())

    def symbol(self, name: str, kind: str, stack: list[dict], line: int, begin: int, text_end: int) -> dict:
        outer = next((s for s in reversed(stack) if s["kind"] in ("class", "impl", "module")), None)
        inside = outer is not None and outer["kind"] in ("class", "impl")
        kind = self.rules.members.get(kind, kind) if inside else kind
        parent = outer["fq"] if outer else None
        fq = f"{parent or self.module}.{name}"
        lead = len(self.code[begin:text_end]) - len(self.code[begin:text_end].lstrip())
        start = self.code.count("\n", 0, begin + lead) + 1
        self.rows.append(("symbol", self.path, name, fq, kind, start, line, parent, None, None, None))
        row = len(self.rows) - 1
        self.relate(self.path, fq, "defines")
        return {"kind": kind, "name": name, "fq": fq, "row": row}

    def _within(self, stack: list[dict]) -> str | None:
        return stack[-1]["kind"] if stack else "file"

    def block(self, begin: int, at: int, stack: list[dict], line: int) -> dict:
        text, _ = self.header(begin, at)
        place = self._within(stack)
        if place in ("file", "class", "impl", "module"):
            for kind, pattern in self.rules.blocks:
                if m := re.search(pattern, text):
                    if kind == "impl":
                        return {"kind": "impl", "name": m[1], "fq": f"{self.module}.{m[1]}", "row": self._none()}
                    made = self.symbol(m[1], kind, stack, line, begin, at)
                    if made["kind"] == "class":
                        for target in (n for h in self.rules.heritage for x in re.finditer(h, text) for n in _names(x[1])):
                            self.relate(made["fq"], target, "inherits")
                    return made
            if place == "class" and self.rules.method and (m := re.search(self.rules.method, text)) and m[1] not in _NOT_CALLS:
                return self.symbol(m[1], "method", stack, line, begin, at)
        return {"kind": None, "name": None}

    def _none(self) -> int:
        """A place for the end line of a scope that is no symbol."""
        self.rows.append(("scope", self.path, *[None] * 9))
        return len(self.rows) - 1

    def statement(self, begin: int, end: int, stack: list[dict], line: int) -> bool:
        """Whether the text is a declaration of its own; it is entered then."""
        text, _ = self.header(begin, end)
        if not text or self._within(stack) not in ("file", "class", "impl", "module"):
            return not text
        for kind, pattern in self.rules.lines:
            if (kind != "variable" or self._within(stack) == "class") and (m := re.search(pattern, text)) and m[1] not in _NOT_CALLS and not re.match(r"(?:import|package|return|throw|use)\b", text):
                made = self.symbol(m[1], kind, stack, line, begin, end)
                if made["kind"] == "class":
                    for target in (n for h in self.rules.heritage for x in re.finditer(h, text) for n in _names(x[1])):
                        self.relate(made["fq"], target, "inherits")
                return True
        if self._within(stack) == "class" and self.rules.method and not self.rules.newline and (m := re.search(self.rules.method, text)) and m[1] not in _NOT_CALLS:
            self.symbol(m[1], "method", stack, line, begin, end)
            return True
        return bool(re.match(r"(?:import|package|use|@\w+$|#)", text))

    def calls(self, bodies: list[tuple[str, str, int, int]]) -> None:
        """Calls of functions of the same file, from the innermost function that holds them."""
        own = {r[2]: r[3] for r in self.rows if r[0] == "symbol" and r[4] in ("function", "method", "class")}
        functions = sorted((b for b in bodies if b[1] in ("function", "method")), key=lambda b: b[3] - b[2])
        seen = set()
        for m in re.finditer(r"([A-Za-z_$][\w$]*)\s*\(", self.code):
            target = own.get(m[1])
            holder = next((b for b in functions if b[2] <= m.start() < b[3]), None)
            if target and holder and holder[0] != target and (holder[0], target) not in seen:
                seen.add((holder[0], target))
                self.relate(holder[0], target, "same_file_calls", 0.8)


def parse(path: str, text: str, language: str) -> list[tuple]:
    return [r for r in Scanner(path, text or "", language).scan() if r[0] != "scope"]


def parse_sources(files: DataFrame) -> DataFrame:
    """Tagged rows (symbol, relation, error) of files (path, text, language) in the languages of LANGUAGES."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in PARSED.split(", ")]
        for batch in batches:
            rows = []
            for path, text, language in zip(batch["path"], batch["text"], batch["language"]):
                try:
                    rows += parse(path, text, language)
                except RecursionError as error:
                    rows.append(("error", path, str(error), *[None] * 8))
            yield pd.DataFrame(rows, columns=columns).astype({"start_line": "Int32", "end_line": "Int32", "confidence": "float64"})

    return files.where(files["language"].isin(*LANGUAGES)).select("path", "text", "language").mapInPandas(run, PARSED)


def parse_files(files: DataFrame) -> DataFrame:
    """Tagged rows of all files (path, text, language) that a parser is known for: Python by its own grammar, languages
    with braces by the scanner, the headings of Markdown, and errors of settings files."""
    headings = markdown_headings(files).select(F.lit("symbol").alias("kind"), "file_path", F.col("title").alias("name"), "fq_name", F.lit("module").alias("symbol_type"), F.col("start_line").cast("int").alias("start_line"), F.col("start_line").cast("int").alias("end_line"))
    broken = validity(files).where("error is not null").select(F.lit("error").alias("kind"), F.col("path").alias("file_path"), F.col("error").alias("name"))
    out = parse_python(files).unionByName(parse_sources(files))
    return out.unionByName(headings, allowMissingColumns=True).unionByName(broken, allowMissingColumns=True)
