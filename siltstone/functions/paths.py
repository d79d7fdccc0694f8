"""Path predicates and lookups as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders, names and endings that a scan leaves out.
IGNORED_FOLDERS = (
    ".git/", ".venv/", "venv/", "node_modules/", "__pycache__/", ".mypy_cache/", ".ruff_cache/", ".pytest_cache/", "dist/", "build/", ".next/", ".cache/", "coverage/",
    ".context/", ".playwright-mcp/", ".superpowers/", ".claude/", ".cursor/", ".github/", "docker/", "data/", "secrets/", "credentials/", "gen/", "vendor/", "generated/",
)
IGNORED_NAMES = ("credentials.json", "secrets.json", "docker-compose.yml", "docker-compose.prod.yml", "docker-compose.override.yml", "ruff.toml")
IGNORED_SUFFIXES = (".pyc", ".pyo", ".so", ".dylib", ".dll", ".log", ".DS_Store", ".min.js", ".min.css")
# Endings of test files before these extensions.
TEST_EXTENSIONS = (".py", ".go", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".rs")
# Languages by extension.
LANGUAGES = {
    ".py": "python", ".md": "markdown", ".markdown": "markdown", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml", ".ts": "typescript", ".tsx": "typescript",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift",
}
# What makes a graph node a file.
FILE_EXTENSIONS = (".py", ".md", ".yaml", ".yml", ".toml", ".txt", ".json", ".rst", ".cfg", ".ini", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".go", ".rs")
# First segments of paths that are files without a known extension.
PROJECT_ROOTS = ("src", "libs", "apps", "app", "pkg", "internal", "modules", "tests", "scripts", "docs")
# Fixed value: bytes of the largest JSON file that a scan keeps.
LARGEST_JSON = 100_000


def _any(values: tuple[str, ...]) -> str:
    return "|".join(re.escape(v) for v in values)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def relative_path(path: Column, root: str) -> Column:
    """POSIX path below a root; null for a path outside of it."""
    clean = F.regexp_replace(F.regexp_replace(path, "^file:(//)?", ""), r"\\", "/")
    prefix = re.sub("^file:(//)?", "", root).rstrip("/") + "/"
    return F.when(clean.startswith(prefix), F.substring(clean, len(prefix) + 1, 1 << 20))


def is_ignored(path: Column) -> Column:
    """One alternation: an ignored folder at the start or after a slash, an ignored name, an environment file, an ignored ending."""
    name = basename(path)
    secret = (name == ".env") | (name.startswith(".env.") & (name != ".env.example"))
    return path.rlike(f"(^|/)({_any(IGNORED_FOLDERS)})|({_any(IGNORED_SUFFIXES)})$") | name.isin(*IGNORED_NAMES) | secret


def is_test_path(path: Column) -> Column:
    p = F.regexp_replace(path, r"\\", "/")
    return p.rlike(f"(^|/)(tests|__tests__)/|(^|/)test_[^/]*$|^test_|[._]test({_any(TEST_EXTENSIONS)})$|\\.spec({_any(TEST_EXTENSIONS)})$")


def language(path: Column) -> Column:
    """By the extension; null where no language is known."""
    out = F.lit(None).cast("string")
    for extension, name in LANGUAGES.items():
        out = F.when(path.endswith(extension), name).otherwise(out)
    return out


def looks_like_file(node: Column) -> Column:
    """A known extension, or a path below a project root; never a relative or scoped import."""
    rooted = F.contains(node, F.lit("/")) & F.split(node, "/")[0].isin(*PROJECT_ROOTS)
    return ~node.rlike(r"^(\./|\.\./|@)") & (node.rlike(f"({_any(FILE_EXTENSIONS)})$") | rooted)


def role(path: Column, lang: Column) -> Column:
    """test, docs, config or source, the first that fits."""
    return F.when(is_test_path(path), "test").when(lang == "markdown", "docs").when(lang.isin("yaml", "json", "toml"), "config").otherwise("source")


def is_transient(root: Column) -> Column:
    """Scratch checkouts: temporary folders, work trees and sample projects."""
    return root.rlike(r"(^|/)(tmp|temp|\.worktrees|worktrees|fixtures|sample_repo)(/|$)|^/(private/)?(tmp|var/folders)/")


def encode_project(path: Column) -> Column:
    return F.translate(path, "._/", "---")


def decode_project(name: Column) -> Column:
    """A path again; what was a dot or an underscore comes back as a slash."""
    return F.translate(name, "-", "/")


def module_of(path: Column) -> Column:
    """The first two segments of a path with three or more, the first of two, else `.`."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 3, F.concat_ws("/", parts[0], parts[1])).when(F.size(parts) == 2, parts[0]).otherwise(".")


# Secrets that flag a file.
SECRETS = (
    "AKIA[0-9A-Z]{16}", "sk-proj-[A-Za-z0-9_-]{20,}", "sk-[A-Za-z0-9]{32,}", "sk_live_[0-9a-zA-Z]{24,}", "sk_test_[0-9a-zA-Z]{24,}", "pk_live_[0-9a-zA-Z]{24,}", "ghp_[A-Za-z0-9]{36}",
    "gho_[A-Za-z0-9]{36}", "github_pat_[A-Za-z0-9_]{22,}", "xox[baprs]-[A-Za-z0-9-]{10,}", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    "-----BEGIN (RSA|DSA|EC|OPENSSH|PRIVATE) KEY-----",
)
GENERIC_SECRET = '[Tt][Oo][Kk][Ee][Nn] = "[0-9A-Fa-f]{40}"'


def has_secret(text: Column, generic: bool = False) -> Column:
    """Whether any secret pattern occurs; generic: also a quoted 40-digit hexadecimal token."""
    return text.rlike("|".join((*SECRETS, GENERIC_SECRET) if generic else SECRETS))
