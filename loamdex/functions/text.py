"""Lexical expressions: tokens, identifiers, trigrams, routing and path rules, all as built-in Spark columns."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _accents() -> tuple[str, str]:
    """Letters with marks and the letters without, by Unicode's canonical decomposition."""
    a, b = [], []
    for cp in range(0xC0, 0x3100):
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) > 1 and not unicodedata.combining(d[0]) and all(unicodedata.combining(x) for x in d[1:]):
            a.append(chr(cp))
            b.append(d[0])
    return "".join(a), "".join(b)


def fold(c: Column | str) -> Column:
    """Lower case without accents."""
    a, b = _accents()
    return F.translate(F.lower(c), a, b)


def tokens(c: Column | str) -> Column:
    """Runs of letters and digits of the folded text, in order."""
    return F.regexp_extract_all(fold(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def identifiers(c: Column | str) -> Column:
    """Identifiers of two characters or more, in order, with repetitions."""
    return F.regexp_extract_all(F.col(c) if isinstance(c, str) else c, F.lit("([A-Za-z_][A-Za-z0-9_]+)"), F.lit(1))


def identifier_parts(token: Column) -> Column:
    """A token with its snake-case and camel-case parts of two characters or more, without repetitions."""
    snake = F.split(token, "_+")
    # A look-ahead to an underscore stands for the end of a snake part.
    camel = F.regexp_extract_all(token, F.lit("([A-Z]+(?=[A-Z][a-z]|[0-9]|_|$)|[A-Z]?[a-z]+[0-9]*|[0-9]+)"), F.lit(1))
    every = F.array_distinct(F.concat(F.array(token), snake, camel))
    return F.filter(every, lambda p: (F.length(p) >= 2) & (F.translate(p, "_", "") != ""))


def trigrams(s: Column) -> Column:
    """Distinct trigrams of the lower-cased, padded string; none for a blank one."""
    p = F.concat(F.lit("  "), F.lower(s), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3)))
    return F.when(F.trim(s) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def content_tokens(c: Column | str) -> Column:
    """Number of runs of non-space: the index's token count."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))


_IDENT = "^[A-Za-z_][A-Za-z0-9_]*$"


def route(q: Column, forced: Column | None = None) -> Column:
    """Lane of a query: a forced lane, else ``fast`` for regex queries, identifiers, and fewer than four words that
    are all identifiers, else ``full``."""
    t = F.trim(q)
    tail = F.trim(F.regexp_extract(t, r"(?i)^(?:find |where is )(.*)$", 1))
    words = F.split(t, r"\s+")
    lane = (
        F.when(t == "", "full").when(F.startswith(F.lower(t), F.lit("regex:")), "fast").when((tail != "") & tail.rlike(_IDENT), "fast").when(t.rlike(_IDENT), "fast")
        .when((F.size(words) < 4) & F.forall(words, lambda w: w.rlike(_IDENT)), "fast").otherwise("full")
    )
    return lane if forced is None else F.when(forced.isin("fast", "full"), forced).otherwise(lane)


def is_url(spec: Column) -> Column:
    """Whether a source is fetched, not read in place."""
    return spec.rlike("^(?:https?://|git@|ssh://|git://)")


def repo_name(spec: Column) -> Column:
    """Last path segment without slashes and ``.git``, then what follows the last colon."""
    last = F.element_at(F.split(F.regexp_replace(spec, "/+$", ""), "/"), -1)
    return F.element_at(F.split(F.regexp_replace(last, r"\.git$", ""), ":"), -1)


def last_symbol(q: Column) -> Column:
    """The last word without the punctuation around it."""
    return F.regexp_replace(F.element_at(F.split(F.trim(q), r"\s+"), -1), r"^[`.,:;()\[\]{}<>!?\"']+|[`.,:;()\[\]{}<>!?\"']+$", "")


def preview(c: Column | str) -> Column:
    return F.when(F.length(c) > 200, F.concat(F.substring(c, 1, 200), F.lit("..."))).otherwise(F.col(c) if isinstance(c, str) else c)


def like_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def common_prefix(a: Column, b: Column) -> Column:
    """Number of equal leading parts of two paths."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same))


# Path rules of the category classifier.
VENDOR_DIRS = ["node_modules", "vendor", "third_party", "bower_components", "site-packages", ".venv", "venv", ".yarn", "pods", ".pnp"]
META_DIRS = [".claude", ".claude-plugin", ".codex", ".codex-plugin", ".cursor", ".gemini", ".kiro", ".agents", ".codebuddy"]
META_NAMES = ["claude.md", "agents.md", "gemini.md", ".cursorrules"]
TEST_DIRS = ["test", "tests", "__tests__", "e2e", "fixtures", "testdata"]
DOC_DIRS = ["docs", "doc", "documentation", "examples", "example", "samples", "specs"]
DOC_EXTS = [".md", ".markdown", ".rst", ".txt", ".adoc"]
CONFIG_NAMES = [
    "package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "tsconfig.json", "jsconfig.json", "dockerfile", "docker-compose.yml", "docker-compose.yaml", "makefile",
    "cargo.toml", "cargo.lock", "go.mod", "go.sum", "pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "pipfile", "gemfile", "build.gradle", "pom.xml", ".gitignore",
    ".prettierrc", ".prettierignore", ".editorconfig",
]
CONFIG_EXTS = [".toml", ".ini", ".cfg", ".lock", ".yaml", ".yml", ".json"]
# Languages by extension and by whole file name.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".go": "go",
    ".rs": "rust", ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".cxx": "cpp", ".cc": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".rb": "ruby", ".cs": "csharp",
    ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".php": "php", ".lua": "lua", ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".ps1": "powershell",
    ".sql": "sql", ".html": "html", ".htm": "html", ".css": "css", ".scss": "scss", ".vue": "vue", ".md": "markdown", ".markdown": "markdown", ".rst": "rst", ".json": "json",
    ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".xml": "xml",
}
SPECIAL = {"Makefile": "makefile", "makefile": "makefile", "Dockerfile": "dockerfile", "BUILD": "bazel", "WORKSPACE": "bazel"}


def category(path: Column) -> Column:
    """Category of a path by ordered rules on its lower-cased parts: vendor, meta, test, docs, config, source."""
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    ext = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)
    among = lambda names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    has = lambda s: F.contains(name, F.lit(s))
    return (
        F.when(among(VENDOR_DIRS), "vendor").when(among(META_DIRS) | name.isin(META_NAMES), "meta").when(among(TEST_DIRS), "test")
        .when(has(".test.") | has(".spec.") | F.startswith(name, F.lit("test_")), "test").when(among(DOC_DIRS), "docs")
        .when(name.isin(CONFIG_NAMES) | ext.isin(CONFIG_EXTS), "config").when(name.rlike(r"\.config(?:\.[^.]+)?$") & (ext != "") & ~name.rlike(r"\.config$"), "config")
        .when(ext.isin(DOC_EXTS), "docs").when(has(".example") | has(".sample"), "docs").otherwise("source")
    )


def language(path: Column) -> Column:
    """Language by whole file name, else by lower-cased extension, else text."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(pairs(SPECIAL)[name], pairs(LANGUAGES)[ext], F.lit("text"))
