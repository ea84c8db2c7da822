"""Scalar text functions as Column expressions: all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a repository scan leaves out, and how a file's language is told from its name.
SKIP_DIRS = [".git", "node_modules", "vendor", ".venv", "venv", "dist", "build", "__pycache__", "target", ".next", ".nuxt", ".cache", ".idea", ".vscode"]
SKIP_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Pipfile.lock", "poetry.lock", "uv.lock", "Cargo.lock", "go.sum", "composer.lock", "Gemfile.lock"]
BINARY_SUFFIXES = [".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".pdf", ".zip", ".tar", ".gz", ".bz2", ".7z", ".exe", ".dll", ".so",
    ".dylib", ".o", ".a", ".wasm", ".ttf", ".otf", ".woff", ".woff2", ".mp3", ".mp4", ".mov", ".webm", ".ogg", ".flac", ".class", ".jar"]
MAX_FILE_BYTES, MAX_FILES = 1_048_576, 5000
LANGUAGES = {
    ".py": "Python", ".pyi": "Python", ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript",
    ".go": "Go", ".rs": "Rust", ".java": "Java", ".kt": "Kotlin", ".rb": "Ruby", ".php": "PHP", ".c": "C", ".h": "C", ".cpp": "C++", ".cc": "C++", ".hpp": "C++",
    ".cs": "C#", ".swift": "Swift", ".md": "Markdown", ".rst": "reStructuredText", ".yml": "YAML", ".yaml": "YAML", ".toml": "TOML", ".json": "JSON", ".sql": "SQL",
    ".sh": "Shell", ".bash": "Shell", ".html": "HTML", ".css": "CSS", ".scss": "SCSS",
}
# Intents by the first pattern that matches, with confidences.
INTENTS = [
    ("historical_why", r"(?i)\b(why|rationale|decision|reason|motivat|history|origin|introduce[ds]?|added|removed|changed)\b", 0.9),
    ("impact", r"(?i)\b(what\s+\w+\s+calls?|what\s+calls|who\s+(?:calls|uses|depends)|callers?\s+of|called\s+by|depends?\s+on|uses?\s+of|usage\s+of|consumers?\s+of|impact\s+of)\b", 0.85),
    ("architectural", r"(?i)\b(how\s+does|architecture|design|structure|flow|overview|interact[s]?\s+with|relationship\s+between)\b", 0.8),
    ("lookup", r"(?i)\b(where\s+is|find|locate|definition\s+of|implementation\s+of|defined\s+(in|at)|show\s+me)\b", 0.8),
]
DEFAULT_INTENT = ("lookup", 0.3)
CATEGORIES = ["lookup", "architectural", "impact", "historical_why", "out_of_scope"]
# The words that close an issue, and the form of a repository address.
CLOSING = r"(?i)\b(?:close[sd]?|fix(?:es|ed)?|resolve[sd]?)\b[\s:-]*#(\d+)"
REPO_URL = r"^https://github\.com/([A-Za-z0-9](?:[A-Za-z0-9-]{0,38})?)/([A-Za-z0-9_.\-]+?)(?:\.git)?/?$"
HOST = "https://github.com"
DOCSTRING = r"""(?sm)^\s*(?:async\s+)?(?:def|class)\s+\w+[^:]*:\s*(?:\"\"\"(.*?)\"\"\"|'''(.*?)''')"""


def strip_ws(c: Column, ends: str | None = None) -> Column:
    """All Unicode white space off both ends; Spark's trim takes spaces only. ends: these characters instead."""
    return F.btrim(c, F.lit(ends)) if ends else F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last dot and what follows, lower-cased; empty for names whose only dot leads or ends them."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def skipped(path: Column, size: Column) -> Column:
    """Whether a scan leaves out the file of a repository-relative path; an unknown size is left out."""
    return (
        F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIP_DIRS)))
        | basename(path).isin(SKIP_FILES)
        | suffix(path).isin(BINARY_SUFFIXES)
        | F.coalesce(size > MAX_FILE_BYTES, F.lit(True))
    )


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when((basename(path) == "Dockerfile") | basename(path).endswith(".dockerfile"), "Dockerfile").when(basename(path) == "Makefile", "Makefile").otherwise(F.try_element_at(table, suffix(path)))


def repo_url(url: Column) -> Column:
    """struct(owner, name), null where the address is not of a public repository."""
    u = strip_ws(url)
    return F.when(u.rlike(REPO_URL), F.struct(F.regexp_extract(u, REPO_URL, 1).alias("owner"), F.regexp_extract(u, REPO_URL, 2).alias("name")))


def split_identifier(name: Column) -> Column:
    """The name, then its parts of two characters or more by case, underscore, hyphen and space."""
    parted = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    parts = F.filter(F.split(parted, r"[\s_\-]+"), lambda p: F.length(p) >= 2)
    return F.when(F.coalesce(name, F.lit("")) == "", "").when(F.size(parts) == 0, name).otherwise(F.concat_ws(" ", name, F.array_join(parts, " ")))


def docstring(content: Column, lang: Column, ends: str | None = None) -> Column:
    """What a Python definition's docstring holds; empty for other languages, and where a colon in the signature hides it. ends: see strip_ws."""
    return F.when(lang == "Python", strip_ws(F.concat(F.regexp_extract(content, DOCSTRING, 1), F.regexp_extract(content, DOCSTRING, 2)), ends)).otherwise("")


def chunk_search_text(name: Column, parent: Column, content: Column, lang: Column, ends: str | None = None) -> dict[str, Column]:
    """The three searchable segments of a chunk. ends: see strip_ws, for the docstring."""
    blank = lambda c: F.nullif(split_identifier(F.coalesce(c, F.lit(""))), F.lit(""))
    return {"fts_name": F.concat_ws(" ", blank(parent), blank(name)), "fts_doc": docstring(content, lang, ends), "fts_body": content}


def first_line(c: Column) -> Column:
    return F.split_part(c, F.lit("\n"), F.lit(1))


def commit_title(message: Column) -> Column:
    return F.substring(first_line(message), 1, 120)


def closing_refs(*texts: Column) -> Column:
    """Distinct issue numbers that any of the texts claims to close, ascending."""
    found = F.concat(*[F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(CLOSING), F.lit(1)) for t in texts])
    numbers = F.filter(F.transform(found, lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(numbers))


def join_title_body(title: Column, body: Column, ends: str | None = None) -> Column:
    """Text to embed: both trimmed, or whichever is there. ends: see strip_ws."""
    some = lambda c: F.nullif(strip_ws(F.coalesce(c, F.lit("")), ends), F.lit(""))
    return F.concat_ws("\n\n", some(title), some(body))


def rerank_text(title: Column, body: Column) -> Column:
    """Text to rerank: untrimmed, and with the blank line even without a body."""
    return F.concat(title, F.lit("\n\n"), F.coalesce(body, F.lit("")))


def unix_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def iso_time(c: Column) -> Column:
    """Strict: a malformed time is an error."""
    return c.cast("timestamp")


def iso_time_or_null(c: Column) -> Column:
    return c.try_cast("timestamp")


def classify(question: Column) -> Column:
    """struct(category, confidence) by the first intent whose pattern is found."""
    out = F.struct(F.lit(DEFAULT_INTENT[0]).alias("category"), F.lit(DEFAULT_INTENT[1]).alias("confidence"))
    for category, pattern, confidence in reversed(INTENTS):
        out = F.when(question.rlike(pattern), F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return out


def salvage_classification(text: Column) -> Column:
    """struct(category, confidence) from a model's answer: the JSON from the first { to the last }, if it is sound; else null."""
    raw = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    got = F.from_json(raw, "category string, confidence double")
    return F.when(got["category"].isin(CATEGORIES) & got["confidence"].between(0.0, 1.0), got)


def permalink(kind: str, owner: Column, name: Column, *rest: Column) -> Column:
    """Of a chunk (ref, path, start, end), commit (sha), pr or issue (number)."""
    form = {"chunk": "%s/%s/%s/blob/%s/%s#L%s-L%s", "commit": "%s/%s/%s/commit/%s", "pr": "%s/%s/%s/pull/%s", "issue": "%s/%s/%s/issues/%s"}[kind]
    return F.format_string(form, F.lit(HOST), owner, name, *[c.cast("string") for c in rest])


def ref_of(sha: Column, branch: Column) -> Column:
    return F.coalesce(F.nullif(sha, F.lit("")), branch)


def window_since(now: Column, months: int) -> Column:
    """30 days for each month."""
    return now - F.make_dt_interval(F.lit(30 * months))


def error_text(kind: str, message: str) -> str:
    return f"{kind}: {message}"[:500]
