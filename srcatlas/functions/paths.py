"""Column functions over repository paths and URLs.

All are plain Catalyst expressions, so they stay inside whole-stage codegen and are
evaluated where the rows already are (no shuffle, no Python).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical file selection.
# ---------------------------------------------------------------------------
SKIP_DIRS = ("node_modules", "__pycache__", ".git", ".github", "venv", "env", ".venv", "dist",
             "build", ".next", ".nuxt", "coverage", ".pytest_cache", "migrations", "static",
             "assets", "public", "vendor")
SKIP_SUFFIXES = (".min.js", ".min.css", ".lock", ".map", "_pb2.py", ".generated.ts")
SKIP_FILENAMES = ("package-lock.json", "yarn.lock", "poetry.lock", "Pipfile.lock", "setup.py",
                  "conftest.py")
TEST_PREFIXES = ("test_",)
TEST_SUFFIXES = ("_test.py", ".test.js", ".test.ts", ".spec.js", ".spec.ts")
EXTENSION_LANGUAGE = {".py": "python", ".js": "javascript", ".ts": "typescript",
                      ".jsx": "javascript", ".tsx": "typescript"}
MAX_FILE_BYTES = 50_000
REPO_URL_PATTERN = r"(?U)^https?://github\.com/[\w\-.]+/[\w\-.]+/?$"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_path(path) -> Column:
    """Backslashes become forward slashes."""
    return F.translate(_c(path), "\\", "/")


def file_name(path) -> Column:
    """Last path segment."""
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def in_skipped_dir(path) -> Column:
    """Some directory segment is a skip name or starts with a dot (case-sensitive)."""
    parts = F.split(_c(path), "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    skip = F.array(*[F.lit(d) for d in SKIP_DIRS])
    return F.exists(dirs, lambda s: F.array_contains(skip, s) | s.startswith("."))


def is_skipped_name(path) -> Column:
    """Exact file-name skip list."""
    return file_name(path).isin(*SKIP_FILENAMES)


def is_test_file(path) -> Column:
    """Test-file predicate on the lower-cased file name."""
    n = F.lower(file_name(path))
    cond = F.lit(False)
    for p in TEST_PREFIXES:
        cond = cond | n.startswith(p)
    for s in TEST_SUFFIXES:
        cond = cond | n.endswith(s)
    return cond


def has_skipped_suffix(path) -> Column:
    """generated/minified suffixes (case-sensitive)."""
    n = file_name(path)
    cond = F.lit(False)
    for s in SKIP_SUFFIXES:
        cond = cond | n.endswith(s)
    return cond


def extension(path) -> Column:
    """Last extension with leading dots of the name ignored ('.py' has none)."""
    return F.regexp_extract(file_name(path), r"^\.*[^.].*(\.[^.]*)$", 1)


def language_of(path) -> Column:
    """P5: language by extension; NULL when unsupported."""
    m = F.create_map(*[F.lit(x) for kv in EXTENSION_LANGUAGE.items() for x in kv])
    return F.try_element_at(m, extension(path))


def size_ok(size) -> Column:
    """Non-empty and at most 50,000 bytes."""
    return _c(size).between(1, MAX_FILE_BYTES)


def is_blank(text) -> Column:
    """Only whitespace (Python's ``str.strip`` set)."""
    return ~_c(text).rlike(r"[^\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _clean_url(url) -> Column:
    u = F.regexp_replace(_c(url), "/+$", "")
    return F.regexp_replace(u, r"\.git$", "")


def is_repo_url(url) -> Column:
    """P10: repository URL validation."""
    return _clean_url(url).rlike(REPO_URL_PATTERN)


def repo_of_url(url) -> Column:
    """Repository name = last path segment after stripping '/' and '.git'."""
    return F.element_at(F.split(_clean_url(url), "/"), -1)


def owner_of_url(url) -> Column:
    """owner = second-to-last segment."""
    parts = F.split(F.regexp_replace(_clean_url(url), "/+$", ""), "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2))


def metadata_id(repo) -> Column:
    """md5 hex of the UTF-8 repository name."""
    return F.md5(F.encode(_c(repo), "UTF-8"))
