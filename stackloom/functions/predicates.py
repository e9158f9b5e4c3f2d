"""Row predicates over frames, paths and names, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Paths that are no user code.
RUNTIME_PATHS = ["/_profiler.cpython", "/_profiler.abi3", "_profiler.so", "<frozen ", "<built-in"]
LIBRARY_PATHS = ["/lib/python3.", "/site-packages/"]

# Directories that never hold project sources, and those that seldom do.
IGNORED_DIRS = [
    ".git", ".hg", ".svn",
    "node_modules", "bower_components", "vendor", "dist", ".next", ".nuxt", "out", ".cache", ".turbo", "coverage", ".nyc_output",
    "__pycache__", ".venv", "venv", "env", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".nox", "site-packages",
    "target", "build", ".gradle",
    ".idea", ".vscode", ".DS_Store",
]
ASSET_DIRS = ["static", "assets"]
BUNDLE_EXTENSIONS = ["js", "mjs", "cjs", "ts", "css", "json", "html"]
BUNDLE_BYTES, BUNDLE_SAMPLE, BUNDLE_LINE, BUNDLE_BLANK = 256 * 1024, 64 * 1024, 500, 0.10

# What marks a test directory or file name.
TEST_PATTERNS = [
    r"^[Tt]est[A-Z]",
    r"(?:^|[a-z0-9])(?:Tests?|Specs?|Mocks?)$",
    r"(?i)(?:^|[^a-z0-9])(?:tests?|specs?|mocks?|testdata)(?:[^a-z0-9]|$)",
]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(text: Column, patterns: list[str]) -> Column:
    """Some non-empty pattern occurs; false for null and empty text."""
    return F.coalesce(any_of([F.contains(text, F.lit(p)) for p in patterns if p]), F.lit(False))


def is_system_path(file: Column, more: list[str] | None = None) -> Column:
    return contains_any(file, [*RUNTIME_PATHS, *LIBRARY_PATHS, *(more or [])])


def leaf_excluded(frames: Column, patterns: list[str]) -> Column:
    """The leaf (first) frame's file contains a pattern; a trace without frames is kept."""
    return contains_any(F.try_element_at(frames, F.lit(1))["file"], patterns)


def is_internal_thread(name: Column, prefix: str) -> Column:
    return F.coalesce(F.startswith(name, F.lit(prefix)), F.lit(False))


def frame_filter(text: str, name: Column, file: Column) -> Column:
    """Compile a filter such as ``name:load !file:test cache`` to a predicate.

    Terms are split at white space; ``!`` negates; ``name:`` and ``file:`` bind a
    term to one field, other terms may occur in either. All positive terms and no
    negative one must occur, as substrings with case. An empty filter passes all.
    """
    there = F.coalesce(file, F.lit(""))
    passed = F.lit(True)
    for token in text.split():
        negated = token.startswith("!")
        term = token[1:] if negated else token
        scope, colon, rest = term.partition(":")
        bound = bool(colon) and scope in ("name", "file")
        term = rest if bound else term
        if not term:
            continue
        in_name, in_file = F.contains(name, F.lit(term)), F.contains(there, F.lit(term))
        found = in_name if bound and scope == "name" else in_file if bound else in_name | in_file
        passed = passed & (~found if negated else found)
    return passed


def in_ignored_dir(path: Column, dirs: list[str] | None = None) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in dirs or IGNORED_DIRS]))


def in_asset_dir(path: Column) -> Column:
    return in_ignored_dir(path, ASSET_DIRS)


def _looks_like_test(token: Column) -> Column:
    return any_of([token.rlike(p) for p in TEST_PATTERNS])


def is_test_path(path: Column) -> Column:
    """A directory, or the file name without its extension, looks like a test's. ``path`` is relative to the root."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return F.exists(dirs, _looks_like_test) | _looks_like_test(stem)


def is_minified(path: Column, size: Column, head: Column) -> Column:
    """A large script or data file whose first 64 KiB have very long lines and hardly a blank. ``head`` is text."""
    sample = F.left(head, F.lit(BUNDLE_SAMPLE))
    n = F.length(sample)
    lines = F.greatest(n - F.length(F.replace(sample, F.lit("\n"), F.lit(""))), F.lit(1))
    blanks = n - F.length(F.regexp_replace(sample, r"[ \t\n\r]", ""))
    extension = F.lower(F.substring_index(path, ".", -1)).isin(BUNDLE_EXTENSIONS)
    return extension & (size >= BUNDLE_BYTES) & (n > 0) & (F.floor(n / lines) >= BUNDLE_LINE) & (blanks < BUNDLE_BLANK * n)


def is_accessor(name: Column) -> Column:
    return name.rlike("^(get|set|is)[A-Z]") & (F.length(name) >= 4)


def is_private(name: Column) -> Column:
    return F.startswith(name, F.lit("_"))


def is_synthetic(name: Column) -> Column:
    return F.startswith(name, F.lit("<"))


def is_method_call(name: Column) -> Column:
    """Not a constructor: the first character is no ASCII capital."""
    return ~name.rlike("^[A-Z]")


def in_ranges(ranges: Column, offset: Column) -> Column:
    return F.coalesce(F.exists(ranges, lambda r: (offset >= r["s"]) & (offset <= r["e"])), F.lit(False))
