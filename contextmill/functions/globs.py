"""Path patterns as regular expressions evaluated by Spark."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from .scalars import ColumnLike, as_col, basename

# Default ignore patterns.
DEFAULT_IGNORES = (
    "**/node_modules/**", "**/vendor/**", "**/bower_components/**", "**/Pods/**", "**/third_party/**",
    "**/__pycache__/**", "**/site-packages/**", "**/venv/**", "**/.venv/**", "**/env/**", "**/dist/**",
    "**/build/**", "**/out/**", "**/target/**", "**/coverage/**", "**/tmp/**", "**/.astcache/**",
    "**/*.pb.go", "**/*.min.js", "**/*.min.css",
)

# Directory names never walked (besides dot directories).
SKIPPED_DIRECTORIES = (
    "node_modules", "vendor", "venv", "env", "__pycache__", "dist", "build", ".astcache", "target",
    "bower_components", "third_party", "site-packages", "coverage", "tmp", "pkg", "Pods",
)


def _segment(glob: str) -> str:
    """One-segment wildcards: * and ? stop at '/', [..] is a character class."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in glob[i + 1:]:
            end = glob.index("]", i + 1)
            out.append("[" + glob[i + 1:end] + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of an ignore pattern.

    '**/x/**' and '**/x' match x as whole segments anywhere (x literally), 'x/**' and a plain path
    match x and what lies below it, and any other wildcard pattern matches a suffix of whole segments.
    """
    literal = re.escape
    if pattern.startswith("**/"):
        inner = pattern[3:].removesuffix("/**")
        return ".*" if not inner else f"(.*/)?{literal(inner)}(/.*)?"
    if pattern.endswith("/**"):
        prefix = pattern[:-3]
        return ".*" if not prefix else f"{literal(prefix)}(/.*)?"
    if not re.search(r"[*?\[]", pattern):
        return f"{literal(pattern)}(/.*)?"
    return f"(.*/)?{_segment(pattern)}"


def any_glob(path: ColumnLike, patterns: Iterable[str]) -> Column:
    """The relative path matches any pattern; paths outside the root ('../') never do."""
    parts = [glob_regex(p) for p in patterns if p]
    if not parts:
        return F.lit(False)
    p = as_col(path)
    return ~F.startswith(p, F.lit("../")) & F.rlike(p, F.lit("^(?:" + "|".join(parts) + ")$"))


def excluded_project(path: ColumnLike, patterns: Iterable[str]) -> Column:
    """Project exclusion: 'basename:x', a literal path with everything below, or a glob."""
    p, hit, globs = as_col(path), F.lit(False), []
    for pattern in (q.strip() for q in patterns):
        if not pattern:
            continue
        if pattern.startswith("basename:"):
            hit = hit | (basename(p) == pattern.removeprefix("basename:"))
        elif not re.search(r"[*?\[]", pattern):
            hit = hit | (p == pattern) | F.startswith(p, F.lit(pattern.rstrip("/") + "/"))
        else:
            globs.append(pattern)
    relative = F.regexp_replace(p, "^/", "")
    return hit | any_glob(p, globs) | any_glob(relative, [g.lstrip("/") for g in globs])


def walkable(relative: ColumnLike, skipped: Iterable[str] = SKIPPED_DIRECTORIES) -> Column:
    """No directory on the way to the file is a dot directory or in the skip set."""
    names = "|".join(re.escape(n) for n in skipped)
    return ~F.rlike(as_col(relative), F.lit(rf"(^|/)(\.[^/]*|{names})/"))
