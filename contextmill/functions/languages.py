"""File suffixes, languages and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalars import ColumnLike, as_col

# Indexed suffixes per language.
INDEXED_SUFFIXES = {
    "python": (".py",), "javascript": (".js", ".jsx"), "typescript": (".ts",), "tsx": (".tsx",),
    "go": (".go",), "bash": (".sh",), "fish": (".fish",), "yaml": (".yaml", ".yml"),
    "hcl": (".tf", ".tfvars"),
}
PLAINTEXT_SUFFIXES = (".log", ".txt")

# Language filter names and the suffixes they admit.
FILTER_SUFFIXES = {
    ("go", "golang"): (".go",), ("python", "py"): (".py",), ("typescript", "ts"): (".ts", ".tsx"),
    ("javascript", "js"): (".js", ".jsx", ".mjs", ".cjs"), ("rust", "rs"): (".rs",),
    ("ruby", "rb"): (".rb",), ("java",): (".java",), ("bash", "sh"): (".sh",), ("fish",): (".fish",),
    ("yaml", "yml"): (".yaml", ".yml"),
    ("hcl", "terraform"): (".tf", ".tfvars"), ("plaintext",): PLAINTEXT_SUFFIXES,
}

# Labels of the analytics views.
LABELS = {".py": "Python", ".go": "Go", ".js": "JavaScript", ".jsx": "JSX", ".ts": "TypeScript",
          ".tsx": "TSX", ".sh": "Bash", ".fish": "Fish"}

# Fence names of the markdown context.
FENCES = {".go": "go", ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript",
          ".jsx": "javascript", ".rs": "rust", ".rb": "ruby", ".java": "java", ".sh": "bash",
          ".fish": "fish", ".yaml": "yaml", ".yml": "yaml"}


def suffix(path: ColumnLike) -> Column:
    """Lower-case extension with its dot, '' without one."""
    return F.regexp_extract(F.lower(as_col(path)), r"\.[^./]*$", 0)


def _lookup(key: Column, pairs: dict[str, str], default: str) -> Column:
    out = None
    for k, v in pairs.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default)


def language_of(path: ColumnLike, include_logs: bool = False) -> Column:
    """Indexed language of a path, '' when the file is not indexed."""
    pairs = {s: lang for lang, suffixes in INDEXED_SUFFIXES.items() for s in suffixes}
    if include_logs:
        pairs |= {s: "plaintext" for s in PLAINTEXT_SUFFIXES}
    return _lookup(suffix(path), pairs, "")


def language_label(path: ColumnLike) -> Column:
    return _lookup(suffix(path), LABELS, "Other")


def fence(path: ColumnLike) -> Column:
    return _lookup(suffix(path), FENCES, "")


def filter_suffixes(language: str) -> tuple[str, ...]:
    """Suffixes admitted by a language filter; none for an unknown language."""
    wanted = language.strip().lower()
    return next((s for names, s in FILTER_SUFFIXES.items() if wanted in names), ())
