"""Source text with the contents of strings, comments and here-documents blanked out.

A text is cut into tokens by one pattern per language: a literal or comment, a run of other characters, or one
character that opens nothing. Literals become blanks of the same length and keep their line ends, so lines of the result
are those of the source, and so are columns but on lines that begin inside a literal: those get a form feed in front.
Brackets and words that are left belong to code.

Not told apart: expressions inside a template are its text up to the next quote; a backslash escapes the next character
outside of strings, too.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_LINE = r"//[^\n]*+"
_BLOCK = r"/\*[\s\S]*?\*/"
_DOUBLE, _SINGLE = r'"[^"\n]*+"', r"'[^'\n]*+'"
_LONG_DOUBLE, _LONG_SINGLE, _BACK = r'"[^"]*+"', r"'[^']*+'", r"`[^`]*+`"
_HERE = r"""<<[-~]?[ \t]*(["']?)([A-Za-z_]\w*)\1[^\n]*+\n[\s\S]*?(?m:^[ \t]*\2$)"""
_HASH, _SHELL_HASH = r"#[^\n]*+", r"(?<![^\s;])#[^\n]*+"
_REGEX = r"(?<=(?:[(,=:!&|?;]|return)\s{0,3})/(?![/*])[^/\n]+/"

LITERALS: dict[str, tuple[str, ...]] = {
    "go": (_LINE, _BLOCK, _DOUBLE, _SINGLE, _BACK),
    "javascript": (_LINE, _BLOCK, _DOUBLE, _SINGLE, _BACK, _REGEX),
    "python": (_HASH, r'"""[\s\S]*?"""', r"'''[\s\S]*?'''", _DOUBLE, _SINGLE),
    "bash": (_SHELL_HASH, _HERE, _LONG_DOUBLE, _LONG_SINGLE),
    "hcl": (_HASH, _LINE, _BLOCK, _HERE, _DOUBLE),
}
LITERALS["typescript"] = LITERALS["tsx"] = LITERALS["javascript"]
_OPENERS = "\"'`#/<"
INSIDE = "\f"


def _tokens(text: Column, language: str) -> Column:
    pattern = "|".join([*LITERALS[language], f"[^{_OPENERS}]++", r"[\s\S]"])
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def code_only(text: Column, language: Column) -> Column:
    """text with everything blanked that is not code; null for a language without rules."""
    def blank(token: Column) -> Column:
        return F.replace(F.regexp_replace(token, r"[^\n]", " "), F.lit("\n"), F.lit("\n" + INSIDE))

    out = None
    for name in LITERALS:
        tokens = _tokens(F.regexp_replace(text, r"\\[^\n]", "  "), name)
        kept = F.transform(tokens, lambda t: F.when(
            (F.length(t) > 1) & F.substring(t, 1, 1).isin(*_OPENERS), blank(t)).otherwise(t))
        joined = F.array_join(kept, "")
        out = F.when(language == name, joined) if out is None else out.when(language == name, joined)
    return out


def balance(code: Column, opening: str = "([{", closing: str = ")]}") -> Column:
    """Brackets opened minus brackets closed."""
    return F.length(F.translate(code, closing, "")) - F.length(F.translate(code, opening, ""))
