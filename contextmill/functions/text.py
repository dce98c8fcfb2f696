"""Tokenising of documents and queries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalars import ColumnLike, as_col

TOKEN_SEPARATOR = r"[^\p{L}\p{N}]+"


def tokens(text: ColumnLike) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(as_col(text)), TOKEN_SEPARATOR), "")


def spaced_tokens(text: ColumnLike) -> Column:
    """tokens(text) in one string, between blanks; blanks may also begin or end it."""
    return F.regexp_replace(F.lower(as_col(text)), TOKEN_SEPARATOR, " ")


def query_terms(query: ColumnLike) -> Column:
    """Lower-case blank-separated terms of a query, punctuation kept."""
    return F.array_remove(F.split(F.lower(as_col(query)), r"\s+"), "")


def prefix_terms(query: ColumnLike) -> Column:
    """Query terms reduced to ASCII letters, digits and underscore: the prefixes to search for."""
    stripped = F.transform(query_terms(query), lambda t: F.regexp_replace(t, r"[^A-Za-z0-9_]", ""))
    return F.array_remove(stripped, "")


def lines(text: ColumnLike) -> Column:
    return F.split(as_col(text), "\n")


def line_range(text: ColumnLike, first: ColumnLike, last: ColumnLike) -> Column:
    """Lines first..last (1-based, inclusive), '' when the range does not lie inside the text."""
    ls, a, b = lines(text), as_col(first), as_col(last)
    inside = (a >= 1) & (b <= F.size(ls)) & (a <= b)
    return F.when(inside, F.array_join(F.slice(ls, a, b - a + 1), "\n")).otherwise(F.lit(""))
