"""Cutting documents into titled sections and bounded chunks. Every step is row-local."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalars import ColumnLike, as_col, trim_space

# Chunk size in bytes and the patterns of the HTML cleaner.
MAX_CHUNK_BYTES = 2000
SCRIPT = r"(?is)<script[^>]*>.*?</script>"
STYLE = r"(?is)<style[^>]*>.*?</style>"
HEADING = r"(?is)<h([1-4])[^>]*>(.*?)</h([1-4])>"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
TAG = r"<[^>]+>"
BLANK_LINE = r"\n\s*\n"

SECTION = "array<struct<title:string,content:string>>"
CHUNK = "array<struct<content:string,numbered:boolean>>"


# --- HTML --------------------------------------------------------------------------------------

def drop_code(html: ColumnLike) -> Column:
    """HTML without scripts and style sheets."""
    return F.regexp_replace(F.regexp_replace(as_col(html), SCRIPT, " "), STYLE, " ")


def markup_text(html: ColumnLike) -> Column:
    """Tags to blanks, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(as_col(html), TAG, " "), r"\s+", " "))


def html_text(html: ColumnLike) -> Column:
    return markup_text(drop_code(html))


def html_title(html: ColumnLike) -> Column:
    return markup_text(F.regexp_extract(as_col(html), TITLE, 1))


def html_sections(html: ColumnLike) -> Column:
    """Sections headed by h1 to h4, titled '<text> (h<level>)'. A heading closed by another level and
    a section without title or text are left out."""
    clean, pattern = drop_code(html), F.lit(HEADING)
    opened, title, closed = (F.regexp_extract_all(clean, pattern, F.lit(g)) for g in (1, 2, 3))
    bodies = F.slice(F.split(clean, HEADING, -1), F.lit(2), F.greatest(F.size(opened), F.lit(1)))
    rows = F.arrays_zip(opened.alias("o"), title.alias("t"), closed.alias("c"), bodies.alias("b"))
    kept = F.filter(rows, lambda r: (r["o"] == r["c"]) & (markup_text(r["t"]) != "") & (markup_text(r["b"]) != ""))
    return F.transform(kept, lambda r: F.struct(
        F.concat(markup_text(r["t"]), F.lit(" (h"), r["o"], F.lit(")")).alias("title"),
        markup_text(r["b"]).alias("content")))


def page_sections(html: ColumnLike, path: ColumnLike) -> Column:
    """Headed sections, or the whole page under its title (its path when it has none)."""
    sections = html_sections(html)
    clean = drop_code(html)
    title = F.when(F.rlike(clean, F.lit(TITLE)), html_title(clean)).otherwise(as_col(path))
    whole = F.array(F.struct(title.alias("title"), markup_text(clean).alias("content")))
    return F.when(F.size(sections) > 0, sections).otherwise(whole)


# --- Markdown ----------------------------------------------------------------------------------

def markdown_sections(text: ColumnLike, path: ColumnLike) -> Column:
    """Sections at '#' and '##'; deeper headings stay in the text. What precedes the first heading,
    or a document without headings, becomes a section titled with the path."""
    mark, end = "\uE000", "\uE001"
    marked = F.regexp_replace(as_col(text), r"(?m)^[ \t\r\f\x0B]*#{1,2} +(\S.*)$", f"{mark}$1{end}")
    parts = F.split(marked, mark)
    head = F.array(F.struct(as_col(path).alias("title"), trim_space(F.get(parts, F.lit(0))).alias("content")))
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(1))), lambda s: F.struct(
        trim_space(F.get(F.split(s, end), F.lit(0))).alias("title"),
        trim_space(F.get(F.split(s, end), F.lit(1))).alias("content")))
    return F.filter(F.concat(head, rest), lambda s: s["content"] != "")


# --- JSON --------------------------------------------------------------------------------------

@F.pandas_udf(T.StringType())
def indented_json(text: pd.Series) -> pd.Series:
    """JSON text with two blanks of indentation and sorted keys."""
    return text.map(lambda t: None if t is None else
                    json.dumps(json.loads(t), indent=2, sort_keys=True, ensure_ascii=False))


def json_sections(df: DataFrame, raw: str, path: str) -> DataFrame:
    """Adds position, title, content: an object gives one section per key in key order, an array one
    section with a line per item, anything else one section with the raw text."""
    parsed = df.withColumn("__v", F.try_parse_json(raw))
    shape = F.coalesce(F.schema_of_variant("__v"), F.lit(""))
    entries = F.map_entries(F.variant_get("__v", "$", "map<string,variant>"))
    keyed = F.array_sort(F.transform(entries, lambda e: F.struct(
        e["key"].alias("title"), F.to_json(e["value"]).alias("content"))))
    items = F.variant_get("__v", "$", "array<variant>")
    listed = F.array_join(F.transform(items, lambda i: F.to_json(i)), "\n")
    is_object = F.startswith(shape, F.lit("OBJECT")) & (F.size(entries) > 0)
    is_list = F.startswith(shape, F.lit("ARRAY"))
    single = F.array(F.struct(F.col(path).alias("title"), F.when(is_list, listed).otherwise(F.trim(raw)).alias("content")))
    sections = F.when(is_object, keyed).otherwise(single)
    out = parsed.select("*", is_object.alias("__o"), F.posexplode(sections).alias("position", "__s"))
    out = out.withColumn("title", F.col("__s.title"))
    nested = F.col("__o") & F.rlike(F.col("__s.content"), F.lit(r"^\s*[\[{]"))
    return (out.withColumn("content", F.when(nested, indented_json(F.when(nested, F.col("__s.content")))).otherwise(F.col("__s.content")))
            .where("content <> ''").drop("__v", "__o", "__s"))


# --- bounded chunks ----------------------------------------------------------------------------

def _boundary(raw: Column, n: Column, at: Column) -> Column:
    """Byte offset `at`, moved back to the start of the UTF-8 character it would split."""
    def inside(offset: Column) -> Column:
        return F.hex(F.substr(raw, offset + 1, F.lit(1))).between("80", "BF")

    return (F.when(at >= n, n).when(~inside(at), at).when(~inside(at - 1), at - 1)
            .when(~inside(at - 2), at - 2).otherwise(at - 3))


def hard_cuts(text: Column, size: int = MAX_CHUNK_BYTES) -> Column:
    """Pieces cut every `size` bytes, never inside a character; all but the last are followed by more."""
    raw, n = text.cast("binary"), F.octet_length(text)
    last = F.floor((n - 1) / size).cast("int")

    def piece(i: Column) -> Column:
        first, stop = _boundary(raw, n, i * size), _boundary(raw, n, (i + 1) * size)
        return F.struct(F.substr(raw, first + 1, stop - first).cast("string").alias("content"), (i < last).alias("numbered"))

    return F.transform(F.sequence(F.lit(0), last), piece)


def split_long(title: Column, content: Column, size: int = MAX_CHUNK_BYTES) -> Column:
    """Chunks of about `size` bytes at most: whole paragraphs packed together, an oversize paragraph cut
    hard. Titles carry ' (part n)' from the second chunk on, and on the first piece of a hard cut."""
    text = trim_space(content)
    paragraphs = F.filter(F.transform(F.split(text, BLANK_LINE), trim_space), lambda p: p != "")
    none = F.array().cast(CHUNK)

    def packed(buffer: Column) -> Column:
        piece = F.array(F.struct(trim_space(buffer).alias("content"), F.lit(False).alias("numbered")))
        return F.when(buffer == "", none).otherwise(piece)

    def step(acc: Column, p: Column) -> Column:
        n, oversize = F.octet_length(p), F.octet_length(p) > size
        flush = oversize | (F.octet_length(acc["buffer"]) + n + 2 > size)
        done = F.when(flush, F.concat(acc["done"], packed(acc["buffer"]))).otherwise(acc["done"])
        joined = F.when(flush | (acc["buffer"] == ""), p).otherwise(F.concat(acc["buffer"], F.lit("\n\n"), p))
        return F.struct(F.when(oversize, F.lit("")).otherwise(joined).alias("buffer"),
                        F.when(oversize, F.concat(done, hard_cuts(p, size))).otherwise(done).alias("done"))

    start = F.struct(F.lit("").alias("buffer"), none.alias("done"))
    folded = F.aggregate(paragraphs, start, step, lambda acc: F.concat(acc["done"], packed(acc["buffer"])))
    small = F.array(F.struct(text.alias("content"), F.lit(False).alias("numbered")))
    pieces = F.when(text == "", none).when(F.octet_length(text) <= size, small).otherwise(folded)
    name = trim_space(title)
    return F.transform(pieces, lambda c, i: F.struct(
        F.when((i > 0) | c["numbered"], F.concat(name, F.lit(" (part "), (i + 1).cast("string"), F.lit(")")))
        .otherwise(name).alias("title"), c["content"].alias("content")))


def explode_chunks(df: DataFrame, sections: Column, keep: list[str]) -> DataFrame:
    """One row per chunk with section_no and part_no (from 1), title, content."""
    placed = df.select(*keep, F.posexplode(sections).alias("__i", "__s"))
    pieces = placed.select(*keep, (F.col("__i") + 1).alias("section_no"),
                           F.posexplode(split_long(F.col("__s.title"), F.col("__s.content"))).alias("__j", "__c"))
    return pieces.select(*keep, "section_no", (F.col("__j") + 1).alias("part_no"),
                         F.col("__c.title").alias("title"), F.col("__c.content").alias("content"))


def url_path(url: ColumnLike) -> Column:
    return F.regexp_extract(as_col(url), r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)


def page_chunks(pages: DataFrame) -> DataFrame:
    """Chunks of web pages: chunk_id, page_id, path, section_no, part_no, title, content."""
    placed = pages.select("page_id", url_path("url").alias("path"), "html")
    chunks = explode_chunks(placed, page_sections("html", "path"), ["page_id", "path"])
    key = F.concat_ws("#", *[F.col(c).cast("string") for c in ("page_id", "section_no", "part_no")])
    return chunks.withColumn("chunk_id", key)
