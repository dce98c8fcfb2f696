"""Documentation sources: bodies by URL, chunked by type."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import ColumnLike, as_col, is_stale
from ..operators import chunking

Fetch = Callable[[str], str]


def document_type(value: ColumnLike, render_js: bool = False) -> Column:
    """markdown, html or json; rendered pages are fetched as plain html, anything unknown is markdown."""
    t = F.lower(F.trim(as_col(value)))
    return (F.when(t.isin("html", "webpage") | F.lit(render_js), "html").when(t.isin("json", "api"), "json")
            .otherwise("markdown"))


def http_get(url: str) -> str:
    """Body of an http or https URL; others are refused, so that sources cannot name local files."""
    from urllib.request import urlopen
    if not url.lower().startswith(("http://", "https://")):
        raise ValueError(f"not a web address: {url}")
    with urlopen(url, timeout=30) as response:
        return response.read().decode("utf-8", "replace")


def fetch_bodies(sources: DataFrame, fetch: Fetch = http_get) -> DataFrame:
    """sources (id, type, url) with body; fetched in the tasks, one request per row. A failed fetch
    leaves the body null."""
    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = []
            for url in batch["url"]:
                try:
                    bodies.append(fetch(url))
                except (OSError, ValueError):
                    bodies.append(None)
            yield batch.assign(body=bodies)

    return sources.select("id", "type", "url").mapInPandas(get, "id string, type string, url string, body string")


def due(sources: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """Sources never fetched or older than seven days."""
    return sources if force else sources.where(is_stale(F.col("last_updated").cast("string"), now))


def chunk_bodies(bodies: DataFrame) -> DataFrame:
    """(chunk_id, source_id, title, content, path, content_hash) from (id, type, url, body)."""
    placed = bodies.where("body IS NOT NULL").select(
        F.col("id").alias("source_id"), document_type("type").alias("type"), chunking.url_path("url").alias("path"), "body")
    keep = ["source_id", "path"]
    marked = chunking.explode_chunks(placed.where("type = 'markdown'"), chunking.markdown_sections("body", "path"), keep)
    pages = chunking.explode_chunks(placed.where("type = 'html'"), chunking.page_sections("body", "path"), keep)
    objects = chunking.json_sections(placed.where("type = 'json'").select(*keep, "body"), "body", "path")
    section = F.array(F.struct("title", "content"))
    json = chunking.explode_chunks(objects.select(*keep, "position", "title", "content"), section, [*keep, "position"])
    json = json.withColumn("section_no", F.col("position") + 1).drop("position")
    out = marked.unionByName(pages).unionByName(json)
    key = F.concat_ws(":", F.lit("doc"), "source_id", F.col("section_no").cast("string"), F.col("part_no").cast("string"))
    return out.select(key.alias("chunk_id"), "source_id", "title", "content", "path", F.sha2("content", 256).alias("content_hash"))
