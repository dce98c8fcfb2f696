"""Context capsule: hybrid search over symbols, packed into a token budget per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import relative_path, token_estimate
from ..operators import fusion, knn, lexical, packing
from ..session import MAX_PINNED_ROWS, pin_small

# Defaults of the capsule request.
CAPSULE_LIMIT = 30
CAPSULE_BUDGET = 4000
SIMILARITY_TYPE = "decimal(10,9)"


def symbol_text() -> Column:
    return F.concat_ws(" ", "name", "fqn", "code")


def symbol_key() -> Column:
    """Identity of a hit in fusion; overloads in one file share it and add up."""
    return F.concat_ws("|", "file", "name", "kind")


def pinned_hits(hits: DataFrame, rows: DataFrame, requests: DataFrame, per_request: int, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(hits, rows): the hits of a counted number of requests go to the scan of the rows they name, of which only those
    remain, so that no text is shuffled to meet them. Hits of more requests are joined by shuffle, and not found twice."""
    if requests.count() * per_request > MAX_PINNED_ROWS:
        return hits, rows
    hits = pin_small(hits)
    return hits, rows.join(hits.select(key), key, "left_semi")


def hybrid_candidates(symbols: DataFrame, vectors: DataFrame, requests: DataFrame, limit: int,
                      dims: int, fallback: bool = False, text_hits: DataFrame | None = None) -> DataFrame:
    """Keyed candidates (query_id, id, key, score, rank, leg) of the text and the vector leg.

    symbols: id, name, kind, file, fqn, code. vectors: vec_id (= symbol id), embedding.
    requests: query_id, text, vector. text_hits (query_id, doc_id, score, rank) come from a stored index; without them the
    symbols are searched themselves. With fallback, the text leg of a request without any prefix hit is the symbols
    that contain one of its terms; only such requests are looked up that way.
    """
    text = lexical.bm25_search(symbols, requests, "id", symbol_text()) if text_hits is None else text_hits
    if fallback:
        text = pin_small(text)
        unanswered = requests.join(text.select("query_id").distinct(), "query_id", "left_anti")
        inside = lexical.substring_search(symbols, unanswered, "id", F.col("name"), [F.col("name"), F.col("fqn"), F.col("code")])
        text = text.unionByName(inside)
    text = text.withColumnRenamed("doc_id", "id")
    near = knn.knn(vectors, requests, 2 * limit, dims)
    vector = near.withColumnRenamed("vec_id", "id").withColumnRenamed("similarity", "score")
    found, named = pinned_hits(fusion.legs(text, vector), symbols, requests, lexical.CANDIDATES + 2 * limit)
    return found.join(named.select("id", symbol_key().alias("key")), "id")


def hybrid_search(symbols: DataFrame, vectors: DataFrame, requests: DataFrame, limit: int,
                  dims: int, fallback: bool = False, text_hits: DataFrame | None = None) -> DataFrame:
    """(query_id, key, id, leg, similarity, score, rank): the fused ranking per request."""
    return fusion.hybrid(hybrid_candidates(symbols, vectors, requests, limit, dims, fallback, text_hits), limit)


def prepare_hits(ranked: DataFrame, symbols: DataFrame, requests: DataFrame, returned: DataFrame,
                 summaries: DataFrame) -> DataFrame:
    """Ranked ids joined with what packing needs. requests adds session_id, mode, token_budget, root.

    Of what was returned before and of the summaries, only rows about the files of few hits leave their scans.
    """
    ranked, symbols = pinned_hits(ranked, symbols, requests, CAPSULE_LIMIT)
    wide = symbols.select("id", "name", "kind", "file", "project_path", "start_line", "end_line",
                          "code", "source", "skeleton")
    hits = (ranked.join(wide, "id")
            .join(requests.select("query_id", "session_id", "mode", "token_budget", "root"), "query_id"))
    sent = returned.select("session_id", "file", "name", "start_line").distinct()
    files, sent = pinned_hits(hits.select("file").distinct(), sent, requests, CAPSULE_LIMIT, "file")
    _, summaries = pinned_hits(files, summaries, requests, CAPSULE_LIMIT, "file")
    hits = packing.attach_summaries(packing.mark_returned(hits, pin_small(sent)), summaries)
    return hits.withColumn("out_file", relative_path("file", "root"))


def capsule(symbols: DataFrame, vectors: DataFrame, requests: DataFrame, returned: DataFrame,
            summaries: DataFrame, limit: int = CAPSULE_LIMIT, dims: int = 768, fallback: bool = False,
            text_hits: DataFrame | None = None) -> DataFrame:
    """One row per considered hit with representation, payload and size (see packing.pack).

    Fusion always sees the candidates of CAPSULE_LIMIT hits, so a smaller limit only cuts the ranking.
    """
    requests = pin_small(requests)
    ranked = hybrid_search(symbols, vectors, requests, max(limit, CAPSULE_LIMIT), dims, fallback, text_hits).where(F.col("rank") <= limit)
    hits = prepare_hits(ranked, symbols, requests, returned, summaries)
    # a hit known from the vector leg only carries its similarity and content hash in the row
    number = F.col("similarity").cast(SIMILARITY_TYPE).cast("string")
    extra = F.octet_length(F.concat(F.lit(',"content_hash":"' + "0" * 32 + '","similarity":'), number))
    hits = hits.withColumn("extra_bytes", F.when(F.col("leg") == 1, extra).otherwise(0))
    return packing.pack(hits)


def file_tokens(files: DataFrame) -> DataFrame:
    """(file, file_tokens) from whole files (file, source)."""
    return files.select("file", token_estimate("source").alias("file_tokens"))
