"""Retrieval of one context text per request from symbols, document chunks and memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.languages import fence
from ..functions.scalars import blank_to_null, escape_xml, relative_path, token_estimate, tokens_saved
from ..operators import lexical, packing
from ..operators.ordered import first_per_group
from ..session import pin_small
from .capsule import hybrid_search, pinned_hits

# Defaults of the retrieve request.
RETRIEVE_LIMIT = 10
MIN_MEMORY_BUDGET, MEMORY_SHARE, MIN_REMAINING = 200, 5, 800
DOC_LIMIT = 10  # fixed value: documents asked for where half the limit is none
DOC_FALLBACK_SCORE = 0.5
EMPTY_CONTEXT = "No relevant context found."


def memory_budget(token_budget: Column) -> Column:
    return F.greatest(F.floor(token_budget / MEMORY_SHARE).cast("int"), F.lit(MIN_MEMORY_BUDGET))


def code_chunks(symbols: DataFrame, vectors: DataFrame, requests: DataFrame, returned: DataFrame,
                limit: int, include_source: bool, dims: int, fallback: bool = False,
                text_hits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, skipped): content of the best hits, and the hits the session already has."""
    ranked = hybrid_search(symbols, vectors, requests, 2 * limit, dims, fallback, text_hits)
    ranked, symbols = pinned_hits(ranked.where(F.col("rank") <= limit), symbols, requests, limit)
    wide = symbols.select("id", "name", "kind", "file", "start_line", "code", "source", "skeleton")
    hits = (ranked.join(wide, "id")
            .join(requests.select("query_id", "session_id", "mode", "root"), "query_id"))
    hits = packing.mark_returned(hits, returned)
    has_content = F.concat_ws("", "skeleton", "code", "source") != ""
    ordered = Window.partitionBy("query_id").orderBy("rank")
    kept = F.sum((has_content & ~F.col("already")).cast("int")).over(
        ordered.rowsBetween(Window.unboundedPreceding, -1))
    mode = packing.effective_mode(F.col("mode"), F.col("score"),
                                  F.max("score").over(Window.partitionBy("query_id")), F.coalesce(kept, F.lit(0)))
    full = F.lit(include_source) | (mode == "full")
    skeleton, code, source = (blank_to_null(c) for c in ("skeleton", "code", "source"))
    content = F.when(full, F.coalesce(source, code, skeleton)).otherwise(F.coalesce(skeleton, code))
    hits = hits.withColumn("content", content)
    chunks = hits.where(~F.col("already") & F.col("content").isNotNull()).select(
        "query_id", F.lit("code").alias("type"), "name", "kind", relative_path("file", "root").alias("file"),
        "score", "content", "rank", packing.full_tokens().alias("baseline"))
    skipped = hits.where("already").groupBy("query_id").agg(
        F.count("*").alias("deduped_count"), F.sum(token_estimate("content")).alias("dedup_tokens_saved"))
    return chunks, skipped


def doc_chunks_for(chunks: DataFrame, requests: DataFrame, limit: int, doc_hits: DataFrame | None = None) -> DataFrame:
    """Best document chunks per request: by the given hits (query_id, doc_id, score, rank), else by text with its raw score."""
    ranked = lexical.bm25_search(chunks, requests, "chunk_id", F.concat_ws(" ", "title", "content"), limit) if doc_hits is None else doc_hits
    ranked, wide = pinned_hits(ranked.where(F.col("rank") <= limit), chunks.withColumnRenamed("chunk_id", "doc_id"), requests, limit, "doc_id")
    rows = ranked.join(wide, "doc_id")
    score = F.when(F.col("score") > 0, F.col("score")).otherwise(F.lit(DOC_FALLBACK_SCORE))
    return rows.select("query_id", F.lit("doc").alias("type"), F.col("title").alias("name"),
                       F.lit("documentation").alias("kind"), F.col("path").alias("file"), score.alias("score"),
                       "content", "rank", token_estimate("content").alias("baseline"))


def rank_and_dedup(chunks: DataFrame) -> DataFrame:
    """First chunk per (type, file, name), ranked by score over all sources."""
    unique = first_per_group(chunks, ["query_id", "type", "file", "name"], ["rank"])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "type", "rank", "file", "name")
    return unique.withColumn("rank", F.row_number().over(w))


def chunk_text(layout: str) -> Column:
    """One chunk in the given layout; needs rank, name, type, file, kind, score, content."""
    score = F.format_string("%.3f", "score")
    if layout == "markdown":
        head = F.format_string("## %d. %s (%s)\n\n", "rank", "name", "type")
        code = F.concat(F.format_string("**File:** `%s` | **Kind:** `%s` | **Score:** %s\n\n", "file", "kind", score),
                        F.lit("```"), fence("file"), F.lit("\n"), F.col("content"), F.lit("\n```\n\n"))
        doc = F.concat(F.lit("**Source:** Documentation | **Score:** "), score, F.lit("\n\n"), F.col("content"), F.lit("\n\n"))
        return F.concat(head, F.when(F.col("type") == "code", code).otherwise(doc))
    if layout == "xml":
        return F.concat(F.lit('  <chunk type="'), F.col("type"), F.lit('" name="'), escape_xml("name"), F.lit('" file="'),
                        escape_xml("file"), F.lit('" score="'), score, F.lit('">\n    <![CDATA['), F.col("content"),
                        F.lit("]]>\n  </chunk>\n"))
    if layout == "json":
        source = F.when(F.col("type") == "code", "code").otherwise("docs")
        return F.to_json(F.struct("type", "name", "kind", "file", "score", source.alias("source"), "content"))
    return F.concat(F.lit("["), F.col("type"), F.lit("] "), F.col("name"), F.lit(" ("), F.col("file"), F.lit(")\n"),
                    F.col("content"), F.lit("\n---\n"))


def assemble(chunks: DataFrame, layout: str = "markdown") -> DataFrame:
    """(query_id, context): chunks in rank order. A request has few chunks, all within its budget."""
    before = {"markdown": "# Retrieved Context\n\n", "xml": "<context>\n", "json": "["}.get(layout, "")
    after = {"xml": "</context>\n", "json": "]"}.get(layout, "")
    between = "," if layout == "json" else ""
    rows = chunks.groupBy("query_id").agg(F.array_sort(F.collect_list(
        F.struct("rank", chunk_text(layout).alias("text")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["text"]), between)
    return rows.select("query_id", F.concat(F.lit(before), body, F.lit(after)).alias("context"))


def retrieve(symbols: DataFrame, vectors: DataFrame, docs: DataFrame, requests: DataFrame,
             returned: DataFrame, limit: int = RETRIEVE_LIMIT, dims: int = 768, include_docs: bool = True,
             include_source: bool = False, layout: str = "markdown", memory: DataFrame | None = None,
             fallback: bool = False, text_hits: DataFrame | None = None, doc_hits: DataFrame | None = None) -> DataFrame:
    """One row per request: context text and stage statistics. text_hits and doc_hits come from stored indexes.

    memory, if given, has (query_id, memory_text, memory_tokens, memory_lines); its tokens reduce the
    budget, of which MIN_REMAINING always stay.
    """
    requests = pin_small(requests)
    budgets = requests.select("query_id", "token_budget")
    if memory is not None:
        budgets = budgets.join(memory, "query_id", "left").withColumn(
            "token_budget", F.when(F.coalesce("memory_tokens", F.lit(0)) > 0, F.greatest(
                F.col("token_budget") - F.col("memory_tokens"), F.lit(MIN_REMAINING))).otherwise(F.col("token_budget")))
    else:
        budgets = budgets.select("*", F.lit(None).cast("string").alias("memory_text"),
                                 F.lit(0).alias("memory_tokens"), F.lit(0).alias("memory_lines"))
    code, skipped = code_chunks(symbols, vectors, requests, returned, limit, include_source, dims, fallback, text_hits)
    both = code
    if include_docs:
        both = code.unionByName(doc_chunks_for(docs, requests, limit // 2 or DOC_LIMIT, doc_hits))
    ranked = rank_and_dedup(both).withColumn("tokens", token_estimate("content"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = (ranked.join(budgets.select("query_id", "token_budget"), "query_id")
             .withColumn("fits", F.sum("tokens").over(w) <= F.col("token_budget")))
    zero = F.lit(0)
    stats = sized.groupBy("query_id").agg(
        F.count_if(F.col("type") == "code").alias("code_results"), F.count_if(F.col("type") == "doc").alias("doc_results"),
        F.count("*").alias("after_dedup"), F.sum("tokens").alias("tokens_est_all_chunks"),
        F.count_if("fits").alias("chunks_in_budget"),
        F.coalesce(F.sum(F.when(F.col("fits"), F.col("tokens"))), zero).alias("chunk_tokens"),
        F.coalesce(F.sum(F.when(F.col("fits"), F.col("baseline"))), zero).alias("symbol_baseline_tokens"))
    out = (budgets.join(stats, "query_id", "left").join(skipped, "query_id", "left")
           .join(assemble(sized.where("fits"), layout), "query_id", "left")
           .na.fill(0))
    preamble = F.coalesce(F.concat(F.lit("## Agent memory\n"), blank_to_null("memory_text"), F.lit("\n\n")), F.lit(""))
    used, dedup = F.col("chunk_tokens"), F.col("dedup_tokens_saved")
    return out.select(
        "query_id", F.concat(preamble, F.coalesce("context", F.lit(EMPTY_CONTEXT))).alias("context"),
        "code_results", "doc_results", "after_dedup", "chunks_in_budget", "tokens_est_all_chunks",
        (used + F.col("memory_tokens")).alias("total_tokens"), "symbol_baseline_tokens",
        "deduped_count", "dedup_tokens_saved",
        tokens_saved(used, F.col("symbol_baseline_tokens"), dedup).alias("tokens_saved"),
        F.greatest(F.col("tokens_est_all_chunks") - used, zero).alias("budget_tokens_saved"), "memory_tokens", "memory_lines")
