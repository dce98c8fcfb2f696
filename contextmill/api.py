"""The tools as one library object over a Store. Reads return DataFrames and write nothing; batches of
requests are DataFrames, the single-request methods wrap them."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions.scalars import (blank_to_null, content_hash, normalize_outcome, normalize_reason, relative_path,
                                stable_ref, token_estimate)
from .operators import backlog, entities, filters, fusion, graph, knn, lexical, memory, notes, packing, scripts, symbols as extraction, upkeep, usage
from .plans import capsule as capsule_plan, retrieve as retrieve_plan
from .sources import documents as doc_sources
from .sources.embedders import Embedder, HashingEmbedder, embed_column, embedding_texts
from .sources.files import source_files
from .session import pin_small
from .sources.store import Store
from .streaming.sinks import embed_backlog, index_batch

# The tools in registration order with their tier.
TOOLS = (
    ("get_context_capsule", "core"), ("index_files", "extended"), ("index_status", "core"), ("get_impact_graph", "core"),
    ("cache_summary", "extended"), ("store_context", "extended"), ("fetch_context", "core"),
    ("report_kv_repair_event", "extended"), ("list_context", "core"), ("search_context", "core"), ("flush_context", "extended"),
    ("store_memory", "extended"), ("recall_memory", "core"), ("forget_memory", "extended"), ("search_semantic", "core"),
    ("get_project_map", "core"), ("get_file_context", "core"), ("analyze_dead_code", "extended"), ("analyze_complexity", "extended"),
    ("execute_code", "complete"), ("export_bundle", "extended"), ("import_bundle", "extended"), ("search_docs", "core"),
    ("fetch_doc", "extended"), ("add_doc_source", "extended"), ("remove_doc_source", "extended"), ("list_doc_sources", "core"),
    ("update_doc_source", "extended"), ("retrieve", "core"),
)
TIERS = ("core", "extended", "complete")


def visible_tools(tier: str = "core", disabled: tuple[str, ...] = ()) -> list[str]:
    """Tools enabled at a tier."""
    level = TIERS.index(tier) if tier in TIERS else 0
    return [name for name, t in TOOLS if TIERS.index(t) <= level and name not in disabled]


@dataclass
class ContextEngine:
    """Entry point for one deployment."""

    spark: SparkSession
    store: Store
    make_embedder: Callable[[], Embedder] = HashingEmbedder
    dims: int = 768
    limits: notes.Limits = field(default_factory=notes.Limits)
    registry: scripts.ScriptRegistry = field(default_factory=scripts.ScriptRegistry)

    # --- helpers ---

    def now(self) -> Column:
        """The current instant as a literal, so that one plan uses one time."""
        row = self.spark.sql("SELECT current_timestamp()::timestamp_ntz AS now").first()
        return F.lit(row["now"]).cast("timestamp_ntz")

    def request(self, **values: Any) -> DataFrame:
        """One request as a DataFrame; with a text it carries the text's vector."""
        one = self.spark.range(1).select(F.col("id").alias("query_id"), *[F.lit(v).alias(k) for k, v in values.items()])
        return self.with_vectors(one) if "text" in values else one

    def with_vectors(self, requests: DataFrame) -> DataFrame:
        return requests.withColumn("vector", embed_column(self.make_embedder, F.col("text")))

    def scoped_symbols(self, project_path: str, wanted: filters.SearchFilters | None = None) -> DataFrame:
        rows = filters.in_scope(self.store.symbols(), self.store.read("project_links"), project_path)
        return rows if wanted is None else rows.where(wanted.predicate(project_path))

    def _code_hits(self, requests: DataFrame, project_path: str, symbols: DataFrame, wanted: filters.SearchFilters | None) -> DataFrame:
        """Text hits of the stored index within a scope; with filters, among the symbols they admit."""
        scopes = filters.scope_names(self.store.read("project_links"), project_path)
        allowed = None if wanted is None else symbols.select(F.col("id").alias("doc"))
        return self.store.text("code").search(requests.select("query_id", "text"), lexical.CANDIDATES, scopes, allowed)

    def _doc_hits(self, requests: DataFrame, limit: int) -> DataFrame:
        """Documentation chunks by text, or where nothing matches by the whole text as a phrase, fused with those by vector."""
        found = pin_small(self.store.text("docs").search(requests.select("query_id", "text"), 2 * limit))
        unanswered = requests.join(found.select("query_id").distinct(), "query_id", "left_anti")
        chunks = self.store.doc_content()
        phrase = lexical.phrase_search(chunks, unanswered, "chunk_id", [F.col("title"), F.col("content")],
                                       [F.desc("updated_at"), F.col("chunk_id")], 2 * limit)
        text = found.unionByName(phrase).withColumnRenamed("doc_id", "id")
        vectors = self._entity_vectors("doc", chunks.select(F.col("chunk_id").alias("ident"), "content_hash"))
        near = entities.nearest(vectors, requests, 2 * limit, self.dims)
        return entities.fused(text, near, limit).withColumnRenamed("id", "doc_id")

    def _vectors_of(self, symbols: DataFrame) -> DataFrame:
        """Code vectors of the given symbols, joined by content hash."""
        code = self.store.read("vectors").where(F.col("doc_type") == "code").select(
            F.col("content_hash").alias("embed_hash"), "project_path", "embedding")
        return symbols.select(F.col("id").alias("vec_id"), "embed_hash", "project_path").join(code, ["embed_hash", "project_path"])

    # --- index ---

    def index_files(self, path: str, project_path: str, include_logs: bool = False, max_log_bytes: int | None = None) -> None:
        found = source_files(self.spark, path, project_path, include_logs=include_logs, max_log_bytes=max_log_bytes)
        index_batch(self.store, found, self.now(), include_logs)

    def embed_missing(self, files: int | None = None, kinds: tuple[str, ...] = ("code", "doc", "note", "memory")) -> None:
        """Embeds what has no current vector; `files` bounds the code of one pass."""
        if "code" in kinds:
            embed_backlog(self.store, self.make_embedder, files)
        for kind in kinds:
            if kind != "code":
                backlog = entities.missing(kind, self._embeddable(kind), self.store.read("vectors"))
                self.store.append("vectors", entities.vector_rows(kind, backlog, lambda text: embed_column(self.make_embedder, text)))

    # --- embedding in passes: what failed is tried again later, a search can ask for its scope first ---

    def _units(self, kind: str) -> DataFrame:
        """(kind, unit, project_path, changed_at): what should have vectors."""
        if kind == "code":
            live = self.store.symbols().select("file", "project_path", "version").distinct()
            return live.select(F.lit(kind).alias("kind"), F.col("file").alias("unit"), "project_path", F.col("version").alias("changed_at"))
        rows, at = {"doc": (self.store.doc_content, "updated_at"), "note": (self.store.notes, "created_at"),
                    "memory": (lambda: self.memory_entries().where(memory.is_open()), "created_at")}[kind]
        project = F.lit("") if kind == "doc" else F.coalesce("project_path", F.lit(""))
        return rows().select(F.lit(kind).alias("kind"), F.col("chunk_id" if kind == "doc" else "ref").alias("unit"), project.alias("project_path"), F.col(at).alias("changed_at"))

    def embed_status(self, kind: str, rules: backlog.Retries = backlog.Retries()) -> DataFrame:
        """The backlog of a kind: see operators.backlog."""
        vectors, units = self.store.read("vectors"), self._units(kind)
        if kind == "code":
            lacking = upkeep.missing_vectors(self.store.symbols(), vectors).select(F.col("file").alias("unit"), "project_path")
            missing = units.join(lacking, ["unit", "project_path"], "left_semi")
        else:
            lacking = entities.missing(kind, self._embeddable(kind), vectors).select(F.col("ident").alias("unit"))
            missing = units.join(lacking, "unit", "left_semi")
        return backlog.backlog(missing, self.store.read("embed_requests"), self.store.read("embed_attempts"), self.now(), rules)

    def embed_pass(self, kind: str, units: int | None = None, project_path: str | None = None, rules: backlog.Retries = backlog.Retries()) -> int:
        """One pass over the ready units of a kind, best lane first; returns how many it took. Every unit leaves an attempt in
        the log; texts that an embedder refuses do not hold up the others."""
        todo = self.embed_status(kind, rules)
        todo = todo if project_path is None else todo.where(F.col("project_path") == project_path)
        # what a pass takes is written down first: the backlog changes with everything the pass appends
        ident = uuid.uuid4().hex
        self.store.append("embed_passes", backlog.take(todo, units).withColumn("pass_id", F.lit(ident)))
        chosen = self.store.read("embed_passes").where(F.col("pass_id") == ident).select(*backlog.UNIT)
        keys = chosen.withColumnRenamed("unit", "file" if kind == "code" else "ident").drop("kind")
        if kind == "code":
            pending = self.store.symbols().join(keys, ["file", "project_path"], "left_semi")
            texts = embedding_texts(pending)
            owners = pending.select("project_path", F.col("file").alias("unit"), F.col("embed_hash").alias("content_hash")).distinct()
        else:
            texts = self._embeddable(kind).join(keys.select("ident"), "ident", "left_semi")
            owners = texts.select(F.coalesce("project_path", F.lit("")).alias("project_path"), F.col("ident").alias("unit"), "content_hash")
        tried = texts.withColumn("tried", backlog.try_embed(self.make_embedder, F.col("text"))).persist()
        good = tried.where("tried.error IS NULL").withColumn("embedding", F.col("tried.embedding"))
        if kind == "code":
            self.store.append("vectors", good.withColumn("doc_type", F.lit("code")))
        else:
            self.store.append("vectors", good.select("content_hash", "embedding", F.lit(kind).alias("doc_type"), F.lit(kind).alias("kind"), "project_path",
                                                     entities.entity_key(kind, F.col("ident")).alias("source_file")))
        errors = tried.where("tried.error IS NOT NULL").groupBy("content_hash").agg(F.min("tried.error").alias("error"))
        failed = owners.join(errors, "content_hash").groupBy("unit", "project_path").agg(F.min("error").alias("error"))
        rows = chosen.withColumn("project_path", F.coalesce("project_path", F.lit(""))).join(failed, ["unit", "project_path"], "left")
        self.store.append("embed_attempts", rows.withColumn("ok", F.col("error").isNull()).withColumn("attempted_at", self.now()))
        tried.unpersist()
        return chosen.count()

    def request_embedding(self, kind: str, project_path: str, unit: str = "", lane: int = backlog.HIGH) -> None:
        """Raises a unit, or all of a project, for a limited time."""
        row = self.spark.createDataFrame([(kind, unit, project_path, lane)], "kind string, unit string, project_path string, lane int")
        self.store.append("embed_requests", row.withColumn("requested_at", self.now()))

    def ensure_fresh(self, project_path: str, max_seconds: float = 120.0, units_per_pass: int = 1000, kind: str = "code",
                     rules: backlog.Retries = backlog.Retries()) -> DataFrame:
        """Embeds what a scope is missing before a search, for a bounded time; returns its freshness (operators.backlog). Units
        that wait for their next try are not waited for."""
        scopes = filters.scope_names(self.store.read("project_links"), project_path)
        until = time.monotonic() + max_seconds
        for scope in scopes:
            self.request_embedding(kind, scope)
            while time.monotonic() < until and self.embed_pass(kind, units_per_pass, scope, rules) == units_per_pass:
                pass  # a pass that took fewer took all that was ready
        inside = F.col("project_path").isin(*scopes)
        return backlog.freshness(self._units(kind).where(inside), self.embed_status(kind, rules).where(inside))

    def _embeddable(self, kind: str) -> DataFrame:
        rows = {"doc": self.store.doc_content, "note": self.store.notes, "memory": lambda: self.memory_entries().where(memory.is_open())}[kind]()
        return entities.embeddable(kind, rows)

    def _entity_vectors(self, kind: str, live: DataFrame) -> DataFrame:
        return entities.current_vectors(kind, self.store.read("vectors"), live)

    def reconcile(self, path: str, project_path: str) -> DataFrame:
        """(file, status) of a tree against the index; index the new and modified, drop the deleted."""
        known = self.store.files().where(F.col("project_path") == project_path)
        return upkeep.catch_up(source_files(self.spark, path, project_path), known)

    def index_status(self, project_path: str = "") -> DataFrame:
        syms = self.store.symbols()
        if not project_path:
            return syms.agg(F.count("*").alias("total_nodes"), F.count_distinct("file").alias("total_files"))
        roots = self.spark.createDataFrame([(project_path,)], "root string")
        return usage.scope_index_stats(syms, filters.scope_paths(self.store.read("project_links"), roots))

    def link_project(self, parent: str, child: str) -> None:
        """Links a child project under its container; a container may not itself be linked."""
        linked = self.store.read("project_links").where(F.col("child_path") == parent).limit(1).count() > 0
        if not child.startswith(parent.rstrip("/") + "/") or linked:
            raise ValueError("child must lie below parent, and parent must not be linked itself")
        self.store.append("project_links", self.spark.createDataFrame([(parent, child, False)], "parent_path string, child_path string, auto_linked boolean"))
        self.store.purge_links(self.spark.createDataFrame([(parent, child)], "parent_path string, child_path string"))

    def auto_link(self) -> DataFrame:
        """Links indexed projects that lie below another one and are not linked yet; returns all links made this way."""
        links = self.store.read("project_links")
        found = filters.auto_links(self.store.files().select("project_path"))
        new = found.join(links.select("parent_path", "child_path"), ["parent_path", "child_path"], "left_anti")
        self.store.append("project_links", new.withColumns({"auto_linked": F.lit(True), "created_at": self.now()}))
        made = self.store.read("project_links").where("auto_linked")
        self.store.purge_links(made)
        return made

    def drop_files(self, files: DataFrame) -> None:
        """Removes files (file, project_path) from the index: a newer manifest version without rows."""
        gone = files.select("file", "project_path").distinct().persist()
        self.store.append("indexed_files", gone.select("file", "project_path", self.now().alias("indexed_at")))
        self.store.refresh_text("code", gone.select(F.col("project_path").alias("scope"), F.col("file").alias("unit")))
        gone.unpersist()

    def compact_text(self) -> None:
        """Rewrites the segments of both text indexes as one each; searches that run meanwhile keep the version they began with."""
        for collection in ("code", "docs"):
            self.store.text(collection).compact()

    def reset_project(self, project_path: str) -> None:
        """Removes all rows of a project, vectors and summaries too."""
        self.store.purge([project_path])

    def compact(self) -> None:
        """Rewrites tables to their current rows, and the text indexes; whoever reads meanwhile keeps what they began with."""
        self.store.compact()
        self.compact_text()

    def expire_queries(self, max_age_days: int = 90) -> bool:
        """Removes calls older than the first day kept; False where the log was being written to."""
        return self.store.expire("queries", ~upkeep.expired(self.store.read("queries"), self.now(), max_age_days))

    # --- search ---

    def get_context_capsule(self, query: str, project_path: str, mode: str = "auto", session_id: str = "",
                            token_budget: int = capsule_plan.CAPSULE_BUDGET, limit: int = capsule_plan.CAPSULE_LIMIT, **args: Any) -> DataFrame:
        one = self.request(text=query, session_id=session_id, mode=mode, token_budget=token_budget, root=project_path)
        return self.capsules(one, project_path, filters.SearchFilters.parse(args), limit)

    def capsules(self, requests: DataFrame, project_path: str, wanted: filters.SearchFilters | None = None, limit: int = 30) -> DataFrame:
        syms = self.scoped_symbols(project_path, wanted)
        return capsule_plan.capsule(syms, self._vectors_of(syms), requests, self.store.read("sessions"), self.store.summaries(),
                                    limit, self.dims, fallback=True, text_hits=self._code_hits(requests, project_path, syms, wanted))

    def log_returned(self, packed: DataFrame, session_id: str) -> None:
        """Remembers what a session was sent; the only write of a search, left to the caller."""
        rows = packed.where("sent").select(F.lit(session_id).alias("session_id"), "file", "name", "start_line",
                                           "mode", F.col("tokens").alias("token_count"), self.now().alias("returned_at"))
        self.store.append("sessions", rows)

    def search_semantic(self, query: str, project_path: str, limit: int = 10, doc_type: str = "", mode: str = "skeleton",
                        session_id: str = "", token_budget: int = 4000, **args: Any) -> DataFrame:
        if doc_type == "doc":
            return self.search_docs(query, limit)
        syms = self.scoped_symbols(project_path, filters.SearchFilters.parse(args))
        one = self.request(text=query, session_id=session_id, mode=mode, token_budget=token_budget, root=project_path)
        near = knn.knn(self._vectors_of(syms), one, limit, self.dims).select(
            "query_id", F.col("vec_id").alias("id"), F.col("similarity").alias("score"), "rank")
        hits = capsule_plan.prepare_hits(near, syms, one, self.store.read("sessions"), self.store.summaries())
        return packing.pack(hits.withColumn("extra_bytes", F.lit(0)))

    def search_docs(self, query: str, limit: int = 10) -> DataFrame:
        chunks, one = self.store.doc_content(), self.request(text=query)
        return self._doc_hits(one, limit).join(chunks.withColumnRenamed("chunk_id", "doc_id"), "doc_id").orderBy("rank")

    def retrieve(self, query: str, project_path: str, limit: int = 10, token_budget: int = 4000, include_docs: bool = True,
                 include_source: bool = False, mode: str = "skeleton", session_id: str = "", include_memory: bool = False,
                 format: str = "markdown", **args: Any) -> DataFrame:
        wanted = filters.SearchFilters.parse(args)
        syms = self.scoped_symbols(project_path, wanted)
        one = self.request(text=query, session_id=session_id, mode=mode, token_budget=token_budget, root=project_path)
        recalled = None
        if include_memory and session_id:
            share = max(token_budget // retrieve_plan.MEMORY_SHARE, retrieve_plan.MIN_MEMORY_BUDGET)
            recalled = memory.recall_text(self.recall_memory(query, session_id, project_path, token_budget=share))
        return retrieve_plan.retrieve(syms, self._vectors_of(syms), self.store.doc_content(), one, self.store.read("sessions"),
                                      limit, self.dims, include_docs, include_source, format, recalled, fallback=True,
                                      text_hits=self._code_hits(one, project_path, syms, wanted),
                                      doc_hits=self._doc_hits(one, limit // 2 or retrieve_plan.DOC_LIMIT) if include_docs else None)

    def hybrid_metrics(self, requests: DataFrame, project_path: str, limit: int = 30) -> DataFrame:
        syms = self.scoped_symbols(project_path)
        found = capsule_plan.hybrid_candidates(syms, self._vectors_of(syms), requests, limit, self.dims, fallback=True,
                                               text_hits=self._code_hits(requests, project_path, syms, None))
        return fusion.stage_counts(requests, found, limit)

    def get_file_context(self, file: str, project_path: str, mode: str = "skeleton", session_id: str = "", token_budget: int = 0) -> DataFrame:
        """All symbols of one file in line order; every score is 1, so 'auto' means full."""
        syms = self.scoped_symbols(project_path).where(F.col("file") == file)
        ranked = syms.select(F.lit(0).cast("long").alias("query_id"), "id", F.lit(1.0).alias("score"), "start_line")
        ranked = lexical.top_per_group(ranked, ["query_id"], [F.col("start_line"), F.col("id")], 1 << 30).drop("start_line")
        one = self.request(session_id=session_id, mode=mode, token_budget=token_budget, root=project_path)
        hits = capsule_plan.prepare_hits(ranked, syms, one, self.store.read("sessions"), self.store.summaries())
        return packing.pack(hits.withColumn("extra_bytes", F.lit(0)))

    def cache_summary(self, file: str, summary: str, project_path: str, symbol: str = "") -> None:
        """Stores a summary with the hash of the code it describes."""
        code = self.store.symbols().where((F.col("file") == file) & (F.col("name") == symbol)).agg(F.first("code").alias("c")).select(
            F.coalesce(content_hash(blank_to_null("c")), F.lit("")).alias("content_hash"))
        self.store.append("summaries", code.select(F.lit(file).alias("file"), F.lit(symbol).alias("name"), F.lit(summary).alias("summary_text"),
                                                   "content_hash", F.lit(project_path).alias("project_path"), self.now().alias("created_at")))

    # --- analysis ---

    def get_project_map(self, project_path: str, depth: int = 2) -> DataFrame:
        return graph.project_map(self.scoped_symbols(project_path), project_path, depth)

    def get_impact_graph(self, symbol: str, project_path: str, exact: bool = False) -> DataFrame:
        edges = filters.in_scope(self.store.edges(), self.store.read("project_links"), project_path)
        found = graph.impact(edges, self.scoped_symbols(project_path), self.request(symbol=symbol), exact)
        return found.select(relative_path("source_file", F.lit(project_path)).alias("file"), "target", "kind")

    def analyze_dead_code(self, project_path: str, kind: str = "") -> DataFrame:
        return graph.unused_symbols(self.scoped_symbols(project_path), self.store.edges(), kind).orderBy("file", "name")

    def analyze_complexity(self, project_path: str, threshold: int = 10, limit: int = 20) -> DataFrame:
        return extraction.analyze_complexity(self.scoped_symbols(project_path), threshold, limit)

    def execute_code(self, script_id: str, results: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows, savings) of a registered view; register your own DataFrame function for other code."""
        out = self.registry.run(script_id, results)
        return out, scripts.script_savings(results, out)

    # --- notes ---

    def store_context(self, new_notes: DataFrame, extract_memory: bool = False) -> DataFrame:
        """Admits notes (session_id, content, pos and optionally label, project_path, tags, kind, metadata_json) under
        the caps of sessions and of all together, given what is held; returns every note with admitted and refused_by."""
        optional = {"label": "", "project_path": "", "tags": "", "kind": "", "metadata_json": ""}
        rows = new_notes.withColumns({c: F.lit(v) for c, v in optional.items() if c not in new_notes.columns})
        rows = rows.withColumn("content", F.trim("content")).where("content <> '' AND trim(session_id) <> ''")
        tagged = F.array_contains(F.transform(F.split("tags", ","), lambda t: F.trim(t)), "kv_repair")
        count = F.get_json_object("metadata_json", "$.token_count").cast("int")
        rows = rows.withColumn("kind", F.when((F.col("kind") == "") & tagged, "kv_repair").otherwise(F.col("kind")))
        size = F.when((F.col("kind") == "kv_repair") & (count > 0), count).otherwise(token_estimate("content"))
        rows = rows.withColumns({"token_est": size, "content_hash": content_hash("content"),
                                 "ref": stable_ref("ctx_", "session_id", "pos", "content")})
        held = self.store.notes().select("ref", "session_id", F.lit(-1).cast("long").alias("pos"), "token_est", F.lit(True).alias("held"))
        arriving = rows.select("ref", "session_id", F.col("pos").cast("long").alias("pos"), "token_est", F.lit(False).alias("held"))
        decided = notes.admit_globally(held.unionByName(arriving), self.limits).where("NOT held").select("ref", "admitted", "refused_by")
        out = rows.join(decided, "ref")
        kept = out.where("admitted")
        self.store.append("context_notes", kept.withColumn("created_at", self.now()))
        if extract_memory:
            facts = memory.extract_entries(kept, "content", ["session_id", "project_path", "ref"])
            self.store_memory(facts.withColumnRenamed("ref", "source_ref").withColumn("scope", F.lit("session")))
        return out

    def fetch_context(self, refs: list[str], session_id: str = "") -> DataFrame:
        found = self.store.notes().where(F.col("ref").isin(*refs))
        return found.where(F.col("session_id") == session_id) if session_id else found

    def record_access(self, fetched: DataFrame, tool: str, repair_reason: str = "") -> None:
        rows = fetched.select("ref", "session_id", "project_path", F.lit(tool).alias("tool_name"), F.col("token_est").alias("virtual_tokens"),
                              normalize_reason(F.lit(repair_reason)).alias("repair_reason"), self.now().alias("accessed_at"))
        self.store.append("context_note_access", rows.where("virtual_tokens > 0"))

    def list_context(self, session_id: str, project_path: str = "", limit: int = notes.LIST_LIMIT) -> DataFrame:
        mine = self.store.notes().where(F.col("session_id") == session_id)
        return notes.list_notes(mine.where(F.col("project_path") == project_path) if project_path else mine, limit)

    def search_context(self, query: str, session_id: str = "", project_path: str = "", limit: int = notes.SEARCH_LIMIT) -> DataFrame:
        live = self.store.notes()
        live = live.where(F.col("project_path") == project_path) if project_path else live
        one = self.request(text=query, session_id=session_id)
        vectors = self._entity_vectors("note", live.select(F.col("ref").alias("ident"), "content_hash", "session_id"))
        near = entities.nearest_in_session(vectors, one, 2 * limit, self.dims)
        return notes.search_notes(live, one, limit, near.withColumnRenamed("id", "ref")).join(live, "ref")

    def flush_context(self, session_id: str = "", refs: list[str] | None = None, project_path: str = "", everything: bool = False) -> DataFrame:
        """Deletes notes; returns (flushed_refs, virtual_tokens_freed)."""
        gone = notes.flush(self.store.notes(), session_id, refs, project_path, everything).persist()
        freed = gone.agg(F.count("*").alias("flushed_refs"), F.coalesce(F.sum("token_est"), F.lit(0)).alias("virtual_tokens_freed"))
        summary = self.spark.createDataFrame(freed.toArrow(), freed.schema)
        self.store.append("note_tombstones", gone)
        gone.unpersist()
        return summary

    def report_kv_repair_event(self, events: DataFrame) -> None:
        """Appends repair signals (reason, outcome, …); an unknown reason counts as manual."""
        reason = F.coalesce(blank_to_null(normalize_reason("reason")), F.lit("manual"))
        self.store.append("kv_repair_events", events.withColumns(
            {"repair_reason": reason, "outcome": normalize_outcome("outcome"), "created_at": self.now()}))

    # --- memory ---

    def store_memory(self, entries: DataFrame) -> None:
        """Appends facts (subject, predicate, object) and procedures (rule) with their scope and owner."""
        from .functions.scalars import normalize_scope
        optional = ("session_id", "project_path", "scope", "subject", "predicate", "object", "rule", "source_ref")
        rows = entries.withColumns({c: F.lit(None).cast("string") for c in optional if c not in entries.columns})
        rows = rows.withColumn("predicate", F.when(F.col("kind") == "fact", F.coalesce(blank_to_null(F.trim("predicate")), F.lit("is"))))
        rows = rows.withColumn("scope", normalize_scope("scope", "session_id", "project_path")).where("scope IS NOT NULL")
        rows = rows.where(((F.col("kind") == "fact") & (F.trim("subject") != "") & (F.trim("object") != ""))
                          | ((F.col("kind") == "procedure") & (F.trim("rule") != "")))
        flag = F.col("invalidate_previous") if "invalidate_previous" in entries.columns else F.lit(True)
        parts = ["kind", "scope", "session_id", "project_path", "subject", "predicate", "object", "rule"]
        stamped = rows.withColumns({"token_est": memory.entry_tokens(), "invalidate_previous": flag, "valid_from": self.now()})
        self.store.append("structured_memory", stamped.withColumn("ref", stable_ref("mem_", *parts, "valid_from")))

    def memory_entries(self) -> DataFrame:
        """All entries with their validity and access counts."""
        known = memory.supersede(self.store.read("structured_memory"), self.store.read("memory_tombstones"))
        counts = self.store.read("memory_access").groupBy("ref").agg(F.count("*").cast("int").alias("access_count"))
        return known.join(counts, "ref", "left").na.fill(0, ["access_count"]).withColumn("created_at", F.col("valid_from"))

    def recall_memory(self, query: str = "", session_id: str = "", project_path: str = "", scope: str = "", kinds: list[str] | None = None,
                      as_of: str = "", limit: int = memory.RECALL_LIMIT, token_budget: int = memory.RECALL_BUDGET) -> DataFrame:
        valid = memory.valid_at(F.lit(as_of).cast("timestamp_ntz")) if as_of else memory.is_open()
        known = self.memory_entries()
        vectors = self._entity_vectors("memory", known.select(F.col("ref").alias("ident"), F.col("ref").alias("content_hash"))).select(
            F.col("ident").alias("vec_ref"), "embedding")
        return memory.recall(known, self.request(text=query), valid, memory.in_scope(scope, session_id, project_path),
                             kinds, limit, token_budget, vectors, self.dims)

    def forget_memory(self, **selection: Any) -> DataFrame:
        """Ends entries; returns (invalidated_refs, virtual_tokens_freed)."""
        gone = memory.forget(self.memory_entries(), self.now(), **selection).persist()
        freed = gone.agg(F.count("*").alias("invalidated_refs"), F.coalesce(F.sum("token_est"), F.lit(0)).alias("virtual_tokens_freed"))
        summary = self.spark.createDataFrame(freed.toArrow(), freed.schema)
        self.store.append("memory_tombstones", gone)
        gone.unpersist()
        return summary

    # --- documentation ---

    def add_doc_source(self, name: str, type: str, url: str, version: str = "") -> None:
        row = self.spark.range(1).select(stable_ref("src_", F.lit(name), F.lit(type), F.lit(url)).alias("id"), F.lit(name).alias("name"),
                                         F.lit(type).alias("type"), F.lit(url).alias("url"), F.lit(version).alias("version"), self.now().alias("created_at"))
        self.store.append("doc_sources", row)

    def list_doc_sources(self) -> DataFrame:
        return self.store.doc_sources().orderBy("name", "id")

    def remove_doc_source(self, source_id: str) -> None:
        """Removes a source; its chunks are no longer found."""
        gone = self.list_doc_sources().where(F.col("id") == source_id)
        self.store.append("doc_sources", gone.withColumn("url", F.lit("")).withColumn("created_at", self.now()))
        self._refresh_docs(self.spark.createDataFrame([(source_id,)], "unit string"))

    def _refresh_docs(self, units: DataFrame) -> None:
        self.store.refresh_text("docs", units.select(F.lit("").alias("scope"), "unit"))

    def update_doc_source(self, bodies: DataFrame) -> None:
        """Chunks and stores fetched bodies (id, type, url, body); see documents.fetch_bodies."""
        bodies = bodies.persist()
        self.store.append("doc_content", doc_sources.chunk_bodies(bodies).withColumn("updated_at", self.now()))
        self._refresh_docs(bodies.select(F.col("id").alias("unit")))
        bodies.unpersist()

    def fetch_doc(self, name: str, type: str, url: str, version: str = "", force_refresh: bool = False,
                  fetch: doc_sources.Fetch = doc_sources.http_get) -> DataFrame:
        """Registers a source, fetches it when missing or stale, and returns its chunks."""
        self.add_doc_source(name, type, url, version)
        mine = self.list_doc_sources().where((F.col("name") == name) & (F.col("url") == url))
        known = self.store.doc_content().groupBy(F.col("source_id").alias("id")).agg(F.max("updated_at").alias("last_updated"))
        due = doc_sources.due(mine.drop("last_updated").join(known, "id", "left"), self.now(), force_refresh)
        self.update_doc_source(doc_sources.fetch_bodies(due, fetch))
        return self.store.doc_content().join(mine.select(F.col("id").alias("source_id")), "source_id", "left_semi")

    # --- bundles ---

    def export_bundle(self, project_path: str, output_path: str) -> None:
        self.store.export_bundle(project_path, output_path)

    def import_bundle(self, bundle_path: str) -> None:
        self.store.import_bundle(bundle_path)
