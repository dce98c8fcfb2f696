"""Temporal facts and procedures: extraction, supersession, as-of reads, recall, forgetting.

Facts are appended; when a fact ends is derived. A fact is closed by the next fact with the same
scope, owner, subject and predicate, or earlier by a tombstone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import ColumnLike, as_col, micros, token_estimate, trim_space
from ..functions.text import tokens
from . import fusion, knn
from ..session import pin_small
from .lexical import Asked, expand_prefixes, first_non_empty, phrase_matches
from .ordered import as_of, neighbour, top_per_group

# Recall defaults and the assumed size of a source relative to its line.
RECALL_LIMIT, RECALL_BUDGET, SOURCE_RATIO = 10, 800, 8
RULE_LABELS = r"(?i)^(RULE|PROC|PREFER|PROCEDURE):"


# --- extraction --------------------------------------------------------------------------------

def extract_entries(df: DataFrame, text: ColumnLike, keep: list[str]) -> DataFrame:
    """(keep…, line_no, kind, subject, predicate, object, rule) from labelled or structured lines:
    'FACT: …', 'RULE: …' and its variants, 'a | b | c', 'key: value', or three words and more."""
    raw = df.select(*keep, F.posexplode(F.split(as_col(text), "\n")).alias("line_no", "line"))
    line = F.regexp_replace(trim_space("line"), "^[-*• ]+", "")
    raw = raw.withColumn("line", line).where("line <> ''")
    is_fact = F.startswith(F.upper("line"), F.lit("FACT:"))
    rule = trim_space(F.regexp_replace("line", "^[^:]*:", ""))
    body = trim_space(F.when(is_fact, F.substr("line", F.lit(6))).otherwise(F.col("line")))
    raw = raw.withColumn("is_rule", ~is_fact & F.rlike("line", F.lit(RULE_LABELS))).withColumn("rule_text", rule).withColumn("s", body)

    pipes = F.transform(F.split("s", r"\|"), trim_space)
    three = (F.size(pipes) == 3) & ~F.array_contains(pipes, "")
    subject, value = trim_space(F.regexp_extract("s", r"(?s)^([^:]+):(.+)$", 1)), trim_space(F.regexp_extract("s", r"(?s)^([^:]+):(.+)$", 2))
    pair = (subject != "") & (value != "") & ~F.contains(subject, F.lit(" "))
    words = F.split("s", r"\s+")
    sentence = (F.col("s") != "") & (F.size(words) >= 3)

    def triple(s: Column, p: Column, o: Column) -> Column:
        return F.struct(s.alias("subject"), p.alias("predicate"), o.alias("object"))

    fact = (F.when(three, triple(F.get(pipes, F.lit(0)), F.get(pipes, F.lit(1)), F.get(pipes, F.lit(2))))
            .when(pair, triple(subject, F.lit("is"), value))
            .when(sentence, triple(F.get(words, F.lit(0)), F.get(words, F.lit(1)),
                                   F.array_join(F.slice(words, F.lit(3), F.size(words)), " "))))
    out = raw.withColumn("fact", F.when(~F.col("is_rule"), fact))
    out = out.where((F.col("is_rule") & (F.col("rule_text") != "")) | F.col("fact").isNotNull())
    return out.select(*keep, "line_no", F.when(F.col("is_rule"), "procedure").otherwise("fact").alias("kind"),
                      "fact.subject", "fact.predicate", "fact.object", F.when(F.col("is_rule"), F.col("rule_text")).alias("rule"))


def format_line() -> Column:
    """One compact line per entry; '' when there is nothing to say."""
    def part(name: str) -> Column:
        return F.trim(F.coalesce(name, F.lit("")))

    rule = F.when(part("rule") != "", F.concat(F.lit("PROC: "), part("rule"))).otherwise("PROC: (empty)")
    predicate = F.when(part("predicate") == "", "is").otherwise(part("predicate"))
    fact = F.trim(F.concat_ws(" ", part("subject"), predicate, part("object")))
    empty = (part("subject") == "") & (part("object") == "")
    return F.when(F.col("kind") == "procedure", rule).when(empty, "").otherwise(fact)


def entry_tokens() -> Column:
    return token_estimate(format_line())


# --- time --------------------------------------------------------------------------------------

OWNER = "__owner"


def _with_owner(entries: DataFrame) -> DataFrame:
    owner = (F.when(F.col("scope") == "session", F.col("session_id"))
             .when(F.col("scope") == "project", F.col("project_path")).otherwise(""))
    return entries.withColumn(OWNER, F.coalesce(owner, F.lit("")))


def supersede(entries: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """Adds valid_until and superseded_by to appended entries.

    entries: ref, kind, scope, session_id, project_path, subject, predicate, valid_from and, optionally,
    invalidate_previous (default true): a fact with false leaves its predecessor open.
    tombstones: ref, forgotten_at.
    """
    rows = _with_owner(entries)
    flagged = "invalidate_previous" in entries.columns
    facts = rows.where("kind = 'fact'").withColumn("__t", micros("valid_from"))
    chain = ["scope", OWNER, "subject", "predicate"]
    closing = facts.where("invalidate_previous") if flagged else facts
    if flagged:
        # the next closing fact: the latest known one when time runs backwards
        versions = closing.select(*chain, "__t", "ref", "valid_from")
        probes = facts.select(*chain, "__t", F.col("ref").alias("own_ref"))
        found = as_of(probes, versions, chain, -F.col("__t") - 1, -F.col("__t"), ["ref", "valid_from"], "next")
    else:
        found = neighbour(facts.select(*chain, "__t", "valid_from", "ref", F.col("ref").alias("own_ref")), chain,
                          F.col("__t"), ["__t", "ref"], ["ref", "valid_from"], "next")
    ends = found.select(F.col("own_ref").alias("ref"), F.col("next.ref").alias("__by"), F.col("next.valid_from").alias("__end"))
    out = rows.join(ends, "ref", "left")
    if tombstones is not None:
        out = out.join(tombstones.groupBy("ref").agg(F.min("forgotten_at").alias("__gone")), "ref", "left")
    else:
        out = out.withColumn("__gone", F.lit(None).cast(entries.schema["valid_from"].dataType))
    forgotten_first = F.col("__gone").isNotNull() & (F.col("__end").isNull() | (F.col("__gone") < F.col("__end")))
    out = (out.withColumn("valid_until", F.least("__gone", "__end"))
           .withColumn("superseded_by", F.when(~forgotten_first, F.col("__by"))))
    return out.select(*entries.columns, "valid_until", "superseded_by")


def is_open() -> Column:
    return F.col("valid_until").isNull()


def valid_at(t: Column) -> Column:
    """Half-open validity [valid_from, valid_until)."""
    return (F.col("valid_from") <= t) & (F.col("valid_until").isNull() | (F.col("valid_until") > t))


def in_scope(scope: str = "", session_id: str = "", project_path: str = "") -> Column:
    """An explicit scope, or global entries plus those of the given session and project; without ids
    and scope everything."""
    session = (F.col("scope") == "session") & (F.col("session_id") == session_id)
    project = (F.col("scope") == "project") & (F.col("project_path") == project_path)
    if scope:
        return {"session": session, "project": project, "global": F.col("scope") == "global"}[scope]
    if not session_id and not project_path:
        return F.lit(True)
    test = F.col("scope") == "global"
    if session_id:
        test = test | session
    return test | project if project_path else test


# --- recall ------------------------------------------------------------------------------------

def _text() -> list[Column]:
    return [F.coalesce(c, F.lit("")) for c in ("subject", "predicate", "object", "rule")]


def _newest() -> list[Column]:
    return [F.desc("access_count"), F.desc("created_at"), F.col("ref")]


def matching_entries(entries: DataFrame, requests: DataFrame, keep: list[str]) -> DataFrame:
    """(query_id, keep…) of entries with a word that starts with a query term; keep holds the ref."""
    asked = Asked.of(requests)
    words = entries.select(*keep, F.explode_outer(F.array_distinct(tokens(F.concat_ws(" ", *_text())))).alias("term"))
    hits = expand_prefixes(words, asked.lengths).join(asked.prefixes, "prefix").select(*keep, "prefix")
    return hits.join(asked.terms, "prefix").select("query_id", *keep).distinct()


def recall(entries: DataFrame, requests: DataFrame, valid: Column | None = None, scope: Column | None = None,
           kinds: list[str] | None = None, limit: int = RECALL_LIMIT, budget: int = RECALL_BUDGET,
           vectors: DataFrame | None = None, dims: int = 768) -> DataFrame:
    """(query_id, rank, ref, line, tokens, cum_tokens): entries per request that fit the budget, the
    first one always. Words first, then the whole phrase, then vectors: the first stage with any hit
    counts. A request with an empty text lists what is known.

    entries: ref, kind, scope, …, valid_from, valid_until, access_count, created_at. requests: query_id, text
    (and vector with vectors: vec_ref, embedding).
    """
    live = entries.where(valid if valid is not None else is_open())
    if scope is not None:
        live = live.where(scope)
    if kinds:
        live = live.where(F.col("kind").isin(*kinds))
    live = live.withColumns({"line": format_line(), "tokens": entry_tokens()})
    keep = ["ref", "access_count", "created_at", "valid_until", "line", "tokens"]
    requests = pin_small(requests)
    blank = F.trim("text") == ""
    typed, empty = requests.where(~blank), requests.where(blank).select("query_id")

    def best(found: DataFrame) -> DataFrame:
        return top_per_group(found.select("query_id", *keep), ["query_id"], _newest(), limit)

    parts = []
    if not typed.isEmpty():
        stages = [best(matching_entries(live, typed, keep)), best(phrase_matches(live, typed, _text()))]
        if vectors is not None:
            # only vectors of entries in question compete; twice the limit, since entries may share a similarity
            known = vectors.join(live.select(F.col("ref").alias("vec_ref")), "vec_ref", "left_semi")
            near = knn.knn(known, typed, 2 * limit, dims, "vec_ref").select("query_id", F.col("vec_id").alias("ref"))
            stages.append(best(near.join(live.select(*keep), "ref")))
        parts.append(first_non_empty(*stages).drop("stage"))
    if not empty.isEmpty():
        listed = live.select(*keep).orderBy(*_newest()).limit(limit)
        # at most `limit` entries, handed to every request without text
        known = listed.agg(F.sort_array(F.collect_list(F.struct(
            (-F.col("access_count")).alias("a"), (-micros("created_at")).alias("c"), F.col("ref").alias("r"),
            F.struct(*keep).alias("e")))).alias("l")).scalar()
        rows = empty.select("query_id", F.posexplode(known).alias("p", "k"))
        parts.append(rows.select("query_id", "k.e.*", (F.col("p") + 1).alias("rank")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = rows.withColumn("cum_tokens", F.sum("tokens").over(w))
    return cum.where((F.col("cum_tokens") <= budget) | (F.col("rank") == 1)).select(
        "query_id", "rank", "ref", "line", "valid_until", "tokens", "cum_tokens")


def recall_text(recalled: DataFrame) -> DataFrame:
    """(query_id, memory_text, memory_tokens, memory_lines, tokens_saved_est); few lines per request."""
    until = F.when(F.col("valid_until").isNotNull(), F.concat(F.lit(" (until "), F.col("valid_until").cast("string"), F.lit(")")))
    line = F.concat(F.lit("- "), F.col("line"), F.coalesce(until, F.lit("")))
    rows = recalled.where("line <> ''").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).alias("rows"),
        F.sum("tokens").alias("memory_tokens"), F.count("*").alias("memory_lines"))
    return rows.select("query_id", F.array_join(F.transform("rows", lambda r: r["l"]), "\n").alias("memory_text"),
                       "memory_tokens", "memory_lines", ((SOURCE_RATIO - 1) * F.col("memory_tokens")).alias("tokens_saved_est"))


# --- forgetting and inventory ------------------------------------------------------------------

def forget(entries: DataFrame, now: Column, refs: list[str] | None = None, subject: str = "", predicate: str = "",
           scope: str = "session", session_id: str = "", project_path: str = "", everything: bool = False) -> DataFrame:
    """Tombstones (ref, forgotten_at, token_est) for the selected entries; append them to the log."""
    if everything:
        chosen = entries.where(is_open())
    elif refs:
        chosen = entries.where(F.col("ref").isin(*refs))
    elif subject:
        chosen = entries.where(is_open() & (F.col("kind") == "fact") & (F.col("subject") == subject)
                               & (F.col("predicate") == (predicate or "is")) & in_scope(scope, session_id, project_path))
    else:
        raise ValueError("refs, subject or everything needed")
    return chosen.select("ref", now.alias("forgotten_at"), "token_est")


def inventory(entries: DataFrame, accesses: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """One row: active facts, procedures and tokens, never recalled, recalled and stored in the window."""
    start = now - F.make_dt_interval(F.lit(days))
    recalled = accesses.where(F.col("accessed_at") >= start).agg(F.count("*").alias("n")).scalar()
    open_ = is_open()
    out = entries.agg(
        F.count_if(open_ & (F.col("kind") == "fact")).alias("active_facts"),
        F.count_if(open_ & (F.col("kind") == "procedure")).alias("active_procedures"),
        F.coalesce(F.sum(F.when(open_, F.col("token_est"))), F.lit(0)).alias("active_tokens"),
        F.count_if(open_ & (F.coalesce("access_count", F.lit(0)) == 0)).alias("orphan_count"),
        F.count_if(F.col("created_at") >= start).alias("stored_in_window"))
    return out.select("*", recalled.alias("recalled_in_window"))


def fused_recall(lists: list[DataFrame], limit: int) -> DataFrame:
    """Fusion of ranked reference lists (query_id, ref, rank)."""
    return fusion.rrf(lists, "ref", limit)
