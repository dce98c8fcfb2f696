"""Memory, notes, sessions and event sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ...functions.scalars import micros, stable_ref, token_estimate
from ...operators import changes, entities, memory, notes, ordered, usage
from . import Catalogue
from .views import bm25_sql, request_terms_sql, requests, table, texts  # noqa: F401

CATALOGUE = Catalogue()
register = CATALOGUE.register
LIMITS = notes.Limits(session_notes=6, session_tokens=600)

# --- memory ------------------------------------------------------------------------------------

FACTS_SQL = """
facts AS (SELECT 'mem_' || event_id AS ref, 'fact' AS kind,
   CASE event_type WHEN 'signup' THEN 'global' WHEN 'purchase' THEN 'project' ELSE 'session' END AS scope,
   's' || user_id AS session_id, '/p' || (user_id // 10) AS project_path, 'user' || user_id AS subject, event_type AS predicate,
   value::VARCHAR AS object, ts AS valid_from, event_id FROM events),
owned AS (SELECT *, CASE scope WHEN 'session' THEN session_id WHEN 'project' THEN project_path ELSE '' END AS owner FROM facts),
mem AS (SELECT * EXCLUDE (owner), lead(valid_from) OVER w AS valid_until, lead(ref) OVER w AS superseded_by FROM owned
        WINDOW w AS (PARTITION BY scope, owner, subject, predicate ORDER BY valid_from, ref))"""


def facts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    user = F.col("user_id").cast("string")
    scope = F.when(F.col("event_type") == "signup", "global").when(F.col("event_type") == "purchase", "project").otherwise("session")
    return e.select(F.concat(F.lit("mem_"), F.col("event_id").cast("string")).alias("ref"), F.lit("fact").alias("kind"), scope.alias("scope"),
                    F.concat(F.lit("s"), user).alias("session_id"), F.concat(F.lit("/p"), F.floor(F.col("user_id") / 10).cast("string")).alias("project_path"),
                    F.concat(F.lit("user"), user).alias("subject"), F.col("event_type").alias("predicate"), F.col("value").cast("string").alias("object"),
                    F.lit(None).cast("string").alias("rule"), F.col("ts").alias("valid_from"))


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Facts with their end, their size and how often they were read (the hour of the day)."""
    m = memory.supersede(facts(spark, sf))
    return m.withColumns({"token_est": memory.entry_tokens(), "access_count": F.hour("valid_from"), "created_at": F.col("valid_from")})


@register("memory_supersede", f"WITH {FACTS_SQL} SELECT ref, epoch_us(valid_until) AS until_us, superseded_by FROM mem")
def memory_supersede(spark: SparkSession, sf: str) -> DataFrame:
    return memory.supersede(facts(spark, sf)).select("ref", micros("valid_until").alias("until_us"), "superseded_by")


@register("memory_tombstones", f"""
WITH {FACTS_SQL}, gone AS (SELECT ref, valid_from + INTERVAL 1 DAY AS forgotten_at FROM facts WHERE predicate = 'view')
SELECT ref, epoch_us(least(valid_until, forgotten_at)) AS until_us,
       CASE WHEN forgotten_at IS NULL OR forgotten_at >= valid_until THEN superseded_by END AS superseded_by FROM mem LEFT JOIN gone USING (ref)""")
def memory_tombstones(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf)
    gone = rows.where("predicate = 'view'").select("ref", (F.col("valid_from") + F.make_dt_interval(F.lit(1))).alias("forgotten_at"))
    return memory.supersede(rows, gone).select("ref", micros("valid_until").alias("until_us"), "superseded_by")


@register("memory_asof", f"""
WITH {FACTS_SQL} SELECT ref, subject, predicate, object FROM mem
WHERE valid_from <= TIMESTAMP '2024-01-15 00:00:00' AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-01-15 00:00:00')""")
def memory_asof(spark: SparkSession, sf: str) -> DataFrame:
    t = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return memory.supersede(facts(spark, sf)).where(memory.valid_at(t)).select("ref", "subject", "predicate", "object")


@register("memory_asof_join", """
WITH v AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase'),
p AS (SELECT event_id AS probe, user_id, ts FROM events WHERE event_type = 'view')
SELECT probe, p.user_id, v.event_id AS purchase_id, v.value AS purchase_value FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def memory_asof_join(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("t", micros("ts"))
    versions = e.where("event_type = 'purchase'").select("user_id", "t", "event_id", "value")
    probes = e.where("event_type = 'view'").select(F.col("event_id").alias("probe"), "user_id", "t")
    out = ordered.as_of(probes, versions, ["user_id"], F.col("t"), F.col("t"), ["event_id", "value"], "v")
    return out.select("probe", "user_id", F.col("v.event_id").alias("purchase_id"), F.col("v.value").alias("purchase_value"))


_LINE = "subject || ' ' || predicate || ' ' || object"
# DuckDB and Spark print doubles alike here: values have two decimals
@register("memory_recall_scoped", f"""
WITH {FACTS_SQL},
live AS (SELECT *, hour(valid_from) AS access_count FROM mem WHERE valid_until IS NULL
         AND (scope = 'global' OR (scope = 'session' AND session_id = 's7') OR (scope = 'project' AND project_path = '/p0'))),
asked AS (SELECT n_nationkey AS query_id, CASE WHEN n_nationkey < 10 THEN 'user' || n_nationkey WHEN n_nationkey < 15 THEN 'purch view'
                 WHEN n_nationkey < 20 THEN 'ser1 sign' ELSE '' END AS text FROM nation),
w AS (SELECT query_id, ref FROM live, asked WHERE text <> '' AND len(list_filter(string_split(text, ' '), lambda q:
        len(list_filter(regexp_split_to_array(lower({_LINE}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '' AND starts_with(t, q))) > 0)) > 0),
l AS (SELECT query_id, ref FROM live, asked WHERE text <> '' AND (contains(subject, text) OR contains(predicate, text) OR contains(object, text))
        AND query_id NOT IN (SELECT query_id FROM w)),
e AS (SELECT query_id, ref FROM live, asked WHERE text = ''),
r AS (SELECT query_id, ref, row_number() OVER (PARTITION BY query_id ORDER BY access_count DESC, valid_from DESC, ref) AS rank, {_LINE} AS line
      FROM (FROM w UNION ALL FROM l UNION ALL FROM e) JOIN live USING (ref) QUALIFY rank <= 10),
c AS (SELECT *, strlen(line) // 4 AS tokens, sum(strlen(line) // 4) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS cum_tokens FROM r)
SELECT query_id, rank, ref, line, tokens, cum_tokens FROM c WHERE cum_tokens <= 30 OR rank = 1""")
def memory_recall_scoped(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    text = (F.when(n < 10, F.concat(F.lit("user"), n.cast("string"))).when(n < 15, "purch view").when(n < 20, "ser1 sign").otherwise(""))
    asked = table(spark, sf, "nation").select(n.cast("long").alias("query_id"), text.alias("text"))
    out = memory.recall(entries(spark, sf), asked, scope=memory.in_scope("", "s7", "/p0"), limit=10, budget=30)
    return out.drop("valid_until")


@register("memory_vector_recall", f"""
WITH {FACTS_SQL},
live AS (SELECT *, hour(valid_from) AS access_count FROM mem WHERE valid_until IS NULL
         AND (scope = 'global' OR (scope = 'session' AND session_id = 's7') OR (scope = 'project' AND project_path = '/p0'))),
asked AS (SELECT n_nationkey AS query_id, CASE WHEN n_nationkey < 18 THEN 'zq' || n_nationkey || 'x' ELSE 'user' || n_nationkey END AS text FROM nation),
w AS (SELECT query_id, ref FROM live, asked WHERE len(list_filter(regexp_split_to_array(lower({_LINE}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '' AND starts_with(t, text))) > 0),
l AS (SELECT query_id, ref FROM live, asked WHERE (contains(subject, text) OR contains(predicate, text) OR contains(object, text)) AND query_id NOT IN (SELECT query_id FROM w)),
near AS (SELECT query_id, ref, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, ref) AS place
         FROM (SELECT query_id, ref, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS similarity
               FROM asked JOIN embeddings q ON q.vec_id = query_id, live JOIN embeddings e ON e.vec_id = live.event_id % 500)
         QUALIFY place <= 10),
v AS (SELECT query_id, ref FROM near WHERE query_id NOT IN (SELECT query_id FROM w) AND query_id NOT IN (SELECT query_id FROM l)),
r AS (SELECT query_id, ref, row_number() OVER (PARTITION BY query_id ORDER BY access_count DESC, valid_from DESC, ref) AS rank, {_LINE} AS line
      FROM (FROM w UNION ALL FROM l UNION ALL FROM v) JOIN live USING (ref) QUALIFY rank <= 5),
c AS (SELECT *, strlen(line) // 4 AS tokens, sum(strlen(line) // 4) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS cum_tokens FROM r)
SELECT query_id, rank, ref, line, tokens, cum_tokens FROM c WHERE cum_tokens <= 40 OR rank = 1""")
def memory_vector_recall(spark: SparkSession, sf: str) -> DataFrame:
    n, vecs = F.col("n_nationkey"), table(spark, sf, "embeddings")
    text = F.when(n < 18, F.concat(F.lit("zq"), n.cast("string"), F.lit("x"))).otherwise(F.concat(F.lit("user"), n.cast("string")))
    asked = table(spark, sf, "nation").select(n.cast("long").alias("query_id"), text.alias("text"))
    asked = asked.join(vecs.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")
    known = entries(spark, sf)
    numbered = known.select(F.col("ref").alias("ident"), F.col("ref").alias("content_hash"), F.pmod(F.substr("ref", F.lit(5)).cast("long"), F.lit(500)).alias("vec_id"))
    stored = numbered.join(vecs, "vec_id").select("content_hash", "embedding", F.lit("memory").alias("doc_type"), entities.entity_key("memory", F.col("ident")).alias("source_file"))
    vectors = entities.current_vectors("memory", stored, numbered.select("ident", "content_hash")).select(F.col("ident").alias("vec_ref"), "embedding")
    out = memory.recall(known, asked, scope=memory.in_scope("", "s7", "/p0"), limit=5, budget=40, vectors=vectors, dims=64)
    return out.drop("valid_until")


@register("memory_inventory", f"""
WITH {FACTS_SQL}, clock AS (SELECT max(ts) AS now FROM events)
SELECT count(*) FILTER (valid_until IS NULL) AS active_facts, 0 AS active_procedures,
  coalesce(sum(strlen({_LINE}) // 4) FILTER (valid_until IS NULL), 0)::BIGINT AS active_tokens,
  count(*) FILTER (valid_until IS NULL AND hour(valid_from) = 0) AS orphan_count,
  count(*) FILTER (valid_from >= now - INTERVAL 10 DAY) AS stored_in_window,
  (SELECT count(*) FROM events, clock WHERE event_type = 'view' AND ts >= now - INTERVAL 10 DAY) AS recalled_in_window
FROM mem, clock""")
def memory_inventory(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    accesses = e.where("event_type = 'view'").select(F.col("ts").alias("accessed_at"))
    return memory.inventory(entries(spark, sf), accesses, e.agg(F.max("ts").alias("n")).scalar(), 10)


@register("extract_facts", r"""
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM conversations),
c AS (SELECT conv_id, turn, line_no, regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '^[-*• ]+', '') AS s FROM l),
w AS (SELECT *, regexp_split_to_array(s, '\s+') AS f, regexp_extract(s, '(?s)^([^:]+):(.+)$', 1) AS k, regexp_replace(regexp_extract(s, '(?s)^([^:]+):(.+)$', 2), '^\s+|\s+$', '', 'g') AS v FROM c WHERE s <> '')
SELECT conv_id, turn, line_no, 'fact' AS kind, CASE WHEN v <> '' AND NOT contains(k, ' ') THEN k ELSE f[1] END AS subject,
       CASE WHEN v <> '' AND NOT contains(k, ' ') THEN 'is' ELSE f[2] END AS predicate,
       CASE WHEN v <> '' AND NOT contains(k, ' ') THEN v ELSE array_to_string(f[3:], ' ') END AS object
FROM w WHERE len(f) >= 3 OR (v <> '' AND NOT contains(k, ' '))""")
def extract_facts(spark: SparkSession, sf: str) -> DataFrame:
    return memory.extract_entries(table(spark, sf, "conversations"), "text", ["conv_id", "turn"]).drop("rule")


# --- notes -------------------------------------------------------------------------------------

NOTES_SQL = """
notes AS (SELECT 'ctx_' || substr(sha256(conv_id || chr(1) || turn), 1, 12) AS ref, 'c' || conv_id AS session_id, role AS label, text AS content,
                 turn AS created_at, turn AS pos, 0 AS access_count, strlen(text) // 4 AS token_est FROM conversations)"""


def note_table(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(stable_ref("ctx_", "conv_id", "turn").alias("ref"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"),
                    F.col("role").alias("label"), F.col("text").alias("content"), F.col("turn").alias("created_at"), F.col("turn").alias("pos"),
                    F.lit(0).alias("access_count"), token_estimate("text").alias("token_est"))


@register("notes_list", f"""
WITH {NOTES_SQL} SELECT ref, session_id, label, token_est, rank, total FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, ref DESC) AS rank,
  count(*) OVER (PARTITION BY session_id) AS total FROM notes) WHERE rank <= 3""")
def notes_list(spark: SparkSession, sf: str) -> DataFrame:
    return notes.list_notes(note_table(spark, sf), 3).select("ref", "session_id", "label", "token_est", "rank", "total")


@register("notes_search", f"""
WITH {NOTES_SQL},
asked AS (SELECT item_id AS query_id, text,
                 CASE WHEN item_id < 10 THEN '' ELSE 'c' || item_id END AS session_id FROM benchmark),
{request_terms_sql('asked', 'query_id')},
words AS (SELECT ref, session_id, created_at, unnest(list_distinct(list_filter(regexp_split_to_array(lower(label || ' ' || content), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''))) AS term FROM notes),
hit AS (SELECT DISTINCT q.query_id, w.ref, w.created_at FROM words w JOIN qterms q ON starts_with(w.term, q.prefix) JOIN asked a ON a.query_id = q.query_id
        WHERE a.session_id IN ('', w.session_id)),
lk AS (SELECT a.query_id, n.ref, n.created_at FROM notes n JOIN asked a ON a.session_id IN ('', n.session_id)
       WHERE (contains(lower(n.label), lower(a.text)) OR contains(lower(n.content), lower(a.text))) AND a.query_id NOT IN (SELECT query_id FROM hit)),
s AS (SELECT *, 1.0::DOUBLE AS score FROM hit UNION ALL SELECT *, 0.5 FROM lk)
SELECT query_id, ref, score, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, ref DESC) AS rank FROM s QUALIFY rank <= 5""")
def notes_search(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("query_id")
    asked = texts(spark, sf).withColumn("session_id", F.when(i < 10, "").otherwise(F.concat(F.lit("c"), i.cast("string"))))
    return notes.search_notes(note_table(spark, sf), asked, 5)


@register("note_hybrid", f"""
WITH {NOTES_SQL},
asked AS (SELECT item_id AS query_id, text, CASE WHEN item_id < 10 THEN '' ELSE 'c' || item_id END AS session_id FROM benchmark),
{request_terms_sql('asked', 'query_id')},
words AS (SELECT ref, session_id, created_at, unnest(list_distinct(list_filter(regexp_split_to_array(lower(label || ' ' || content), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''))) AS term FROM notes),
hit AS (SELECT DISTINCT q.query_id, w.ref, w.created_at FROM words w JOIN qterms q ON starts_with(w.term, q.prefix) JOIN asked a ON a.query_id = q.query_id
        WHERE a.session_id IN ('', w.session_id)),
lk AS (SELECT a.query_id, n.ref, n.created_at FROM notes n JOIN asked a ON a.session_id IN ('', n.session_id)
       WHERE (contains(lower(n.label), lower(a.text)) OR contains(lower(n.content), lower(a.text))) AND a.query_id NOT IN (SELECT query_id FROM hit)),
txt AS (SELECT query_id, ref, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, ref DESC) AS rank FROM (FROM hit UNION ALL FROM lk) QUALIFY rank <= 10),
vec AS (SELECT query_id, ref, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, ref) AS rank
        FROM (SELECT a.query_id, n.ref, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS similarity
              FROM asked a JOIN embeddings q ON q.vec_id = a.query_id JOIN notes n ON a.session_id IN ('', n.session_id)
              JOIN embeddings e ON e.vec_id = (substr(n.session_id, 2)::BIGINT * 7 + n.created_at) % 500) QUALIFY rank <= 10),
f AS (SELECT query_id, ref, round(sum(1.0 / (60 + rank)), 12) AS score FROM (FROM txt UNION ALL FROM vec) GROUP BY ALL)
SELECT query_id, ref, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref) AS rank FROM f QUALIFY rank <= 5""")
def note_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    known, vecs, i = note_table(spark, sf), table(spark, sf, "embeddings"), F.col("query_id")
    asked = requests(spark, sf).withColumn("session_id", F.when(i < 10, "").otherwise(F.concat(F.lit("c"), i.cast("string"))))
    live = known.select(F.col("ref").alias("ident"), F.col("ref").alias("content_hash"), "session_id",
                        F.pmod(F.substr("session_id", F.lit(2)).cast("long") * 7 + F.col("created_at"), F.lit(500)).alias("vec_id"))
    stored = live.join(vecs, "vec_id").select("content_hash", "embedding", F.lit("note").alias("doc_type"), entities.entity_key("note", F.col("ident")).alias("source_file"))
    vectors = entities.current_vectors("note", stored, live.drop("vec_id"))
    near = entities.nearest_in_session(vectors, asked, 10, 64).withColumnRenamed("id", "ref")
    return notes.search_notes(known, asked, 5, near)


@register("notes_quota", f"""
WITH {NOTES_SQL} SELECT session_id, count(*) AS notes_count, sum(token_est)::BIGINT AS tokens_stored, count(*) || '/50' AS notes_quota,
  sum(token_est) || '/32000' AS tokens_quota FROM notes GROUP BY ALL""")
def notes_quota(spark: SparkSession, sf: str) -> DataFrame:
    return usage.session_quota(note_table(spark, sf), 50, 32000)


@register("notes_inventory", f"WITH {NOTES_SQL} SELECT count(*) AS active_notes_count, sum(token_est)::BIGINT AS active_inventory_tokens, count(*) AS orphan_notes_count FROM notes")
def notes_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return usage.note_inventory(note_table(spark, sf))


@register("notes_lru", f"""
WITH {NOTES_SQL}, r AS (SELECT *, row_number() OVER w AS age_rank, sum(token_est) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS kept_tokens FROM notes WHERE token_est <= 600
  WINDOW w AS (PARTITION BY session_id ORDER BY created_at DESC, access_count DESC, ref DESC))
SELECT ref, session_id, age_rank, kept_tokens FROM r WHERE age_rank <= 6 AND kept_tokens <= 600""")
def notes_lru(spark: SparkSession, sf: str) -> DataFrame:
    return notes.keep_newest(note_table(spark, sf), LIMITS).select("ref", "session_id", "age_rank", "kept_tokens")


@register("notes_admission", f"""
WITH RECURSIVE {NOTES_SQL},
o AS (SELECT ref, session_id, token_est, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS n FROM notes),
f AS (SELECT session_id, 0::BIGINT AS n, 0::BIGINT AS cnt, 0::BIGINT AS used, NULL::VARCHAR AS ref, NULL::VARCHAR AS refused_by, false AS admitted FROM (SELECT DISTINCT session_id FROM notes)
      UNION ALL
      SELECT o.session_id, o.n, f.cnt + ok::INT, f.used + CASE WHEN ok THEN o.token_est ELSE 0 END, o.ref,
             CASE WHEN ok THEN NULL WHEN o.token_est > 600 THEN 'single_note_tokens' WHEN f.cnt >= 6 THEN 'session_notes' ELSE 'session_tokens' END, ok
      FROM (SELECT f.*, o.ref AS oref, o.token_est AS t, f.cnt < 6 AND f.used + o.token_est <= 600 AS ok FROM f JOIN o ON o.session_id = f.session_id AND o.n = f.n + 1) f
      JOIN o ON o.ref = f.oref)
SELECT ref, session_id, admitted, refused_by FROM f WHERE n > 0""")
def notes_admission(spark: SparkSession, sf: str) -> DataFrame:
    return notes.admit(note_table(spark, sf), LIMITS).select("ref", "session_id", "admitted", "refused_by")


@register("notes_admission_global", f"""
WITH RECURSIVE {NOTES_SQL},
o AS (SELECT ref, session_id, token_est::BIGINT AS size, row_number() OVER (ORDER BY pos, session_id, ref) AS n FROM notes),
f AS (SELECT 0::BIGINT AS n, NULL::VARCHAR AS ref, NULL::VARCHAR AS session_id, NULL::VARCHAR AS why, 0::BIGINT AS cnt, 0::BIGINT AS used,
             MAP {{'': {{'c': 0::BIGINT, 't': 0::BIGINT}}}} AS s
      UNION ALL
      SELECT n, ref, session_id, why, cnt + (why IS NULL)::INT, used + CASE WHEN why IS NULL THEN size ELSE 0 END,
             CASE WHEN why IS NULL THEN map_concat(s, MAP {{session_id: {{'c': c + 1, 't': t + size}}}}) ELSE s END
      FROM (SELECT *, CASE WHEN size > 600 THEN 'single_note_tokens' WHEN c >= 6 THEN 'session_notes' WHEN t + size > 600 THEN 'session_tokens'
                           WHEN cnt >= 300 THEN 'global_notes' WHEN used + size > 12000 THEN 'global_tokens' END AS why
            FROM (SELECT o.*, f.cnt, f.used, f.s, coalesce(f.s[o.session_id].c, 0) AS c, coalesce(f.s[o.session_id].t, 0) AS t FROM f JOIN o ON o.n = f.n + 1)))
SELECT ref, session_id, why IS NULL AS admitted, why AS refused_by FROM f WHERE n > 0""")
def notes_admission_global(spark: SparkSession, sf: str) -> DataFrame:
    arriving = note_table(spark, sf).withColumn("pos", F.col("pos").cast("long")).withColumn("held", F.lit(False))
    caps = notes.Limits(LIMITS.session_notes, LIMITS.session_tokens, 300, 12_000)
    return notes.admit_globally(arriving, caps).select("ref", "session_id", "admitted", "refused_by")


# --- sequences ---------------------------------------------------------------------------------

@register("session_dedup", """
SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def session_dedup(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    return changes.first_seen(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@register("debounce", """
SELECT user_id, event_id, event_type FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events)
WHERE nx IS NULL OR epoch_us(nx) - epoch_us(ts) >= 3600000000""")
def debounce(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return changes.debounce(e, ["user_id"], "ts", "event_id", 3600).select("user_id", "event_id", "event_type")


@register("session_idle", """
WITH p AS (SELECT *, lag(ts) OVER w AS pv, lag(event_type) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum((pv IS NULL OR epoch_us(ts) - epoch_us(pv) > CASE WHEN pt = 'purchase' THEN 3 ELSE 1 END * 7200000000)::INT)
             OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM p)
SELECT user_id, session_no, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS events FROM s GROUP BY ALL""")
def session_idle(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    gap = F.when(F.col("event_type") == "purchase", 3 * 7200).otherwise(7200)
    out = changes.idle_sessions(e, ["user_id"], "ts", "event_id", gap)
    return out.select("user_id", "session_no", micros("session_start").alias("start_us"), micros("session_end").alias("end_us"), "events")
