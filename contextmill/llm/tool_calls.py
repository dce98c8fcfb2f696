"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

Calls and results are hash-joined by (conversation, identifier). A call's level is one more than the highest level among the
calls it needs; levels come from peeling calls whose needs are all met, round by round, over what is left. Arguments
are parsed as JSON and checked against the tool's schema. Each call becomes one JSON object with sorted keys. One row per
call: a conversation is never gathered, so one with a third of all rows is no task of its own; sorting by (level, turn,
call_id) gives the order within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..plans.catalogue import Catalogue
from .common import cut, table

CATALOGUE = Catalogue()
#: tool -> argument -> (JSON type, required). Types are STRING, BIGINT, DOUBLE, BOOLEAN, ARRAY, OBJECT.
Schemas = dict[str, dict[str, tuple[str, bool]]]
KEY = ["conv_id", "call_id"]


def _kind_matches(found: Column, wanted: str) -> Column:
    if wanted == "DOUBLE":
        return found.rlike("^(DOUBLE|FLOAT|BIGINT|DECIMAL.*)$")
    return found.startswith(wanted) if wanted in ("ARRAY", "OBJECT") else found == wanted


def problems_of(tool: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted complaints about a map<string,variant>: unknown tools, missing, unknown and wrongly typed arguments; 'not an object' for null."""
    known = F.lit(False)
    checks = F.array(F.concat(F.lit("unknown tool "), F.coalesce(tool, F.lit("null"))))
    for name, fields in schemas.items():
        one = []
        for field, (kind, required) in fields.items():
            value = F.element_at(arguments, field)
            found = F.schema_of_variant(value)
            wrong = F.when(value.isNotNull() & ~_kind_matches(found, kind), F.lit(f"{field} is not {kind.lower()}"))
            one.append(F.when(~F.map_contains_key(arguments, F.lit(field)), F.lit(f"{field} is missing")).otherwise(wrong) if required else wrong)
        extra = F.transform(F.array_except(F.map_keys(arguments), F.array(*[F.lit(f) for f in fields])), lambda k: F.concat(k, F.lit(" is unknown")))
        checks = F.when(tool == name, F.concat(F.array_compact(F.array(*one)), extra)).otherwise(checks)
        known = known | (tool == name)
    return F.array_sort(F.when(known & arguments.isNull(), F.array(F.lit("not an object"))).otherwise(checks))


def _jumps(single: DataFrame) -> DataFrame:
    """(conv_id, call_id, anchor, far): from calls with one need (conv_id, call_id, anchor) to the first call up the chain that has not
    exactly one, and how far it is. Distances double each round; calls on or behind a cycle of such calls are left out."""
    jumps = cut(single.withColumn("far", F.lit(1).cast("long")))
    before = -1
    while True:
        # (calls still on their way, all steps taken): on a cycle steps go on for ever, but the number on their way stands still
        ahead = jumps.select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("further"), F.col("far").alias("more"))
        moved = jumps.join(ahead.hint("merge"), ["conv_id", "anchor"], "left")
        jumps = cut(moved.select(*KEY, F.coalesce("further", "anchor").alias("anchor"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("more").isNotNull().alias("way")))
        on_way = jumps.where("way").count()
        if on_way in (0, before):
            return jumps.where("NOT way").drop("way")
        before, jumps = on_way, jumps.drop("way")


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): calls on a cycle, or behind one, have a null level. needs has (conv_id, call_id, needed).

    Chains of calls with one need each are jumped over in as many rounds as their length has binary digits; what is left, calls with
    several needs, is peeled round by round.
    """
    calls = calls.select(*KEY)
    wanted = needs.join(calls.select("conv_id", F.col("call_id").alias("needed")).hint("merge"), ["conv_id", "needed"], "left_semi").groupBy(*KEY).agg(F.collect_set("needed").alias("open"))
    state = cut(calls.join(wanted.hint("merge"), KEY, "left").select(*KEY, F.coalesce("open", F.array().cast("array<string>")).alias("open")))
    jumps = _jumps(state.where(F.size("open") == 1).select(*KEY, F.get("open", F.lit(0)).alias("anchor")))
    known = state.where(F.size("open") == 0).select(*KEY, F.lit(0).cast("long").alias("level"))
    # each need of a joint, a call with several, as the joint or root up its chain and the distance there; its own chain counts one more
    joints = state.where(F.size("open") > 1).select(*KEY, F.explode("open").alias("needed"))
    via = jumps.select("conv_id", F.col("call_id").alias("needed"), "anchor", "far")
    ends = state.where(F.size("open") != 1).select("conv_id", F.col("call_id").alias("needed"), F.lit(True).alias("end"))
    waits = cut(joints.join(via.hint("merge"), ["conv_id", "needed"], "left").join(ends.hint("merge"), ["conv_id", "needed"], "left").select(
        *KEY, F.coalesce("anchor", F.when(F.col("end"), F.col("needed"))).alias("anchor"), (F.coalesce("far", F.lit(0)) + 1).alias("far"), F.lit(None).cast("long").alias("met")))
    fresh = known
    while not waits.isEmpty():
        heard = fresh.select("conv_id", F.col("call_id").alias("anchor"), "level")
        waits = cut(waits.join(heard.hint("merge"), ["conv_id", "anchor"], "left").select(*KEY, "anchor", "far", F.coalesce("met", F.col("level") + F.col("far")).alias("met")))
        per = waits.groupBy(*KEY).agg(F.count("*").alias("n"), F.count("met").alias("m"), F.max("met").alias("level"))
        fresh = cut(per.where("n = m").select(*KEY, "level"))
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)
        waits = waits.join(fresh.select(*KEY).hint("merge"), KEY, "left_anti")
    up = known.select("conv_id", F.col("call_id").alias("anchor"), "level")
    chained = jumps.join(up.hint("merge"), ["conv_id", "anchor"]).select(*KEY, (F.col("level") + F.col("far")).alias("level"))
    found = known.unionByName(chained)
    return calls.join(found.hint("merge"), KEY, "left").select(*KEY, F.col("level").cast("int").alias("level"))


def link_tool_calls(calls: DataFrame, results: DataFrame, needs: DataFrame, schemas: Schemas) -> DataFrame:
    """(conv_id, turn, call_id, tool, level, status, problems, json): one row per call and per result without a call.

    calls has (conv_id, turn, call_id, tool, arguments), arguments being JSON text; results has (conv_id, turn, call_id, content);
    needs has (conv_id, call_id, needed). status is 'linked', 'unanswered', 'cycle' (no order exists), 'repeated' (an
    earlier turn, or on equal turns an earlier tool or arguments, has the same identifier; such a call is not linked) or 'orphan' (a
    result without call, or not the first of its call). Needs of calls that do not exist are void. Null identifiers link nothing.
    Malformed JSON and JSON that is no object is a problem, not an error. Other columns are ignored; empty tables
    give empty results. Keys are sorted at the top level of the object and of the arguments.
    """
    by_key = W.partitionBy(*KEY)
    asked = calls.select("conv_id", "turn", "call_id", "tool", "arguments", F.row_number().over(by_key.orderBy("turn", "tool", "arguments")).alias("nth"))
    asked = asked.withColumn("args", F.expr("try_cast(try_parse_json(arguments) AS map<string, variant>)"))
    sorted_args = F.map_from_entries(F.transform(F.array_sort(F.map_keys("args")), lambda k: F.struct(k, F.element_at(F.col("args"), k))))
    # parsed and checked once; what follows moves plain text
    asked = cut(asked.select(
        "conv_id", "turn", "call_id", "tool", F.to_json(sorted_args).alias("args"), problems_of(F.col("tool"), F.col("args"), schemas).alias("problems"),
        F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), 1).otherwise(F.col("nth")).alias("nth")))
    first = asked.where("nth = 1")
    answers = results.select("conv_id", F.col("turn").alias("answered"), "call_id", "content").withColumn(
        "rank", F.row_number().over(by_key.orderBy("answered", "content")))
    named = first.where("conv_id IS NOT NULL AND call_id IS NOT NULL").select(*KEY)
    placed = first.join(answers.where("rank = 1").drop("rank"), KEY, "left").join(levels(named, needs.where("call_id IS NOT NULL AND needed IS NOT NULL")), KEY, "left")
    state = F.when(F.col("level").isNull() & F.col("call_id").isNotNull() & F.col("conv_id").isNotNull(), "cycle").when(F.col("answered").isNull(), "unanswered").otherwise("linked")
    rest = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result"), F.col("tool").alias("tool")))
    line = F.when(F.col("args").isNull(), rest).when(rest == "{}", F.concat(F.lit('{"arguments":'), "args", F.lit("}"))).otherwise(
        F.concat(F.lit('{"arguments":'), "args", F.lit(","), F.substr(rest, F.lit(2))))
    told = placed.select("conv_id", "turn", "call_id", "tool", "level", state.alias("status"), "problems", line.alias("json"))
    again = asked.where("nth > 1").withColumn("content", F.lit(None).cast("string")).select(
        "conv_id", "turn", "call_id", "tool", F.lit(None).cast("int").alias("level"), F.lit("repeated").alias("status"), "problems", line.alias("json"))
    lost = answers.join(named.withColumn("rank", F.lit(1)), [*KEY, "rank"], "left_anti")
    orphans = lost.select("conv_id", F.col("answered").alias("turn"), "call_id", F.lit(None).cast("string").alias("tool"), F.lit(None).cast("int").alias("level"),
                          F.lit("orphan").alias("status"), F.array().cast("array<string>").alias("problems"),
                          F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result"))).alias("json"))
    return told.unionByName(again).unionByName(orphans)


SCHEMAS: Schemas = {"answer": {"prompt": ("STRING", True), "turn": ("BIGINT", True)}, "configure": {"rules": ("STRING", True)}}


def calls_of_conversations(chats: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, needs): a user turn calls `answer`, a system turn `configure`; an assistant turn is the result of the call of the turn
    before it; a call needs those of the two turns before it."""
    call_id = lambda back: F.concat(F.lit("c"), (F.col("turn") - back).cast("string"))
    said = F.coalesce("text", F.lit(""))
    arguments = F.when(F.col("role") == "user", F.to_json(F.struct(said.alias("prompt"), "turn"))).otherwise(F.to_json(F.struct(said.alias("rules"))))
    tool = F.when(F.col("role") == "user", "answer").otherwise("configure")
    calls = chats.where(F.col("role").isin("user", "system")).select("conv_id", "turn", call_id(0).alias("call_id"), tool.alias("tool"), arguments.alias("arguments"))
    results = chats.where("role = 'assistant'").select("conv_id", "turn", call_id(1).alias("call_id"), F.col("text").alias("content"))
    needs = chats.where(F.col("role").isin("user", "system")).select("conv_id", call_id(0).alias("call_id"), F.explode(F.array(call_id(1), call_id(2))).alias("needed"))
    return calls, results, needs


SQL = """
WITH RECURSIVE c AS (SELECT conv_id, turn, 'c' || turn AS call_id, CASE WHEN role = 'user' THEN 'answer' ELSE 'configure' END AS tool, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id, turn ORDER BY CASE WHEN role = 'user' THEN 'answer' ELSE 'configure' END, text) AS nth
    FROM conversations WHERE role IN ('user', 'system')),
r AS (SELECT conv_id, turn, 'c' || (turn - 1) AS call_id, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS nth FROM conversations WHERE role = 'assistant'),
k AS (SELECT conv_id, turn FROM c WHERE nth = 1),
n AS (SELECT a.conv_id, a.turn, b.turn AS needed FROM k a JOIN k b ON a.conv_id = b.conv_id AND b.turn IN (a.turn - 1, a.turn - 2)),
l AS (SELECT conv_id, turn, 0 AS level FROM k UNION SELECT n.conv_id, n.turn, level + 1 FROM n JOIN l ON n.conv_id = l.conv_id AND n.needed = l.turn),
lv AS (SELECT conv_id, turn, max(level) AS level FROM l GROUP BY ALL),
j AS (SELECT c.*, '{"arguments":' || CASE WHEN tool = 'answer' THEN '{"prompt":' || to_json(text) || ',"turn":' || turn || '}' ELSE '{"rules":' || to_json(text) || '}' END
        || ',"id":"' || call_id || '"' AS head FROM c)
SELECT j.conv_id, j.turn, j.call_id, j.tool, CASE WHEN j.nth = 1 THEN level END AS level,
    CASE WHEN j.nth > 1 THEN 'repeated' WHEN r.turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status, 0 AS n_problems,
    head || CASE WHEN j.nth = 1 AND r.text IS NOT NULL THEN ',"result":' || to_json(r.text) ELSE '' END || ',"tool":"' || j.tool || '"}' AS json
FROM j LEFT JOIN lv USING (conv_id, turn) LEFT JOIN r ON j.nth = 1 AND r.nth = 1 AND j.conv_id = r.conv_id AND j.call_id = r.call_id
UNION ALL
SELECT r.conv_id, r.turn, r.call_id, NULL, NULL, 'orphan', 0, '{"id":"' || r.call_id || '"' || CASE WHEN r.text IS NULL THEN '' ELSE ',"result":' || to_json(r.text) END || '}'
FROM r LEFT JOIN c ON c.nth = 1 AND r.nth = 1 AND c.conv_id = r.conv_id AND c.call_id = r.call_id WHERE c.conv_id IS NULL
"""


@CATALOGUE.register("op6_tool_calls", SQL)
def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, needs = calls_of_conversations(table(spark, sf_dir, "conversations"))
    return link_tool_calls(calls, results, needs, SCHEMAS).select(
        "conv_id", "turn", "call_id", "tool", "level", "status", F.size("problems").alias("n_problems"), "json")
