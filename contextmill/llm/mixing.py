"""Mixing sources to target weights by hierarchical budgeting.

Documents hang in a tree domain > language > source. A token budget is pushed down the tree by weight. A child can
take at most its tokens times max_epochs; what it cannot take goes to its siblings by weight, and only what a
whole family cannot take has, by then, gone to the family's own siblings: a node's limit is the sum over its
leaves, so its budget never exceeds what its children can hold. A leaf's budget buys whole epochs and then a prefix
of one more epoch, in an order seeded by epoch and document.

That prefix ends at an order key per leaf. Cumulated tokens are found in equal buckets of the key range, so a
leaf with a third of all documents is spread over many tasks; only the one bucket where the budget ends is
sorted. Documents, with their texts, are then cut by comparing their own key; they are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..plans.catalogue import Catalogue
from .common import cut, table

CATALOGUE = Catalogue()
LEVELS = ("domain", "lang", "source")
DOMAINS = {"web": ("src0", "src1", "src2", "src3", "src4", "src5"), "reference": ("src6", "src7", "src8", "src9"),
           "books": ("src10", "src11", "src12"), "forums": ("src13", "src14", "src15", "src16")}
DOMAIN_WEIGHTS = {"web": 5, "reference": 3, "books": 2, "forums": 1}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1}
MAX_EPOCHS = 2
SEED = "mix-1"
SHARE = (1, 2)
ROWS_PER_BUCKET = 20_000
#: A leaf row is under 300 bytes; up to this many leaves are broadcast, more are joined by shuffle.
MAX_BROADCAST_LEAVES = 100_000
EXACT = "decimal(38,0)"


def n_tokens(text: Column) -> Column:
    """Bytes / 4, rounded up; null has none."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def _mapped(column: Column, pairs: dict[str, object], other: object) -> Column:
    out = F.lit(other)
    for key, value in pairs.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def order_key(doc: Column, epoch: Column, seed: str) -> Column:
    """Place of a document in an epoch's order: 60 bits of a seeded hash."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _share_out(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """Adds given: the part of `budget` each child of a parent gets. Needs weight and limit per child."""
    family = W.partitionBy(*parents)
    # shortest rations first: a child is full when even the equal level of all later children covers its limit
    ordered = family.orderBy((F.col("limit") / F.col("weight")), *[c for c in LEVELS if c not in parents and c in nodes.columns])
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)).cast(EXACT)
    ranked = nodes.select("*", total("weight", family).alias("_w"), total("limit", before).alias("_kb"), total("weight", before).alias("_wb"))
    full = F.col("limit").cast(EXACT) * (F.col("_w") - F.col("_wb")).cast("decimal(19,0)") <= F.col("weight").cast(EXACT) * (F.col("budget") - F.col("_kb")).cast("decimal(19,0)")
    marked = ranked.select("*", full.alias("_full"))
    marked = marked.select("*", total(F.when(F.col("_full"), F.col("limit")), family).alias("_kf"), total(F.when(F.col("_full"), F.col("weight")), family).alias("_wf"))
    rest = F.expr("(cast(weight AS decimal(19,0)) * cast(budget - _kf AS decimal(19,0))) div cast(_w - _wf AS decimal(19,0))")
    return marked.select(*nodes.columns, F.when(F.col("_full"), F.col("limit")).otherwise(rest).cast("long").alias("given"))


def leaf_budgets(leaves: DataFrame, budget: int, max_epochs: int, domain_weights: dict[str, int], lang_weights: dict[str, int],
                 source_weights: dict[str, int]) -> DataFrame:
    """(domain, lang, source, n, tokens, given) from (domain, lang, source, n, tokens)."""
    weights = {"domain": domain_weights, "lang": lang_weights, "source": source_weights}
    leaves = leaves.where("tokens > 0").withColumn("limit", F.col("tokens") * max_epochs)
    level, parents = None, []
    for name in LEVELS:
        here = [*parents, name]
        nodes = leaves.groupBy(*here).agg(F.sum("limit").cast("long").alias("limit"), F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", _mapped(F.col(name), weights[name], 1).cast("long"))
        if level is None:
            all_limits = W.partitionBy()
            nodes = nodes.withColumn("budget", F.least(F.lit(budget), F.sum("limit").over(all_limits)).cast("long"))
            nodes = _share_out(nodes.withColumn("root", F.lit(1)), ["root"]).drop("root")
        else:
            nodes = _share_out(nodes.join(level.select(*parents, F.col("given").alias("budget")), parents), parents)
        level, parents = nodes.drop("budget", "weight"), here
    return level.select(*LEVELS, "n", "tokens", "given")


def mix(documents: DataFrame, budget_share: tuple[int, int] = SHARE, domains: dict[str, tuple[str, ...]] = DOMAINS,
        domain_weights: dict[str, int] = DOMAIN_WEIGHTS, lang_weights: dict[str, int] = LANG_WEIGHTS,
        source_weights: dict[str, int] | None = None, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
        rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """documents with domain, n_tokens and epoch: one row per drawn document and epoch.

    The budget is budget_share of all tokens. Weights are whole numbers from 1; a domain, language or source without
    one has 1, a source in no domain is in 'other', null languages and sources are families of their own ('').
    Texts without tokens (null, empty) are never drawn. Repeated ids share an order key and are drawn together or not
    at all. Columns named domain, n_tokens or epoch in documents are replaced; others stay. Nothing is drawn
    from an empty table.
    """
    plain = documents.drop("domain", "n_tokens", "epoch", "_lang", "_source")
    source_of = {s: d for d, sources in domains.items() for s in sources}
    docs = plain.select("*", F.coalesce("lang", F.lit("")).alias("_lang"), F.coalesce("source", F.lit("")).alias("_source"),
                        _mapped(F.col("source"), source_of, "other").alias("domain"), n_tokens(F.col("text")).alias("n_tokens"))
    narrow = docs.where("n_tokens > 0").select("domain", F.col("_lang").alias("lang"), F.col("_source").alias("source"), "doc_id", "n_tokens")
    leaves = cut(narrow.groupBy(*LEVELS).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")))
    stats = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count("*").alias("leaves")).first()
    budget = stats["tokens"] * budget_share[0] // budget_share[1]
    near = (lambda df: F.broadcast(df)) if stats["leaves"] <= MAX_BROADCAST_LEAVES else (lambda df: df)
    given = leaf_budgets(leaves, budget, max_epochs, domain_weights, lang_weights, source_weights or {})
    plan = cut(given.select(*LEVELS, "tokens", F.expr("given div tokens").alias("whole"), F.expr("given % tokens").alias("rest"),
                            F.ceil(F.col("n") / rows_per_bucket).cast("long").alias("buckets")))

    # where the last, partial epoch of each leaf ends
    width = F.expr("1152921504606846976 div buckets + 1")
    keyed = narrow.join(near(plan.where("rest > 0")), list(LEVELS)).select(
        *LEVELS, "n_tokens", "rest", order_key(F.col("doc_id"), F.col("whole"), seed).alias("key"), width.alias("width"))
    keyed = keyed.select("*", F.expr("key div width").alias("bucket"))
    sums = keyed.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("n_tokens").alias("t"), F.max("key").alias("last"))
    running = F.sum("t").over(W.partitionBy(*LEVELS).orderBy("bucket"))
    sums = cut(sums.select(*LEVELS, "bucket", "rest", "last", "t", running.alias("cum")))
    inside = sums.where((F.col("cum") > F.col("rest")) & (F.col("cum") - F.col("t") <= F.col("rest"))).select(
        *LEVELS, "bucket", (F.col("rest") - F.col("cum") + F.col("t")).alias("left"))
    edge = keyed.join(near(inside), [*LEVELS, "bucket"]).select(
        *LEVELS, "key", "left", F.sum("n_tokens").over(W.partitionBy(*LEVELS).orderBy("key")).alias("cum"))
    ends = (sums.where("cum <= rest").select(*LEVELS, F.col("last").alias("key"))
            .unionByName(edge.where("cum <= left").select(*LEVELS, "key")).groupBy(*LEVELS).agg(F.max("key").alias("end")))
    plan = cut(plan.join(ends, list(LEVELS), "left").select(
        F.col("domain"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), "whole", F.coalesce("end", F.lit(-1)).alias("end")))

    drawn = docs.where("n_tokens > 0").join(near(plan), ["domain", "_lang", "_source"])
    last = F.when(order_key(F.col("doc_id"), F.col("whole"), seed) <= F.col("end"), F.array(F.col("whole"))).otherwise(F.array().cast("array<bigint>"))
    whole = F.when(F.col("whole") > 0, F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).otherwise(F.array().cast("array<bigint>"))
    return drawn.select(*plain.columns, "domain", "n_tokens", F.explode(F.concat(whole, last)).alias("epoch"))


def _case(column: str, pairs: dict[str, object], other: str) -> str:
    return "CASE " + column + "".join(f" WHEN '{k}' THEN {v!r}" for k, v in pairs.items()) + f" ELSE {other} END"


def _level_sql(name: str, here: str, parents: str, weight: str, budget_from: str) -> str:
    on = f"PARTITION BY {parents}" if parents else ""
    cond = f"JOIN {budget_from}_out b USING ({parents})" if parents else ""
    budget = "b.given" if parents else f"least((SELECT sum(tokens) * {SHARE[0]} // {SHARE[1]} FROM leaves), sum(sum(l.tokens) * {MAX_EPOCHS}) OVER ())"
    extra = ", b.given" if parents else ""
    return f"""
{name}_in AS (SELECT {here}, sum(l.tokens)::HUGEINT AS tokens, (sum(l.tokens) * {MAX_EPOCHS})::HUGEINT AS lim, ({weight})::HUGEINT AS weight, ({budget})::HUGEINT AS budget
    FROM leaves l {cond} GROUP BY {here}{extra}),
{name}_rank AS (SELECT *, sum(weight) OVER ({on}) AS w, coalesce(sum(lim) OVER o, 0) AS kb, coalesce(sum(weight) OVER o, 0) AS wb FROM {name}_in
    WINDOW o AS ({on} ORDER BY lim::DOUBLE / weight::DOUBLE, {here.split(', ')[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_full AS (SELECT *, lim * (w - wb) <= weight * (budget - kb) AS is_full FROM {name}_rank),
{name}_sums AS (SELECT *, coalesce(sum(lim) FILTER (is_full) OVER ({on}), 0) AS kf, coalesce(sum(weight) FILTER (is_full) OVER ({on}), 0) AS wf FROM {name}_full),
{name}_out AS (SELECT {here}, tokens, CASE WHEN is_full THEN lim ELSE (weight * (budget - kf)) // (w - wf) END AS given FROM {name}_sums)"""


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    {_case('source', {s: d for d, names in DOMAINS.items() for s in names}, "'other'")} AS domain, coalesce(ceil(strlen(text) / 4.0), 0)::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM d WHERE n_tokens > 0 GROUP BY ALL),
{_level_sql('dom', 'domain', '', _case('domain', DOMAIN_WEIGHTS, '1'), '')},
{_level_sql('lng', 'domain, lang', 'domain', _case('lang', LANG_WEIGHTS, '1'), 'dom')},
{_level_sql('src', 'domain, lang, source', 'domain, lang', '1', 'lng')},
plan AS (SELECT domain, lang, source, (given // tokens)::BIGINT AS whole, (given % tokens)::BIGINT AS rest FROM src_out),
o AS (SELECT d.*, whole, rest, ('0x' || substr(md5('{SEED}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
      FROM d JOIN plan USING (domain, lang, source) WHERE n_tokens > 0),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS cum FROM o)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, whole + CASE WHEN cum <= rest THEN 1 ELSE 0 END)) AS epoch FROM c
"""


@CATALOGUE.register("op3_mix_sources", SQL)
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")
