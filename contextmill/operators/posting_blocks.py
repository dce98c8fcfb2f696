"""BM25 top-k over stored postings that reads only blocks which can matter.

Documents are dealt to homes (segment, scope, bucket), and all postings of a document lie in its home. A home is built as a
whole from the texts dealt to it, in one pass over arrays. Its first row, whose term is empty, lists its documents; a posting
names a document by its place in that list, so units and versions are looked up once per document. The postings of a term are
sorted by impact and cut into blocks of bounded size; a block carries its largest frequency and shortest length, from which an
upper bound of any score it adds follows for every corpus average.

A search reads the bounds first. For a request, a home's potential is the sum of its terms' best bounds, and a block's reach
is that potential with its own bound in place of its term's best. The FIRST_HOMES homes of largest potential are read whole; the k-th
best score found there is passed on, and of all other homes only blocks whose reach is not below it are read. A document
that belongs to the answer has no posting in a skipped block, so its score is complete; others stay below the k-th score.

A batch with more than MAX_PUSHED_PREFIXES prefixes reads most blocks for one request or another. It opens every posting once,
whatever the number of requests, and scores all requests on whole homes.

How many documents hold a word with some prefix is kept per prefix up to PREFIX_LENGTH characters, so skipped blocks need
not be counted; longer prefixes are counted from their postings. The terms of a home are sorted, and the first one with a prefix
carries its count: prefix_df has the counts of the prefixes that a term does not share with the term before.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import spaced_tokens
from ..session import MAX_PINNED_ROWS, pin_small
from . import text_scores
from .lexical import B, CANDIDATES, K1, MAX_PUSHED_PREFIXES, MIN_IDF, SCORE_DIGITS, Asked, expand_prefixes
from .ordered import top_per_group

BLOCK_ROWS = 128
HOME_DOCS = 4096
#: Bytes of text of a home, on average. A task takes a few homes, one after the other.
HOME_BYTES, HOMES_PER_TASK = 8 << 20, 8
PREFIX_LENGTH = 32
FIRST_HOMES = 8
#: Tokens of the documents that a wide search scores at once where one document has rows in several homes.
WIDE_TOKENS = 1 << 20
#: Bounds and scores are floating point: a block is skipped only if its reach lies below the k-th score by more than this share.
MARGIN = 1e-9

HOME = ["segment", "scope", "bucket"]
VERSION = ["scope", "unit", "version"]
UNIT_TYPES = "scope string, unit string, version timestamp_ntz"
ENDED = "scope string, term string, prefix_df array<int>, n long, total long"
SIZES = "scope string, n long, total long"


def blocks_ddl(doc_type: str) -> str:
    docs = f"array<struct<doc:{doc_type},unit:string,version:timestamp_ntz,dl:int,rows:int>>"
    return ("scope string, bucket int, term string, block int, n int, max_tf int, min_dl int, prefix_df array<int>, "
            f"entries struct<slots:array<int>,tfs:array<int>>, docs {docs}")


@dataclass
class Corpus:
    """One version of a stored index.

    blocks: segment and the columns of blocks_ddl. dead: versions of units that no longer count. ended: what these take back
    from the counts per prefix. sizes are deltas per scope, to be added up: documents and their tokens.
    """

    blocks: DataFrame
    dead: DataFrame
    ended: DataFrame
    sizes: DataFrame

    def within(self, scopes: list[str] | None) -> "Corpus":
        """The part of the given scopes, whose names prune the scan."""
        if scopes is None:
            return self
        return Corpus(*(df.where(F.col("scope").isin(*scopes)) for df in (self.blocks, self.dead, self.ended, self.sizes)))


# --- building ----------------------------------------------------------------------------------

@dataclass
class Home:
    """Documents (slots) of a home and their postings, sorted by term and slot. rows: of the input, as first rows and numbers
    per slot."""

    first: np.ndarray
    rows: np.ndarray
    dl: np.ndarray
    terms: pa.Array
    term: np.ndarray
    slot: np.ndarray
    tf: np.ndarray

    @classmethod
    def of(cls, first: np.ndarray, slot_of_row: np.ndarray, dl: np.ndarray, words: pa.Array, row: np.ndarray, code: np.ndarray, tf: np.ndarray | None) -> "Home":
        """From words (row, code of a word, frequency, or 1 each)."""
        order, size = pc.sort_indices(words).to_numpy(), max(len(first), 1)
        rank = np.empty(len(order), np.int32 if len(order) * size < 1 << 31 else np.int64)
        rank[order] = np.arange(len(order))
        key = rank[code]
        key *= size
        key += slot_of_row.astype(key.dtype)[row]
        if tf is None:
            key.sort()
        else:
            at = np.argsort(key)
            key, tf = key[at], tf[at]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        added = np.diff(np.append(heads, len(key))) if tf is None else np.add.reduceat(tf, heads) if len(heads) else heads
        key = key[heads]
        return cls(first, np.bincount(slot_of_row, minlength=len(first)), dl[first], words.take(pa.array(order)), key // size, key % size, added.astype(np.int32))

    @classmethod
    def of_texts(cls, rows: pa.Table) -> "Home":
        """From (unit, version, doc, text): words between blanks. Rows of one document of one length count as one document."""
        lengths, row, code, words = text_scores.blank_separated(rows["text"].combine_chunks())
        first, slot = text_scores.numbered([*(rows[c].combine_chunks() for c in ("unit", "version", "doc")), pa.array(lengths)])
        return cls.of(first, slot, lengths, words, row, code, None)

    @classmethod
    def of_postings(cls, rows: pa.Table) -> "Home":
        """From (unit, version, doc, dl, term, tf)."""
        first, slot = text_scores.numbered([rows[c].combine_chunks() for c in ("unit", "version", "doc", "dl")])
        coded = rows["term"].combine_chunks().dictionary_encode()
        return cls.of(first, slot, rows["dl"].to_numpy(), coded.dictionary, np.arange(rows.num_rows), coded.indices.to_numpy(), rows["tf"].to_numpy())

    def prefix_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(numbers per term, counts): documents per prefix that a term is the first to have."""
        return text_scores.prefix_documents(self.terms, self.term, self.slot, PREFIX_LENGTH)

    def block_columns(self, block_rows: int) -> list[pa.Array]:
        """term, block, n, max_tf, min_dl, prefix_df, entries."""
        n, slot, tf = np.bincount(self.term, minlength=len(self.terms)), self.slot.copy(), self.tf.copy()
        at = np.flatnonzero(n[self.term] > block_rows)
        impact = tf[at] / (tf[at] + K1 * ((1 - B) + B * self.dl[slot[at]] / max(self.dl.mean() if len(self.dl) else 0, 1.0)))
        best = at[np.lexsort((slot[at], -impact, self.term[at]))]
        slot[at], tf[at] = slot[best], tf[best]
        place = np.arange(len(slot)) - (np.cumsum(n) - n)[self.term]
        heads = np.flatnonzero(place % block_rows == 0)
        offsets = pa.array(np.append(heads, len(slot)).astype(np.int32))
        block, term = place[heads] // block_rows, self.term[heads]
        many, counts = self.prefix_counts()
        lists = np.append(0, np.cumsum(np.where(block == 0, many[term], 0)))
        entries = pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (slot, tf)], ["slots", "tfs"])
        bounds = [f.reduceat(v, heads) if len(heads) else np.zeros(0) for f, v in ((np.maximum, tf), (np.minimum, self.dl[slot]))]
        return [self.terms.take(pa.array(term)), *(pa.array(np.asarray(v).astype(np.int32)) for v in (block, np.diff(np.append(heads, len(slot))), *bounds)),
                pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), pa.array(counts.astype(np.int32))), entries]


def home_blocks(read, block_rows: int, schema: pa.Schema):
    """Rows of blocks_ddl of a home: its documents, then its blocks by term."""
    def build(rows: pa.Table) -> pa.Table:
        home = read(rows)
        where = [rows["scope"].combine_chunks().slice(0, 1), rows["bucket"].combine_chunks().slice(0, 1)]
        own = [rows[c].combine_chunks().take(pa.array(home.first)) for c in ("doc", "unit", "version")]
        docs = pa.StructArray.from_arrays([*own, pa.array(home.dl.astype(np.int32)), pa.array(home.rows.astype(np.int32))], ["doc", "unit", "version", "dl", "rows"])
        listed = [*where, pa.array([""]), *(pa.array([v], pa.int32()) for v in (0, len(docs), 0, 0)), pa.array([[]], schema.field("prefix_df").type),
                  pa.nulls(1, schema.field("entries").type), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)]
        blocks = home.block_columns(block_rows)
        n = len(blocks[0])
        blocks = [*(w.take(pa.array(np.zeros(n, np.int64))) for w in where), *blocks, pa.nulls(n, schema.field("docs").type)]
        return text_scores.in_pieces(pa.concat_tables(pa.Table.from_arrays(c, names=schema.names).cast(schema) for c in (listed, blocks)))

    return build


def home_counts(sign: int, schema: pa.Schema):
    """Rows of ENDED of a home: the number of rows and their tokens under the empty term, and counts per prefix."""
    def count(rows: pa.Table) -> pa.Table:
        home = Home.of_texts(rows)
        many, counts = home.prefix_counts()
        n = len(home.terms)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, 0, *many]).astype(np.int32)), pa.array((sign * counts).astype(np.int32)))
        sums = [pa.array(np.append(sign * v, np.zeros(n, np.int64)).astype(np.int64)) for v in (home.rows.sum(), (home.rows * home.dl).sum())]
        scope = rows["scope"].combine_chunks().take(pa.array(np.zeros(n + 1, np.int64)))
        return text_scores.in_pieces(pa.Table.from_arrays([scope, pa.concat_arrays([pa.array([""], home.terms.type), home.terms]), lists, *sums], names=schema.names).cast(schema))

    return count


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def dealt(rows: DataFrame, homes: int) -> DataFrame:
    """rows of documents with the bucket of their home. Where homes are many, tasks take few of them each."""
    out = rows.withColumn("bucket", F.pmod(F.xxhash64("doc"), F.lit(max(1, homes))).cast("int"))
    tasks = -(-homes // HOMES_PER_TASK)
    if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")):
        out = out.repartition(tasks, "bucket", "scope")
    return out


def dealt_texts(docs: DataFrame, home_docs: int = HOME_DOCS) -> DataFrame:
    """docs (scope, unit, version, doc, text), their words between blanks, with the bucket of their home."""
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    homes = max(-(-size["n"] // home_docs), -(-(size["bytes"] or 0) // HOME_BYTES))
    return dealt(docs.select(*VERSION, "doc", F.coalesce(spaced_tokens("text"), F.lit("")).alias("text")), homes)


def make_blocks(docs: DataFrame, home_docs: int = HOME_DOCS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of docs (scope, unit, version, doc, text). Texts move once, to their home; postings do not."""
    ddl = blocks_ddl(docs.schema["doc"].dataType.simpleString())
    return dealt_texts(docs, home_docs).groupBy("bucket", "scope").applyInArrow(home_blocks(Home.of_texts, block_rows, _arrow(ddl)), ddl)


def remade_blocks(postings: DataFrame, docs: int, tokens: int, home_docs: int = HOME_DOCS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of postings (scope, unit, version, doc, dl, term, tf) of so many documents with so many tokens."""
    ddl = blocks_ddl(postings.schema["doc"].dataType.simpleString())
    homes = max(-(-docs // home_docs), -(-tokens * 6 // HOME_BYTES))
    return dealt(postings, homes).groupBy("bucket", "scope").applyInArrow(home_blocks(Home.of_postings, block_rows, _arrow(ddl)), ddl)


def ended_counts(docs: DataFrame, home_docs: int = HOME_DOCS) -> DataFrame:
    """What docs (scope, unit, version, doc, text) take back from the counts when they end."""
    return dealt_texts(docs, home_docs).groupBy("bucket", "scope").applyInArrow(home_counts(-1, _arrow(ENDED)), ENDED)


def size_deltas(blocks: DataFrame, ended: DataFrame) -> DataFrame:
    """SIZES of written blocks and of what ended with them."""
    held = blocks.where("term = ''").select("scope", F.inline("docs")).select("scope", F.col("rows").cast("long").alias("n"), (F.col("rows") * F.col("dl").cast("long")).alias("total"))
    return held.unionByName(ended.where("term = ''").select("scope", "n", "total")).groupBy("scope").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def prefix_counts(rows: DataFrame, lengths: list[int] | None) -> DataFrame:
    """(scope, prefix, df) of the given lengths from rows (scope, term, prefix_df); counts of a prefix are to be added up."""
    known = rows.select("scope", "term", (F.least(F.length("term"), F.lit(PREFIX_LENGTH)) - F.size("prefix_df") + 1).alias("at"), F.posexplode("prefix_df").alias("pos", "df"))
    known = known.select("scope", "term", (F.col("at") + F.col("pos")).alias("len"), F.col("df").cast("long").alias("df"))
    if lengths is not None:
        known = known.where(F.col("len").isin(*lengths))
    return known.select("scope", F.substr("term", F.lit(1), F.col("len")).alias("prefix"), "df")


def documents(blocks: DataFrame) -> DataFrame:
    """(home, slot, doc, unit, version, dl, rows): documents of the blocks, also dead ones."""
    return blocks.where("term = ''").select(*HOME, F.posexplode("docs").alias("slot", "d")).select(*HOME, "slot", "d.*")


def live_postings(corpus: Corpus, docs: DataFrame | None = None) -> DataFrame:
    """(scope, unit, version, doc, dl, term, tf): all postings that still count, or those of the given live documents."""
    docs = documents(corpus.blocks).join(corpus.dead, VERSION, "left_anti") if docs is None else docs
    rows = corpus.blocks.where("term <> ''").select(*HOME, "term", F.inline(F.arrays_zip("entries.slots", "entries.tfs"))).withColumnsRenamed({"slots": "slot", "tfs": "tf"})
    return rows.join(docs, [*HOME, "slot"]).select(*VERSION, "doc", "dl", "term", "tf")


# --- searching ---------------------------------------------------------------------------------

def _bound(tf: Column, dl: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * dl / average))


class BlockSearch:
    """Top documents of a batch of requests (query_id, text) over a Corpus.

    allowed, if given, has the ids (doc) that may be found; counts and averages stay those of the whole corpus.
    """

    def __init__(self, corpus: Corpus, requests: DataFrame, limit: int = CANDIDATES, allowed: DataFrame | None = None,
                 first_homes: int = FIRST_HOMES) -> None:
        self.corpus, self.limit, self.allowed = corpus, limit, allowed
        self.asked = Asked.of(requests)
        self.blocks = self._wanted_blocks()
        total = corpus.sizes.agg(F.sum("n").alias("n"), F.sum("total").alias("t")).select(
            F.struct("n", (F.col("t") / F.when(F.col("n") != 0, F.col("n"))).alias("average")).alias("r")).scalar()
        self.n, self.average = total["n"], total["average"]
        self.dead = pin_small(corpus.dead.distinct())
        self.frequencies = pin_small(self._frequencies())
        self.wide = self.asked.few and len(self.asked.words) > MAX_PUSHED_PREFIXES
        self.candidates = self._reaches(first_homes)

    def _wanted_blocks(self) -> DataFrame:
        blocks = self.corpus.blocks
        if self.asked.few and len(self.asked.words) <= MAX_PUSHED_PREFIXES:
            wanted = F.lit(False)
            for word in self.asked.words:
                wanted = wanted | F.startswith("term", F.lit(word))
            blocks = blocks.where(wanted)
        return blocks

    def _matching(self) -> DataFrame:
        """Bounds of the blocks of every wanted prefix; entries are not read."""
        meta = self.blocks.where("term <> ''").select(*HOME, "term", "block", "n", "max_tf", "min_dl")
        return expand_prefixes(meta, self.asked.lengths).join(self.asked.prefixes, "prefix")

    def _frequencies(self) -> DataFrame:
        """(prefix, idf) of the wanted prefixes."""
        prefixes = self.asked.prefixes
        columns = ["scope", "term", "prefix_df"]
        known = prefix_counts(self.blocks.select(*columns).unionByName(self.corpus.ended.select(*columns)), self.asked.lengths)
        known = known.join(prefixes.where(F.length("prefix") <= PREFIX_LENGTH), "prefix").groupBy("prefix").agg(F.sum("df").alias("df"))
        if not self.asked.few or any(len(w) > PREFIX_LENGTH for w in self.asked.words):
            long = prefixes.where(F.length("prefix") > PREFIX_LENGTH)
            held = live_postings(Corpus(self.blocks, self.corpus.dead, self.corpus.ended, self.corpus.sizes), self._live(self.corpus.blocks))
            rows = expand_prefixes(held.select("doc", "term"), self.asked.lengths).join(long, "prefix")
            known = known.unionByName(rows.groupBy("prefix").agg(F.count_distinct("doc").alias("df")))
        ratio = (self.n - F.col("df") + 0.5) / (F.col("df") + 0.5)
        return known.where("df > 0").select("prefix", F.greatest(F.log(ratio), F.lit(MIN_IDF)).alias("idf"))

    def _reaches(self, first_homes: int) -> DataFrame:
        """(query_id, home, prefix, term, block, n, qtf, idf, reach, first): every block of every request."""
        rows = self._matching().join(self.frequencies, "prefix")
        rows = rows.withColumn("bound", F.col("idf") * _bound(F.col("max_tf"), F.col("min_dl"), self.average))
        cap = F.col("idf") * (K1 + 1)
        prefix, request = Window.partitionBy(*HOME, "prefix"), Window.partitionBy("query_id", *HOME)
        rows = rows.withColumn("best", F.max("bound").over(Window.partitionBy(*HOME, "prefix", "term")))
        # a term has one block 0 per home, so it counts once
        rows = rows.withColumn("all_terms", F.sum(F.when(F.col("block") == 0, F.col("best"))).over(prefix))
        rows = rows.withColumn("leads", F.row_number().over(prefix.orderBy("term", "block")) == 1)
        asked = rows.join(self.asked.terms, "prefix").withColumn("most", F.col("qtf") * F.least("all_terms", cap))
        asked = asked.withColumn("potential", F.sum(F.when(F.col("leads"), F.col("most"))).over(request))
        homes = asked.where("leads").select("query_id", *HOME, "potential").distinct()
        first = top_per_group(homes, ["query_id"], [F.desc("potential"), *map(F.col, HOME)], first_homes).select("query_id", *HOME, F.lit(True).alias("first"))
        found = asked.join(first, ["query_id", *HOME], "left")
        own = F.col("qtf") * F.least(F.col("all_terms") - F.col("best") + F.col("bound"), cap)
        return found.select("query_id", *HOME, "prefix", "term", "block", "n", "qtf", "idf", (F.col("potential") - F.col("most") + own).alias("reach"),
                            F.coalesce("first", F.lit(False)).alias("first"))

    def _scores(self, chosen: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) from chosen blocks; complete for documents none of whose blocks was left out."""
        read = chosen.select("query_id", *HOME, "prefix", "term", "block", "qtf", "idf").join(
            self.blocks.select(*HOME, "term", "block", "entries"), [*HOME, "term", "block"])
        rows = read.select("query_id", *HOME, "prefix", "qtf", "idf", F.inline(F.arrays_zip("entries.slots", "entries.tfs"))).withColumnsRenamed({"slots": "slot", "tfs": "tf"})
        # only the lists of homes that are opened
        homes = self.corpus.blocks.where("term = ''").join(chosen.select(*HOME).distinct(), HOME, "left_semi")
        rows = rows.join(self._live(homes), [*HOME, "slot"])
        counted = rows.groupBy("query_id", "doc", "dl", "prefix", "qtf", "idf").agg(F.sum("tf").alias("f"))
        weight = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * ((1 - B) + B * F.col("dl") / self.average))
        return counted.groupBy("query_id", F.col("doc").alias("doc_id")).agg(F.round(F.sum(F.col("qtf") * weight), SCORE_DIGITS).alias("score"))

    def _live(self, blocks: DataFrame) -> DataFrame:
        """documents() of the blocks that count and are allowed."""
        docs = documents(blocks).join(self.dead, VERSION, "left_anti")
        return docs if self.allowed is None else docs.join(self.allowed.select("doc"), "doc", "left_semi")

    def _wide_scores(self) -> DataFrame:
        """(query_id, doc_id, score): at least the best `limit` of each home, every posting read once.

        Documents with rows in several homes are scored apart, from postings that meet first. Where these are more than can be pinned, all are.
        """
        sizes = self.corpus.sizes.agg(F.sum("n").alias("n"), F.sum("total").alias("t")).first()
        known = {r["prefix"]: r["idf"] for r in self.frequencies.collect()}
        idf = np.array([known.get(w, 0.0) for w in self.asked.words])
        terms = text_scores.Terms.of(self.asked.counted, self.asked.words)
        average = (sizes["t"] or 0) / sizes["n"] if sizes["n"] else 1.0
        live = self._live(self.corpus.blocks)
        doc, scored = live.schema["doc"].dataType.simpleString(), None
        home = F.struct(*HOME)
        several = live.groupBy("doc").agg(F.min(home).alias("a"), F.max(home).alias("z")).where("a <> z").select(F.col("doc").alias("several"))
        found = several.limit(MAX_PINNED_ROWS + 1).toArrow()
        once, twice = (live, None) if found.num_rows == 0 else (None, live)
        if 0 < found.num_rows <= MAX_PINNED_ROWS:
            named = F.broadcast(live.sparkSession.createDataFrame(found, several.schema))
            same = F.col("doc").eqNullSafe(F.col("several"))
            once, twice = live.join(named, same, "left_anti"), F.broadcast(live.join(named, same, "left_semi"))
        parts = []
        if once is not None:
            listed = once.select(*HOME, F.lit(None).cast("string").alias("term"), F.array("slot").alias("slots"), F.array("dl").alias("tfs"), "doc")
            blocks = self.corpus.blocks.where("term <> ''").select(*HOME, "term", "entries.slots", "entries.tfs", F.lit(None).cast(doc).alias("doc"))
            # sorted by a number first
            parts.append((blocks.unionByName(listed).groupBy("bucket", "segment", "scope"), text_scores.home_scorer))
        if twice is not None:
            group = F.pmod(F.xxhash64("doc"), F.lit(max(1, -(-(sizes["t"] or 0) // WIDE_TOKENS)))).cast("int")
            parts.append((live_postings(self.corpus, twice).select(group.alias("part"), "doc", "dl", "term", "tf").groupBy("part"), text_scores.posting_scorer))
        for part in terms.passes(self.limit):
            for rows, scorer in parts:
                rows = rows.applyInArrow(scorer(part, idf, average, self.limit, K1, B, SCORE_DIGITS), f"query_id long, doc_id {doc}, score double")
                scored = rows if scored is None else scored.unionByName(rows)
        return scored

    def _top(self, scores: DataFrame) -> DataFrame:
        return top_per_group(scores, ["query_id"], [F.desc("score"), F.col("doc_id")], self.limit)

    def first_hits(self) -> DataFrame:
        """At most `limit` rows per request, looked up once for both uses."""
        return pin_small(self._top(self._scores(pin_small(self.candidates.where("first")))).drop("rank"))

    def second_blocks(self, first: DataFrame) -> DataFrame:
        """Blocks outside the first homes that can still reach the k-th score of the first hits."""
        low = first.groupBy("query_id").agg(F.count("*").alias("k"), F.min("score").alias("low")).where(F.col("k") >= self.limit).select("query_id", "low")
        rest = self.candidates.where("NOT first").join(low, "query_id", "left")
        return rest.where(F.col("low").isNull() | (F.col("reach") * (1 + MARGIN) + MARGIN >= F.col("low")))

    def hits(self) -> DataFrame:
        """(query_id, doc_id, score, rank): as the sum over all postings gives them."""
        if self.wide:
            return self._top(self._wide_scores())
        first = self.first_hits()
        return self._top(first.unionByName(self._top(self._scores(self.second_blocks(first))).drop("rank")))

    def postings_read(self) -> tuple[int, int]:
        """(read, all): postings in blocks that hits() opens and in all blocks of the requests."""
        read = self.candidates.where("first").select("n").unionByName(self.second_blocks(self.first_hits()).select("n"))
        both = [df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in (read, self.candidates)]
        return both[0], both[1]
