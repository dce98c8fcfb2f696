"""BM25 scores inside the scan of a collection: best documents per request without a row per document and request.

A task turns its Arrow batches of tokens into a matrix of documents by requested prefixes, scores all requests on it and
keeps its best rows per request, so what leaves it does not depend on the number of documents. Counts of the whole
collection (documents per prefix, lengths) come from a pass of the same form before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

MAX_MATRIX_BYTES = 32 << 20
MAX_KNOWN_WORDS = 500_000
#: Of a home: bytes of the matrix of a part of its documents, terms that are compared at once.
PART_BYTES, PIECE = 8 << 20, 1 << 15
#: Slots of a counting pass that are no prefix.
DOCS, MEASURED, TOKENS, IDS = -1, -2, -3, -4


class BestRows:
    """The k best rows (largest score, then smallest id) of each of n requests; ids are an Arrow type."""

    def __init__(self, n: int, k: int, id_type: pa.DataType) -> None:
        self.k, self.id_type = k, id_type
        self.low, self.low_id = np.full(n, -np.inf), None
        self.parts: list[pa.Table] = []
        self.pending, self.bound = 0, max(2 * n * k, 1 << 14)

    def wanted(self, scores: np.ndarray, ids: pa.Array) -> np.ndarray:
        """Which of the scores (requests by rows) can still be among the best."""
        low = self.low[:, None]
        if self.low_id is None or ids.null_count:
            return scores >= low
        own = ids.to_numpy(zero_copy_only=False)
        return (scores > low) | ((scores == low) & (own[None, :] < self.low_id[:, None]))

    def add(self, request: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        self.parts.append(pa.table({"q": pa.array(request, pa.int64()), "score": pa.array(score, pa.float64()), "id": ids}))
        self.pending += len(request)
        if self.pending > self.bound:
            self._cut()

    def _cut(self) -> None:
        rows = pa.concat_tables(self.parts)
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("q", "ascending"), ("score", "descending"), ("id", "ascending")],
                                         null_placement="at_start"))
        q = rows["q"].to_numpy()
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        rows = rows.take(pa.array(np.flatnonzero(rank < self.k))).combine_chunks()
        q, last = rows["q"].to_numpy(), np.flatnonzero(rank[rank < self.k] == self.k - 1)
        self.low[q[last]] = rows["score"].to_numpy()[last]
        ids = rows["id"].take(pa.array(last))
        if not ids.null_count and len(last):
            own = ids.to_numpy()
            # a request with fewer than k rows has no bound yet: its score of -inf lets every row in
            self.low_id = np.zeros(len(self.low), own.dtype) if own.dtype != object else np.full(len(self.low), "", object)
            self.low_id[q[last]] = own
        else:
            self.low_id = None
        self.parts, self.pending = [rows], 0

    def rows(self, query_ids: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._cut()
            rows = self.parts[0]
            for batch in pa.table([pa.array(query_ids[rows["q"].to_numpy()]), rows["id"], rows["score"]], names=names).combine_chunks().to_batches(1 << 16):
                yield batch


@dataclass
class Terms:
    """Requested prefixes and, grouped by request, the numbers of their prefixes with multiplicities."""

    words: tuple[str, ...]
    query_ids: np.ndarray
    starts: np.ndarray
    prefix: np.ndarray
    qtf: np.ndarray

    @classmethod
    def of(cls, found: pa.Table, words: tuple[str, ...]) -> "Terms":
        """From rows (query_id, prefix, qtf)."""
        number = {w: i for i, w in enumerate(words)}
        rows = sorted(zip(found.column("query_id").to_pylist(), (number[p] for p in found.column("prefix").to_pylist()), found.column("qtf").to_pylist()))
        q, p, n = (np.array(c) for c in zip(*rows))
        query_ids, starts = np.unique(q, return_index=True)
        return cls(words, query_ids, starts, p.astype(np.int64), n.astype(np.float64))

    def passes(self, k: int) -> list["Terms"]:
        """Parts whose best rows fit into the bound; nearly always one."""
        step = max(1, MAX_MATRIX_BYTES // (8 * k))
        ends = np.append(self.starts, len(self.prefix))
        cuts = [(i, min(i + step, len(self.query_ids))) for i in range(0, len(self.query_ids), step)]
        return [Terms(self.words, self.query_ids[a:b], self.starts[a:b] - ends[a], self.prefix[ends[a]:ends[b]], self.qtf[ends[a]:ends[b]]) for a, b in cuts]

    def finder(self):
        """A function from word to the numbers of the prefixes it begins with."""
        number, lengths = {w: i for i, w in enumerate(self.words)}, sorted({len(w) for w in self.words})
        known: dict[str, list[int]] = {}

        def find(word: str) -> list[int]:
            hits = known.get(word)
            if hits is None:
                if len(known) >= MAX_KNOWN_WORDS:
                    known.clear()
                hits = known[word] = [number[word[:n]] for n in lengths if n <= len(word) and word[:n] in number]
            return hits

        return find

    def frequencies(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, has tokens, lengths, matrix of documents by prefixes) of pieces of (doc_id, toks) batches."""
        find, size = self.finder(), len(self.words)
        step = max(1, MAX_MATRIX_BYTES // (8 * max(size, len(self.prefix), 1)))
        for whole in batches:
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                toks = batch.column(1)
                lengths = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = toks.flatten().dictionary_encode()
                at, prefix = _positions(coded.indices.to_numpy(zero_copy_only=False), [find(w) for w in coded.dictionary.to_pylist()])
                rows = np.repeat(np.arange(batch.num_rows), lengths)[at]
                f = np.bincount(rows * size + prefix, minlength=batch.num_rows * size)
                yield batch.column(0), toks.is_valid().to_numpy(zero_copy_only=False), lengths, f.reshape(batch.num_rows, size)


def counts(toks: DataFrame, terms: Terms) -> dict[int, int]:
    """Documents per prefix number, and under DOCS, MEASURED, TOKENS and IDS: all rows, those with a text, their tokens, and
    the rows of the most frequent id."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, special = np.zeros(len(terms.words), dtype=np.int64), np.zeros(3, dtype=np.int64)
        for ids, valid, lengths, f in terms.frequencies(batches):
            total += (f > 0).sum(axis=0)
            special += [len(valid), valid.sum(), lengths.sum()]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(valid), IDS, np.int32)), ids, pa.array(np.ones(len(valid), np.int64))], names=["slot", "id", "n"])
        slots = np.concatenate([np.arange(len(total)), [DOCS, MEASURED, TOKENS]]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.nulls(len(slots), id_type), pa.array(np.concatenate([total, special]))], names=["slot", "id", "n"])

    kind = toks.schema["doc_id"].dataType
    id_type = pa.string() if kind.simpleString() == "string" else pa.int32() if kind.simpleString() == "int" else pa.int64()
    rows = toks.mapInArrow(count, f"slot int, id {kind.simpleString()}, n long").groupBy("slot", "id").agg(F.sum("n").alias("n"))
    return {r["slot"]: r["n"] for r in rows.groupBy("slot").agg(F.max("n").alias("n")).collect()}


def best(toks: DataFrame, terms: Terms, idf: np.ndarray, average: float, k: int, k1: float, b: float, digits: int) -> DataFrame:
    """(query_id, doc_id, score): at least the k best documents per request, cut per task."""
    id_type = toks.schema["doc_id"].dataType.simpleString()
    scored = None
    for part in terms.passes(k):
        found = toks.mapInArrow(_scorer(part, idf, average, k, k1, b, digits), f"query_id long, doc_id {id_type}, score double")
        scored = found if scored is None else scored.unionByName(found)
    return scored


def _scorer(terms: Terms, idf: np.ndarray, average: float, k: int, k1: float, b: float, digits: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = None
        for ids, _, lengths, f in terms.frequencies(batches):
            top = top or BestRows(len(terms.query_ids), k, ids.type)
            f = f.T.astype(np.float64)
            weight = idf[:, None] * f * (k1 + 1) / (f + (k1 * ((1 - b) + b * lengths / average))[None, :])
            exact = np.add.reduceat(weight[terms.prefix] * terms.qtf[:, None], terms.starts, axis=0)
            scores = np.round(exact, digits)
            q, r = np.nonzero((exact > 0) & top.wanted(scores, ids))
            if len(q):
                top.add(q, scores[q, r], ids.take(pa.array(r)))
        if top is not None:
            yield from top.rows(terms.query_ids, ["query_id", "doc_id", "score"])

    return score


def matches(toks: DataFrame, terms: Terms) -> DataFrame:
    """(doc_id, dl, prefix, f, rows): how often the numbered prefixes occur in the rows of one id and length, and in how many."""
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, lengths, f in terms.frequencies(batches):
            r, p = np.nonzero(f)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), pa.array(lengths[r]), pa.array(p.astype(np.int32)), pa.array(f[r, p].astype(np.int64))],
                                             names=["doc_id", "dl", "prefix", "f"])

    rows = toks.mapInArrow(match, f"doc_id {toks.schema['doc_id'].dataType.simpleString()}, dl long, prefix int, f long")
    return rows.groupBy("doc_id", "dl", "prefix").agg(F.sum("f").alias("f"), F.count("*").alias("rows"))


def best_repeated(rows: DataFrame, terms: Terms, idf: np.ndarray, average: float, k: int, k1: float, b: float, digits: int) -> DataFrame:
    """As best, from matches: the weights of an id's lengths are added up, so an id has one row and at most all prefixes in it."""
    known = rows.sparkSession.createDataFrame(pa.table({"prefix": pa.array(np.arange(len(idf), dtype=np.int32)), "idf": pa.array(idf)}), "prefix int, idf double")
    f = F.col("f")
    weight = F.col("idf") * f * (k1 + 1) / (f + k1 * ((1 - b) + b * F.col("dl") / average))
    added = rows.join(F.broadcast(known), "prefix").groupBy("doc_id", "prefix").agg(F.sum(weight).alias("weight"))
    whole = added.groupBy("doc_id").agg(F.collect_list(F.struct("prefix", "weight")).alias("weights"))
    scored = None
    for part in terms.passes(k):
        found = whole.mapInArrow(_weight_scorer(part, k, digits), f"query_id long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
        scored = found if scored is None else scored.unionByName(found)
    return scored


def _weight_scorer(terms: Terms, k: int, digits: int):
    size = len(terms.words)
    step = max(1, MAX_MATRIX_BYTES // (8 * max(size, len(terms.prefix), 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = None
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            ids, lists = batch.column(0), batch.column(1)
            top = top or BestRows(len(terms.query_ids), k, ids.type)
            own = lists.flatten()
            rows = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            weight = np.zeros((size, batch.num_rows))
            weight[own.field(0).to_numpy(), rows] = own.field(1).to_numpy()
            exact = np.add.reduceat(weight[terms.prefix] * terms.qtf[:, None], terms.starts, axis=0)
            scores = np.round(exact, digits)
            q, r = np.nonzero((exact > 0) & top.wanted(scores, ids))
            if len(q):
                top.add(q, scores[q, r], ids.take(pa.array(r)))
        if top is not None:
            yield from top.rows(terms.query_ids, ["query_id", "doc_id", "score"])

    return score


# --- postings ----------------------------------------------------------------------------------

def blank_separated(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(lengths, row, code, words): the words between blanks of every text, as numbers into words."""
    toks = pc.split_pattern(text, " ")
    own = np.diff(toks.offsets.to_numpy())
    coded = toks.values.slice(toks.offsets[0].as_py(), int(own.sum())).dictionary_encode()
    del toks
    row, code, words = np.repeat(np.arange(len(own), dtype=np.int32), own), coded.indices.to_numpy(), coded.dictionary
    blank = pc.index(words, "").as_py()
    if blank >= 0:
        there = code != blank
        row, code = row[there], code[there]
        words, code = pa.concat_arrays([words.slice(0, blank), words.slice(blank + 1)]), code - (code > blank)
    return np.bincount(row, minlength=len(own)), row, code, words


def in_pieces(rows: pa.Table) -> pa.Table:
    """The table as small batches, which the JVM takes one by one. A worker would keep what its largest home took, so unused memory goes back."""
    pa.default_memory_pool().release_unused()
    return pa.Table.from_batches(rows.to_batches(max_chunksize=PIECE // 2), rows.schema)


def numbered(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(first, number): rows with equal columns have one number; first is where it first occurs."""
    key = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        coded = column.dictionary_encode(null_encoding="encode")
        _, first, key = np.unique(key * max(len(coded.dictionary), 1) + coded.indices.to_numpy(), return_index=True, return_inverse=True)
    return first, key


def by_small(numbers: np.ndarray, below: int) -> np.ndarray:
    """Stable order of numbers from 0 to below; few values sort in linear time."""
    return np.argsort(numbers.astype(np.uint16) if below <= 1 << 16 else numbers, kind="stable")


def _shared(terms: pa.Array, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(length, characters shared with the term before) of sorted terms, both up to `longest`."""
    length, shared = np.zeros(len(terms), np.int8), np.zeros(len(terms), np.int8)
    for low in range(0, len(terms), PIECE):
        # one term of the piece before
        first = max(low - 1, 0)
        own = terms.slice(first, low - first + PIECE).to_pylist()
        chars = np.array(own, dtype=f"U{longest}").view(np.uint32).reshape(len(own), longest)
        length[first:first + len(own)] = (chars != 0).sum(axis=1)
        same = (chars[1:] == chars[:-1]) & (chars[1:] != 0)
        shared[first + 1:first + len(own)] = np.where(same.all(axis=1), longest, same.argmin(axis=1))
    return length, shared


def prefix_documents(terms: pa.Array, term: np.ndarray, slot: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(many, df): for sorted terms and their pairs (term, slot), in how many slots the prefixes of up to `longest` characters
    occur. A prefix stands with the first term that has it: many says how many of them each term is the first to have, the
    longest ones of its prefixes.

    In a slot, a term adds those of its prefixes that it does not share with the term before in that slot. So a prefix occurs
    in as many slots as there are pairs whose term has it and shares fewer characters with the one before.
    """
    n = len(terms)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    length, shared = _shared(terms, longest)
    # least[k][i]: what the terms i - 1 to i - 1 + 2^k share
    least = [shared]
    while 1 << len(least) < n:
        half = 1 << (len(least) - 1)
        least.append(np.append(np.minimum(least[-1][:-half], least[-1][half:]), least[-1][-half:]))
    table, order = np.stack(least), by_small(slot, int(slot.max(initial=0)) + 1)
    del least
    now, common = term[order], np.zeros(len(order), np.int8)
    fresh = np.append(True, np.diff(slot[order]) != 0)
    for low in range(1, len(order), 4 * PIECE):
        high = min(low + 4 * PIECE, len(order))
        z = low + np.flatnonzero(~fresh[low:high])
        before, after = now[z - 1], now[z]
        k = np.frexp((after - before).astype(np.float64))[1] - 1
        common[z] = np.minimum(table[k, before + 1], table[k, after - (1 << k) + 1])
    now, ends = now[np.argsort(common, kind="stable")], np.cumsum(np.bincount(common, minlength=longest))
    many = (length - shared).astype(np.int64)
    place = np.cumsum(many) - many - shared
    df, below = np.zeros(many.sum(), np.int64), np.zeros(n, np.int64)
    for size in range(1, int(length.max()) + 1):
        below += np.bincount(now[ends[size - 2] if size > 1 else 0:ends[size - 1]], minlength=n)
        starts = np.flatnonzero(shared < size)
        found, there = np.add.reduceat(below, starts), length[starts] >= size
        df[place[starts[there]] + size - 1] = found[there]
    return many, df


def _positions(code: np.ndarray, own: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    many = np.array([len(h) for h in own], dtype=np.int64)
    flat = np.array([p for h in own for p in h], dtype=np.int64)
    n = many[code] if len(code) else np.zeros(0, np.int64)
    start = (np.cumsum(many) - many)[code] if len(code) else n
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.arange(len(code)), n), flat[np.repeat(start, n) + inside] if len(flat) else np.zeros(0, np.int64)


def posting_scorer(terms: Terms, idf: np.ndarray, average: float, k: int, k1: float, b: float, digits: int):
    """Best k documents per request of a group of whole documents, from postings (part, doc, dl, term, tf)."""
    def score(postings: pa.Table) -> pa.Table:
        coded, dl = postings["term"].combine_chunks().dictionary_encode(), postings["dl"].to_numpy().astype(np.int64)
        find = terms.finder()
        found = [find(w) for w in coded.dictionary.to_pylist()]
        starts, prefix = np.cumsum([0, *map(len, found)]), np.array([p for h in found for p in h], np.int64)
        units = _Units.of(postings["doc"].combine_chunks(), dl)
        return units.best(terms, units.number, coded.indices.to_numpy(), postings["tf"].to_numpy(), starts, prefix, idf, average, k, k1, b, digits)

    return score


def home_scorer(terms: Terms, idf: np.ndarray, average: float, k: int, k1: float, b: float, digits: int):
    """Best k documents per request of a home, from its blocks (term, slots, tfs) and its documents (doc, with its one slot and
    length in slots and tfs, and no term)."""
    def score(rows: pa.Table) -> pa.Table:
        listed = rows["term"].is_null()
        docs, blocks = rows.filter(listed), rows.filter(pc.invert(listed))
        units = _Units.of(docs["doc"].combine_chunks(), pc.list_flatten(docs["tfs"]).to_numpy().astype(np.int64))
        at, prefix = _ranges(blocks["term"].combine_chunks(), terms.words)
        order = np.argsort(at, kind="stable")
        starts, prefix = np.append(0, np.cumsum(np.bincount(at, minlength=blocks.num_rows))), prefix[order]
        slots, tfs = (pc.list_flatten(blocks[c]).to_numpy() for c in ("slots", "tfs"))
        word = np.repeat(np.arange(blocks.num_rows, dtype=np.int32), pc.list_value_length(blocks["slots"]).to_numpy())
        own = pc.list_flatten(docs["slots"]).to_numpy()
        unit = np.full(max(slots.max(initial=-1), own.max(initial=-1)) + 1, -1, np.int32)
        unit[own] = units.number
        found = unit[slots]
        there = (found >= 0) & (np.diff(starts) > 0)[word]
        return units.best(terms, found[there], word[there], tfs[there], starts, prefix, idf, average, k, k1, b, digits)

    return score


def _ranges(words: pa.Array, prefixes: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(position of a word, number of a prefix it begins with): a prefix has a range of the sorted words."""
    begin, end = pa.array(prefixes, words.type), pa.array([p + "\U0010ffff" for p in prefixes], words.type)
    # sorting is stable: a prefix stands before an equal word
    order = pc.sort_indices(pa.concat_arrays([begin, words, end])).to_numpy().astype(np.int64)
    is_word = (order >= len(begin)) & (order < len(begin) + len(words))
    sorted_words, rank = order[is_word] - len(begin), np.empty(len(order), np.int64)
    rank[order] = np.cumsum(is_word)
    low, high = rank[:len(begin)], rank[len(begin) + len(words):]
    n = high - low
    return sorted_words[np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)], np.repeat(np.arange(len(n)), n)


@dataclass
class _Units:
    """Documents are (id, length), sorted by id; an id's lengths are added up as scores. number: of every row of the input."""

    ids: pa.Array
    doc: np.ndarray
    dl: np.ndarray
    number: np.ndarray

    @classmethod
    def of(cls, docs: pa.Array, dl: np.ndarray) -> "_Units":
        coded = docs.dictionary_encode(null_encoding="encode")
        doc = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        keys, first, number = np.unique(doc * (dl.max(initial=0) + 1) + dl, return_index=True, return_inverse=True)
        return cls(coded.dictionary, doc[first], dl[first], number)

    def best(self, terms: Terms, unit: np.ndarray, word: np.ndarray, tf: np.ndarray, starts: np.ndarray, prefix: np.ndarray, idf: np.ndarray, average: float,
             k: int, k1: float, b: float, digits: int) -> pa.Table:
        """Best k ids per request from postings (unit, word, tf). A word begins with the prefixes from its start to the next."""
        size = len(terms.words)
        step = max(1, PART_BYTES // (8 * max(size, len(terms.prefix))))
        order = by_small(unit, len(self.dl))
        unit, word, tf = unit[order], word[order], tf[order]
        ends = np.append(0, np.cumsum(np.bincount(unit, minlength=len(self.dl))))
        first_of_doc = np.append(True, np.diff(self.doc) != 0)
        top, low = BestRows(len(terms.query_ids), k, self.ids.type), 0
        while low < len(self.dl):
            high = min(low + step, len(self.dl))
            while high < len(self.dl) and not first_of_doc[high]:
                high += 1
            a, z = ends[low], ends[high]
            n = (starts[1:] - starts[:-1])[word[a:z]]
            inside = np.arange(n.sum()) + np.repeat(starts[word[a:z]] - (np.cumsum(n) - n), n)
            cell = prefix[inside] * (high - low) + np.repeat(unit[a:z] - low, n)
            weight = np.bincount(cell, weights=np.repeat(tf[a:z], n), minlength=size * (high - low)).astype(np.float64, copy=False).reshape(size, -1)
            f = weight.copy()
            # in the order of the formula, so that scores are rounded as elsewhere
            weight *= idf[:, None]
            weight *= k1 + 1
            f += (k1 * ((1 - b) + b * self.dl[low:high] / average))[None, :]
            weight /= f
            asked = weight[terms.prefix]
            asked *= terms.qtf[:, None]
            exact = np.add.reduceat(asked, terms.starts, axis=0)
            firsts = np.flatnonzero(first_of_doc[low:high])
            exact = np.add.reduceat(exact, firsts, axis=1)
            ids = self.ids.take(pa.array(self.doc[low:high][firsts]))
            scores = np.round(exact, digits)
            q, r = np.nonzero((exact > 0) & top.wanted(scores, ids))
            if len(q):
                top.add(q, scores[q, r], ids.take(pa.array(r)))
            low = high
        found = list(top.rows(terms.query_ids, ["query_id", "doc_id", "score"]))
        kinds = pa.schema([("query_id", pa.int64()), ("doc_id", self.ids.type), ("score", pa.float64())])
        return pa.Table.from_batches(found, kinds) if found else kinds.empty_table()


# --- substrings --------------------------------------------------------------------------------

EQUAL, PREFIX, INSIDE, ELSEWHERE = 10.0, 5.0, 3.0, 1.0


class NamePoints:
    """Points of a name for every request (query_id, terms): a term's place in the name decides."""

    def __init__(self, asked: list[tuple[int, list[str]]]) -> None:
        self.base = np.array([ELSEWHERE * len(terms) for _, terms in asked])
        uses: dict[str, dict[int, int]] = {}
        for i, (_, terms) in enumerate(asked):
            for t in terms:
                uses.setdefault(t, {})[i] = uses.get(t, {}).get(i, 0) + 1
        self.uses = {t: (np.array(list(u)), np.array(list(u.values()), dtype=np.float64)) for t, u in uses.items()}
        self.longest = max(len(t) for t in uses)
        self.known: dict[str | None, list] = {}

    def found(self, name: str) -> list[tuple[str, float]]:
        """Terms inside a name: by its pieces where these are fewer than the terms."""
        if len(name) * min(len(name), self.longest) < len(self.uses):
            pieces = {name[i:j] for i in range(len(name)) for j in range(i + 1, min(len(name), i + self.longest) + 1)}
            inside = [t for t in pieces if t in self.uses]
        else:
            inside = [t for t in self.uses if t in name]
        return [(t, EQUAL if name == t else PREFIX if name.startswith(t) else INSIDE) for t in inside]

    def extra(self, name: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of requests and their points above the base."""
        hit = self.known.get(name)
        if hit is None:
            if len(self.known) >= MAX_KNOWN_WORDS // 10:
                self.known.clear()
            parts = [(self.uses[t][0], self.uses[t][1] * (points - ELSEWHERE)) for t, points in self.found(name or "")]
            hit = self.known[name] = tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0))
        return hit


def substring_scorer(asked: list[tuple[int, list[str]]], k: int):
    """Best k rows per request of a task's batches (doc_id, name, hay), both lower-case; see lexical.substring_search."""
    query_ids = np.array([q for q, _ in asked], dtype=np.int64)
    # terms are tried shortest first: the likeliest to occur decides soonest
    ordered = [sorted(set(terms), key=lambda t: (len(t), t)) for _, terms in asked]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, top = NamePoints(asked), None
        step = max(1, min(256, MAX_MATRIX_BYTES // (8 * len(asked))))
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            ids, names = batch.column(0), batch.column(1).to_pylist()
            top = top or BestRows(len(asked), k, ids.type)
            scores = np.repeat(points.base[:, None], batch.num_rows, axis=1)
            for r, name in enumerate(names):
                q, more = points.extra(name)
                np.add.at(scores, (q, r), more)
            r, q = np.nonzero(top.wanted(scores, ids).T)
            inside = np.zeros(len(r), dtype=bool)
            row, hay, seen = -1, "", {}
            for i, (at, request) in enumerate(zip(r.tolist(), q.tolist())):
                if at != row:
                    row, hay, seen = at, batch.column(2)[at].as_py() or "", {}
                for t in ordered[request]:
                    there = seen.get(t)
                    if there is None:
                        there = seen[t] = t in hay
                    if there:
                        inside[i] = True
                        break
            r, q = r[inside], q[inside]
            if len(q):
                top.add(q, scores[q, r], ids.take(pa.array(r)))
        if top is not None:
            yield from top.rows(query_ids, ["query_id", "doc_id", "score"])

    return score
