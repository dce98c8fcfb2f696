"""Exact substring dedup by a sampled suffix array with bucket-pointer refinement.

Every 100-byte string that also starts earlier is removed. Bytes get bucket identifiers for 1, 2, 4 ... 64 following
bytes, each made from the identifiers of its two halves, so the identifier at a later offset refines the one before
and all are reused on the next level. Suffixes are sampled at anchors: places whose 32-byte identifier is the least in
some window of 100 bytes. Equal 100-byte strings hold equal anchors at the same place, so nothing is missed.

1. Anchors, one for about 35 bytes, are bucketed by their 32 bytes and refined by the identifier of all bytes within
   100-byte reach, and sorted over the cluster by (bucket, refinement, document, place). A range sort splits buckets of
   any size. An anchor that is not the first of its refined bucket has all strings around it repeated.
2. The first of a refined bucket can share shorter strings with other refinements of the same bucket. For four ways to lay a
   string around the anchor, the 83 bytes that these have in common are compared first. Only 100-byte strings of ways that
   are shared are compared one by one, grouped by identifier; a map task passes on one row for each, however often it
   holds it.
3. Strings that repeat inside one document are found where the document is read.

Documents without any shared bucket are finished where they are scanned; of the others the text travels compressed.
Identifiers have 64 bits; a match takes two independent ones, those of the anchor and of the string around it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from ..plans.catalogue import Catalogue
from .common import SLICE_BYTES, cut, slices, table

CATALOGUE = Catalogue()
LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM
#: Bytes of text worked on at once; longer documents are worked on alone.
BLOCK_BYTES = 1 << 17
#: Bytes of packed texts unpacked at once.
PACKED_BYTES = SLICE_BYTES // 4
#: A document key takes 16 bytes; up to this many are broadcast to pick shared documents in the scan, more are joined by shuffle.
MAX_BROADCAST_KEYS = 2_000_000
#: Ways to lay a string around its anchor: the bytes before it number STEP * way up to STEP * (way + 1).
QUARTERS, STEP = 4, REACH // 4
TAG_BITS, PLACE_BITS = 23, 40
#: Anchors of one bucket held in memory at once.
MAX_HELD = 200_000
LEVELS = (1, 2, 4, 8, 16, 32, 64)
_TABLE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(29)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = a * _A, b * _B
    x += y
    np.right_shift(x, _SHIFT, out=y)
    x ^= y
    return x


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i : i + width] for every i that has so many."""
    size, out = 1, x
    while size * 2 <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    return pick(out[:len(x) - width + 1], out[width - size:width - size + len(x) - width + 1]) if size < width else out


class Block:
    """Some documents' bytes in a row, with identifiers and anchors. Strings never cross documents."""

    def __init__(self, texts: list[bytes]) -> None:
        self.sizes = np.array([len(t) for t in texts])
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        data = np.frombuffer(b"".join(texts) + bytes(2 * LENGTH), np.uint8)
        self.n = len(data) - 2 * LENGTH
        self.ids = {1: _TABLE[data]}
        for size in LEVELS[1:]:
            half = self.ids[size // 2]
            self.ids[size] = _mix(half[:-(size // 2)], half[size // 2:])
        # places where a 100-byte string fits
        self.fits = np.zeros(max(self.n, 1), np.int8)
        long = self.sizes >= LENGTH
        np.add.at(self.fits, self.starts[long], 1)
        edge = self.ends[long] - LENGTH + 1
        np.subtract.at(self.fits, edge[edge < len(self.fits)], 1)
        self.fits = np.cumsum(self.fits, dtype=np.int8).astype(bool)
        if not long.any():
            self.least, self.anchors = np.empty(0, np.uint64), np.empty(0, np.int64)
            return
        gram = self.ids[GRAM]
        self.least = _sliding(gram[:self.n + REACH], REACH + 1, np.minimum)[:self.n]
        usable = np.where(self.fits, self.least, np.uint64(0))
        most = _sliding(np.concatenate([np.zeros(REACH, np.uint64), usable, np.zeros(REACH, np.uint64)]), REACH + 1, np.maximum)[:self.n + REACH]
        self.anchors = np.flatnonzero(most[:self.n] == gram[:self.n])
        self.anchors = self.anchors[most[self.anchors] != 0]
        self.owner = np.searchsorted(self.ends, self.anchors, side="right")

    def identifier(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of size bytes from each place, by the identifiers of its power-of-two pieces."""
        at, left, out = at.copy(), size.copy(), _TABLE[size & 255].copy()
        for piece in (64, *reversed(LEVELS)):
            take = np.flatnonzero(left >= piece)
            out[take] = _mix(out[take], self.ids[piece][at[take]])
            at[take] += piece
            left[take] -= piece
        return out

    def around(self, anchors: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of all 100-byte strings that hold an anchor."""
        return np.maximum(anchors - REACH, self.starts[owner]), np.minimum(anchors + LENGTH, self.ends[owner])

    def refinements(self) -> np.ndarray:
        first, last = self.around(self.anchors, self.owner)
        return _mix(self.identifier(first, last - first), (self.anchors - first).astype(np.uint64))

    def sides(self, anchors: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """16 bits for each of QUARTERS ways to lay a 100-byte string around an anchor: of the identifier of what all strings of that way
        have in common, or of the anchor's own place where the document ends before."""
        size, out = GRAM + REACH - STEP, np.zeros(len(anchors), np.uint64)
        own = _mix(anchors.astype(np.uint64), self.starts[owner].astype(np.uint64) + self.ids[64][anchors])
        for k in range(QUARTERS):
            at = anchors - k * STEP
            inside = (at >= self.starts[owner]) & (at + size <= self.ends[owner])
            bits = np.where(inside, self.identifier(np.where(inside, at, 0), np.full(len(at), size)), own) >> np.uint64(48)
            out |= bits << np.uint64(16 * k)
        return out

    def strings(self, at: np.ndarray) -> np.ndarray:
        return self.identifier(at, np.full(len(at), LENGTH))

    def strings_of(self, anchors: np.ndarray, ways: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the 100-byte strings whose least 32 bytes are at one of the anchors, laid in one of its ways (bits); place of that anchor."""
        first, last = self.around(anchors, owner)
        count = last - first - LENGTH + 1
        at = np.repeat(first - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
        anchor = np.repeat(anchors, count)
        way = np.minimum((anchor - at) // STEP, QUARTERS - 1)
        own = (self.least[at] == self.ids[GRAM][anchor]) & (np.repeat(ways, count) >> way & 1).astype(bool)
        return at[own], anchor[own]


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, Block]]:
    """Consecutive texts in blocks, each with the number of its first text."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BLOCK_BYTES:
            yield first, Block(texts[first:i])
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, Block(texts[first:])


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Indexes of the first row of each combination of all keys but the first, which breaks ties; keys go from least to most important."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys[1:]], axis=0)
    return order[new]


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _tag(text: Column) -> Column:
    """Tells texts under one id apart."""
    return F.pmod(F.xxhash64(text), F.lit(1 << TAG_BITS))


def anchors_of(docs: DataFrame, kind: str) -> DataFrame:
    """(bucket, refined, sides, doc_id, place): every anchor but repeats inside its document. place holds the tag above the offset;
    sides tells for each way to lay a string around the anchor what its strings have in common."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            tags = batch.column(1).to_numpy().astype(np.int64)
            for start, b in _blocks(_bytes_of(batch.column(2))):
                if not len(b.anchors):
                    continue
                bucket, refined = b.ids[GRAM][b.anchors], b.refinements()
                one = _firsts(b.anchors, refined, bucket, b.owner)
                owner = b.owner[one]
                place = (tags[start + owner] << PLACE_BITS) | (b.anchors[one] - b.starts[owner])
                yield pa.RecordBatch.from_arrays([_signed(bucket[one]), _signed(refined[one]), _signed(b.sides(b.anchors[one], owner)),
                                                  batch.column(0).take(pa.array(start + owner)), pa.array(place)], names=["bucket", "refined", "sides", "doc_id", "place"])

    return docs.mapInArrow(find, f"bucket long, refined long, sides long, doc_id {kind}, place long")


def _shared(bucket: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which rows have another row of the same bucket and side."""
    order = np.lexsort((side, bucket))
    same = (bucket[order][1:] == bucket[order][:-1]) & (side[order][1:] == side[order][:-1])
    out = np.zeros(len(bucket), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _judge(rows: pa.Table, sure: bool) -> pa.RecordBatch:
    """Anchors of buckets that need a mark. Where it isn't sure that the buckets are complete, the first of every refinement is open."""
    bucket, refined, sides = (rows.column(i).to_numpy() for i in range(3))
    ids, place = rows.column(3).combine_chunks(), rows.column(4).to_numpy()
    new = np.ones(len(bucket), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (refined[1:] != refined[:-1])
    first = np.flatnonzero(new)
    ways = np.full(len(first), (1 << QUARTERS) - 1)
    if sure:
        ways = sum(_shared(bucket[first], sides[first] >> 16 * k & 0xFFFF).astype(np.int64) << k for k in range(QUARTERS))
        first, ways = first[ways > 0], ways[ways > 0]
    later = np.flatnonzero(~new)
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))[later]
    # a repeated input row is no later one
    twin = place[later] == place[head]
    if twin.any():
        maybe = np.flatnonzero(twin)
        a, b = ids.take(pa.array(later[maybe])).to_pylist(), ids.take(pa.array(head[maybe])).to_pylist()
        twin[maybe] = [x == y for x, y in zip(a, b, strict=True)]
    later = later[~twin]
    at = np.concatenate([first, later])
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(place[at]), pa.array(np.append(ways, np.zeros(len(later), np.int64)))],
                                      names=["doc_id", "place", "ways"])


def judged(anchors: DataFrame, kind: str) -> DataFrame:
    """(doc_id, place, ways): anchors whose strings are all repeated (no ways), and such with strings to compare, by the ways they are laid.

    Strings of one way share 83 bytes around the anchor. They are compared only if another refinement of the anchor's
    bucket has the same 83 bytes. Buckets are read in order. The first and the last of a partition may go on elsewhere,
    and a bucket of more than MAX_HELD rows is read in pieces: of those, the first of every refinement seen is compared in
    any case.
    """
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pieces = None, True  # the first bucket may have begun elsewhere
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            bucket = held.column(0).to_numpy()
            change = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            if len(change) and pieces:
                yield _judge(held.slice(0, change[0]), False)
                held, change, pieces = held.slice(change[0]), change[1:] - change[0], False
            if len(change):
                yield _judge(held.slice(0, change[-1]), True)
                held = held.slice(change[-1])
            if held.num_rows > MAX_HELD:
                yield _judge(held, False)
                held, pieces = held.slice(held.num_rows - 1), True
        if held is not None:
            yield _judge(held, False)

    order = ["bucket", "refined", "doc_id", "place"]
    return anchors.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(judge, f"doc_id {kind}, place long, ways long")


def compared(docs: DataFrame, kind: str) -> DataFrame:
    """(one, two, doc_id, place, known): the strings to compare of (doc_id, tag, packed, marks), their two identifiers and whether
    an earlier one is known already."""
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches, 2, PACKED_BYTES):
            tags = batch.column(1).to_numpy().astype(np.int64)
            texts = [unpack.decompress(z) for z in batch.column(2).to_pylist()]
            marks = batch.column(3)
            for start, b in _blocks(texts):
                anchors, ways, owner = [], [], []
                for i in range(len(b.sizes)):
                    m = marks[start + i].values.to_numpy()
                    m = m[m >= 0]
                    anchors.append((m >> QUARTERS) + b.starts[i])
                    ways.append(m & (1 << QUARTERS) - 1)
                    owner.append(np.full(len(m), i))
                anchors, ways, owner = np.concatenate(anchors), np.concatenate(ways), np.concatenate(owner)
                if not len(anchors):
                    continue
                at, anchor = b.strings_of(anchors, ways, owner)
                one, two = b.strings(at), _mix(b.ids[GRAM][anchor], (anchor - at).astype(np.uint64))
                owner = np.searchsorted(b.ends, at, side="right")
                keep = _firsts(at, one, two, owner)
                at, one, two, owner = at[keep], one[keep], two[keep], owner[keep]
                place = (tags[start + owner] << PLACE_BITS) | (at - b.starts[owner])
                listed = batch.column(0).slice(start, len(b.sizes)).to_pylist()
                rank = {v: r for r, v in enumerate(sorted({v for v in listed if v is not None}), 1)}
                by_id = np.array([rank.get(v, 0) for v in listed])[owner]
                # within the block only the earliest of equal strings is still open
                order = np.lexsort((place, by_id, two, one))
                same = np.zeros(len(order), bool)
                same[1:] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
                head = np.maximum.accumulate(np.where(same, -1, np.arange(len(order))))
                twin = (by_id[order] == by_id[order][head]) & (place[order] == place[order][head])
                known = np.zeros(len(order), bool)
                known[order] = same & ~twin
                # settled rows need no company: their identifiers only spread them
                one[known], two[known] = _mix(place[known].view(np.uint64), one[known]), np.uint64(0)
                yield pa.RecordBatch.from_arrays([_signed(one), _signed(two), batch.column(0).take(pa.array(start + owner)), pa.array(place), pa.array(known)],
                                                 names=["one", "two", "doc_id", "place", "known"])

    rows = docs.mapInArrow(expand, f"one long, two long, doc_id {kind}, place long, known boolean")
    first = F.min(F.struct("doc_id", "place")).over(W.partitionBy("one", "two"))
    return rows.withColumn("first", first).where(F.col("known") | (F.struct("doc_id", "place") > F.col("first"))).select("doc_id", "place")


def _inside(b: Block) -> np.ndarray:
    """Starts of strings that started before in the same document."""
    if not len(b.anchors):
        return np.empty(0, np.int64)
    bucket = b.ids[GRAM][b.anchors]
    order = np.lexsort((bucket, b.owner))
    twice = (bucket[order][1:] == bucket[order][:-1]) & (b.owner[order][1:] == b.owner[order][:-1])
    docs = np.unique(b.owner[order][1:][twice])
    if not len(docs):
        return np.empty(0, np.int64)
    at = np.concatenate([np.arange(b.starts[d], b.ends[d] - LENGTH + 1) for d in docs])
    keep = np.zeros(len(at), bool)
    keep[_firsts(at, b.strings(at), np.searchsorted(b.ends, at, side="right"))] = True
    return at[~keep]


def _finish(b: Block, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask of removed bytes, where removed runs begin) for a block; strings repeated inside documents are added."""
    inside = _inside(b)
    edge = np.bincount(np.concatenate([starts, inside]), minlength=b.n + 1).astype(np.int64)
    edge -= np.bincount(np.concatenate([ends, inside + LENGTH]), minlength=b.n + 1)
    gone = np.cumsum(edge)[:b.n] > 0
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    first = b.starts[b.sizes > 0]
    begins[first] = gone[first]
    return gone, begins


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _report(data: list[bytes], b: Block, gone: np.ndarray, begins: np.ndarray, with_text: bool) -> list[pa.Array]:
    kept = []
    for text, s, e in zip(data, b.starts, b.ends, strict=True):
        mask = gone[s:e]
        kept.append(np.frombuffer(text, np.uint8)[~mask].tobytes() if mask.any() else text)
    total = lambda x: np.diff(np.append(0, np.cumsum(x)[b.ends - 1] * (b.ends > 0))) if b.n else np.zeros(len(b.sizes), np.int64)
    out = [pa.array(b.sizes), pa.array(total(gone)), pa.array(total(begins)), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
    if with_text:
        out.append(pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()))
    return out


def dedup_substrings(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
                     carry: list[str] | None = None, max_broadcast_keys: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """(doc_id, tag, n_bytes, n_removed, n_spans, kept_sha256[, kept_text][, rest]): one row per document row; rest is a struct of the
    columns to carry along.

    Null is empty. Rows of one id with different texts are different documents, ordered by a hash of the text; exact
    repeats of a row count as one document, and all get its result. A null id comes before all others. Texts under
    100 bytes and empty tables lose nothing. kept_text drops bytes that a cut left of a UTF-8 character. Other
    columns are ignored, whatever their names.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col).alias("doc_id"), _tag(F.col(text_col)).alias("tag"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                            *([F.struct(*carry).alias("rest")] if carry else []))
    rest = ["rest"] if carry else []
    names = ["doc_id", "tag", *[f.split()[0] for f in RESULT.split(", ")], *(["kept_text"] if with_text else []), *rest]
    schema = StructType([*StructType.fromDDL(f"doc_id {kind}, tag long, {RESULT}" + ", kept_text string" * with_text).fields,
                         *(docs.schema[c] for c in rest)])

    tag, offset = F.shiftright("place", PLACE_BITS), F.col("place").bitwiseAND((1 << PLACE_BITS) - 1)
    # anchors whose strings are all repeated are stored as negative numbers
    mark = F.when(F.col("ways") == 0, -1 - offset).otherwise(F.shiftleft(offset, QUARTERS) + F.col("ways"))
    marks = cut(judged(anchors_of(docs, kind), kind).select("doc_id", tag.alias("tag"), mark.alias("mark"))
                .groupBy("doc_id", "tag").agg(F.collect_list("mark").alias("marks")))
    near = (lambda df: F.broadcast(df)) if marks.count() <= max_broadcast_keys else (lambda df: df)
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tag"] == b["tag"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, 2):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([squeeze.compress(t) for t in _bytes_of(batch.column(2))], pa.binary()),
                                              *batch.columns[3:]], names=["doc_id", "tag", "packed", *batch.schema.names[3:]])

    def picked(keys: DataFrame, more: list[str]) -> DataFrame:
        keys = keys.select("doc_id", "tag")
        found = docs.join(near(keys), same(docs, keys), "left_semi").select("doc_id", "tag", "text", *more)
        return found.mapInArrow(pack, StructType([*StructType.fromDDL(f"doc_id {kind}, tag long, packed binary").fields, *(docs.schema[c] for c in more)]))

    open_marks = marks.where(F.exists("marks", lambda m: m >= 0))
    texts = picked(open_marks, [])
    to_compare = texts.hint("merge").join(open_marks, same(texts, open_marks)).select(texts["doc_id"], texts["tag"], "packed", "marks")
    found = (compared(to_compare, kind).select("doc_id", tag.alias("tag"), offset.alias("start"))
             .groupBy("doc_id", "tag").agg(F.collect_list("start").alias("found")))
    removed = marks.join(found, same(marks, found), "left").select(
        marks["doc_id"], marks["tag"], "marks", F.coalesce("found", F.array().cast("array<bigint>")).alias("found"))

    def finish_plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        for batch in slices(batches, 2):
            data = _bytes_of(batch.column(2))
            for start, b in _blocks(data):
                n = len(b.sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), batch.column(1).slice(start, n),
                                                  *_report(data[start:start + n], b, *_finish(b, none, none), with_text),
                                                  *(c.slice(start, n) for c in batch.columns[3:])], names=names)

    def finish_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches, 2, PACKED_BYTES):
            data = [unpack.decompress(z) for z in batch.column(2).to_pylist()]
            marks, found = batch.column(3), batch.column(4)
            for start, b in _blocks(data):
                n, starts, ends = len(b.sizes), [], []
                for i in range(n):
                    m = marks[start + i].values.to_numpy()
                    first, last = b.around(-1 - m[m < 0] + b.starts[i], np.full((m < 0).sum(), i))
                    f = found[start + i].values.to_numpy() + b.starts[i]
                    starts += [first, f]
                    ends += [last, f + LENGTH]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), batch.column(1).slice(start, n),
                                                  *_report(data[start:start + n], b, *_finish(b, np.concatenate(starts), np.concatenate(ends)), with_text),
                                                  *(c.slice(start, n) for c in batch.columns[5:])], names=names)

    keys = marks.select("doc_id", "tag")
    plain = docs.join(near(keys), same(docs, keys), "left_anti").mapInArrow(finish_plain, schema)
    texts = picked(marks, rest)
    shared = texts.hint("merge").join(removed, same(texts, removed)).select(texts["doc_id"], texts["tag"], "packed", "marks", "found", *rest).mapInArrow(finish_shared, schema)
    return plain.unionByName(shared)


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents with every repeated 100-byte string cut out of the text; a text that is all repeats becomes empty, a null one too."""
    others = [c for c in documents.columns if c not in (id_col, text_col)]
    found = dedup_substrings(documents, id_col, text_col, with_text=True, carry=others)
    columns = {id_col: F.col("doc_id"), text_col: F.col("kept_text"), **{c: F.col("rest").getField(c) for c in others}}
    return found.select(*[columns[c].alias(c) for c in documents.columns])


@CATALOGUE.register("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("tag")
