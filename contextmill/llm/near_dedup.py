"""MinHash near-dedup of shingle multisets with BagMinHash signatures.

A text is the multiset of its five-word shingles. For each shingle and each weight interval (0,1], (1,2], (2,4], (4,8] ...
a Poisson process, seeded by shingle and interval, yields points in time at a rate of the interval's length; a point has a
component and a weight inside its interval, and counts for texts that hold the shingle at least that often. The
first point of every component is the signature; two texts agree in a component with the probability of their
weighted Jaccard similarity. Processes are followed only until every component of the text has an earlier point.

Texts with equal multisets are merged first. Signatures are cut into bands; texts with an equal band share a bucket. In a
bucket, members are compared with leaders, not with each other. A member's fame is the size of all its buckets: the text
that others were copied from agrees with each of them more than they do among themselves, so it is the most famous one in
every bucket it is in, leads it, and takes one comparison per copy. Where members of a bucket still lie in different groups
afterwards, more lead, thirty-two times as many each round. Members of such buckets get sketches, one bit of each of 2048
more components; pairs whose sketches differ five standard deviations more than a similarity of 0.8 lets expect are dropped
inside the join, each other pair is verified on the whole multisets. A bucket is done when its members are connected or all
have led, so no pair is left out for size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..plans.catalogue import Catalogue
from .common import cut, slices, table

CATALOGUE = Catalogue()
WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
COMPONENTS = BANDS * ROWS
#: Components, of one bit each, of the sketch that pairs are screened by after the first round.
SKETCH_BITS = 2048
#: What a task hashes at once: so many bytes of texts, and so many components of their signatures or sketches.
BLOCK_BYTES, BLOCK_COMPONENTS = 1 << 18, 1 << 18
#: So many times more leaders lead a bucket in each round.
GROWTH = 32
#: Members of an undecided bucket that meet its leaders in one task.
SLICE_ROWS = 1024
#: Shingles of texts that a task keeps while it verifies pairs.
HELD_SHINGLES = 2_000_000
#: A key or bucket row takes at most 48 bytes; up to this many are broadcast, more are joined by shuffle.
MAX_BROADCAST_ROWS = 200_000
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_S30, _S27, _S31, _S11, _S32 = (np.uint64(x) for x in (30, 27, 31, 11, 32))
_BYTES = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_POWERS = np.cumprod(np.full(4096, _A), dtype=np.uint64)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S30)) * _B
    x = (x ^ (x >> _S27)) * _C
    return x ^ (x >> _S31)


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count) of all texts, sorted. Words are runs of letters, digits and bytes beyond ASCII, A-Z lower-cased;
    a text of fewer words is one shingle, one without words has none."""
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    inside = _IN_WORD[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    lengths = end - start
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    word = _scramble(np.add.reduceat(_BYTES[_LOWER[data[inside]]] * _POWERS[place & 4095], first) + lengths.astype(np.uint64))
    owner = np.searchsorted(ends, start, side="right")
    count = np.bincount(owner, minlength=len(texts))
    out, of = [], []
    if len(word) >= words:
        full = np.flatnonzero(owner[words - 1:] == owner[:len(owner) - words + 1])
        h = np.zeros(len(full), np.uint64)
        for k in range(words):
            h = _scramble(h * _D + word[full + k])
        out.append(h)
        of.append(owner[full])
    begin = np.cumsum(count) - count
    for n in range(1, words):
        short = np.flatnonzero(count == n)
        h = np.full(len(short), n, np.uint64)
        for k in range(n):
            h = _scramble(h * _D + word[begin[short] + k])
        out.append(h)
        of.append(short)
    h, of = np.concatenate(out), np.concatenate(of)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return of[at], h[at], np.diff(np.append(at, len(h)))


def bag_minhash(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, components: int = COMPONENTS) -> np.ndarray:
    """First points (n, components) of the processes that belong to each of n texts; infinite for texts without shingles."""
    h = np.full((n, components), np.inf)
    flat, every = h.reshape(-1), 1 + components // 256
    ids, of, limit, low, rate = [shingle], [owner], [weight], [np.zeros(len(weight), np.int64)], [np.ones(len(weight))]
    level, base = 1, 1
    while (more := np.flatnonzero(weight > base)).size:
        ids.append(_scramble(shingle[more] + np.array([level], np.uint64) * _D))
        of.append(owner[more])
        limit.append(weight[more])
        low.append(np.full(len(more), base))
        rate.append(np.full(len(more), float(base)))
        level, base = level + 1, base * 2
    ids, of, limit, low, rate = map(np.concatenate, (ids, of, limit, low, rate))
    time, point, turn, latest = np.zeros(len(ids)), np.zeros(1, np.uint64), 0, None
    while len(ids):
        point += _A
        r = _scramble(ids + point)
        time = time - np.log(((r >> _S11).astype(np.float64) + 0.5) * 2.0**-53) / (rate * components)
        # an older, later limit only lets more points through
        if turn % every == 0:
            latest = h.max(axis=1)
        turn += 1
        live = time < latest[of]
        ids, of, limit, low, rate, time, r = (x[live] for x in (ids, of, limit, low, rate, time, r))
        mark = _scramble(r ^ _D)
        component = ((mark >> _S32) * np.uint64(components) >> _S32).astype(np.int64)
        # the point's weight in the interval (low, low + rate]
        held = low + 1 + ((mark & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * rate).astype(np.int64) <= limit
        np.minimum.at(flat, of[held] * components + component[held], time[held])
    return h


def band_keys(h: np.ndarray) -> np.ndarray:
    bits = h.view(np.uint64).reshape(len(h), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _D, bits.shape[:2]).copy()
    for k in range(ROWS):
        key = _scramble(key * _A + bits[:, :, k])
    return key


def sketch_of(h: np.ndarray) -> np.ndarray:
    """One bit of every component, packed into whole numbers."""
    bits = (_scramble(h.view(np.uint64)) & np.uint64(1)).reshape(len(h), -1, 64)
    return np.bitwise_or.reduce(bits << np.arange(64, dtype=np.uint64), axis=2)


def promising(a: str, b: str) -> Column:
    """Whether two sketches may belong to texts of SIMILARITY: they differ in at most five standard deviations more bits than such do on average."""
    share = (1 - SIMILARITY) / 2
    most = int(SKETCH_BITS * share + 5 * (SKETCH_BITS * share * (1 - share)) ** 0.5)
    differ = sum((F.bit_count(F.element_at(a, i).bitwiseXOR(F.element_at(b, i))) for i in range(1, SKETCH_BITS // 64 + 1)), F.lit(0))
    return differ <= most


def _blocks(texts: list[bytes], components: int) -> Iterator[tuple[int, list[bytes]]]:
    first, size, most = 0, 0, max(1, BLOCK_COMPONENTS // components)
    for i, text in enumerate(texts):
        if size and size + len(text) > BLOCK_BYTES or i - first == most:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, texts[first:]


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows).view(np.int64).reshape(-1)))


def _digests(of: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int) -> list[pa.Array]:
    """Two sums of 64 bits over each text's multiset."""
    out = []
    for salt in (_B, _C):
        sums = np.zeros(n, np.uint64)
        np.add.at(sums, of, _scramble(shingle * salt + count.astype(np.uint64)))
        out.append(pa.array(sums.view(np.int64)))
    return out


def _nodes(ids: pa.Array, digests: list[pa.Array]) -> pa.StructArray:
    """A text is known by its id and multiset, so that different texts under one id stay apart."""
    return pa.StructArray.from_arrays([ids, *digests], names=["id", "d1", "d2"])


def node_type(texts: DataFrame) -> str:
    return f"struct<id:{texts.schema['doc_id'].dataType.simpleString()},d1:long,d2:long>"


def sketches(texts: DataFrame) -> DataFrame:
    """(rep, sketch) of (doc_id, text), once for each node."""
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            data = [b"" if t is None else t for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for start, part in _blocks(data, SKETCH_BITS):
                bags = shingles(part)
                nodes = _nodes(batch.column(0).slice(start, len(part)), _digests(*bags, len(part)))
                yield pa.RecordBatch.from_arrays([nodes, _lists(sketch_of(bag_minhash(*bags, len(part), SKETCH_BITS)))], names=["rep", "sketch"])

    drawn = texts.select("doc_id", "text").mapInArrow(draw, f"rep {node_type(texts)}, sketch array<long>")
    return drawn.groupBy("rep").agg(F.min("sketch").alias("sketch"))


def signatures(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, total, d1, d2, bands): number of shingles, a 128-bit digest of the multiset and the band keys."""
    kind = documents.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            data = [b"" if t is None else t for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for start, texts in _blocks(data, COMPONENTS):
                n = len(texts)
                of, shingle, count = shingles(texts)
                total = np.bincount(of, weights=count, minlength=n).astype(np.int64)
                digests = _digests(of, shingle, count, n)
                keys = _lists(band_keys(bag_minhash(of, shingle, count, n)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), pa.array(total), *digests, keys], names=["doc_id", "total", "d1", "d2", "bands"])

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        sign, f"doc_id {kind}, total long, d1 long, d2 long, bands array<long>")


def near(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it was counted and is small."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def verify(pairs: DataFrame, texts: DataFrame, similarity: float, words: int = WORDS) -> DataFrame:
    """(a, b) of those pairs of nodes whose multisets overlap enough. texts has (doc_id, text)."""
    kind = node_type(texts)
    wanted = cut(pairs.select(F.col("a.id").alias("doc_id")).unionByName(pairs.select(F.col("b.id").alias("doc_id"))).distinct())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, 1):
            data = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for start, part in _blocks(data, COMPONENTS):
                nodes = _nodes(batch.column(0).slice(start, len(part)), _digests(*shingles(part, words), len(part)))
                yield pa.RecordBatch.from_arrays([nodes, pa.array([squeeze.compress(t) for t in part], pa.binary())], names=["node", "packed"])

    packed = (texts.join(near(wanted, wanted.count()), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(pack, f"node {kind}, packed binary")
              .groupBy("node").agg(F.min("packed").alias("packed")))
    left = packed.select(F.col("node").alias("a"), F.col("packed").alias("pa"))
    right = packed.select(F.col("node").alias("b"), F.col("packed").alias("pb"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, bags, held = zstandard.ZstdDecompressor(), {}, 0
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                pair = []
                for column in (2, 3):
                    packed = batch.column(column)[i].as_py()
                    if (found := bags.get(packed)) is None:
                        if held > HELD_SHINGLES:
                            bags, held = {}, 0
                        found = bags[packed] = shingles([unpack.decompress(packed)], words)[1:]
                        held += len(found[0]) + 100
                    pair.append(found)
                (x, n), (y, m) = pair
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = np.flatnonzero(y[at] == x) if len(y) else at[:0]
                shared = np.minimum(n[both], m[at[both]]).sum()
                good[i] = shared >= similarity * (n.sum() + m.sum() - shared) - 1e-9
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb").mapInArrow(compare, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(node, group): the least node each node is connected to. edges has (a, b). Labels move along edges and jump along labels."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("group")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "group"), "b").groupBy("a").agg(F.min("group").alias("m"))
        moved = labels.join(heard, labels["node"] == heard["a"]).select("node", F.col("group").alias("old"), F.least("group", "m").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("group").alias("further"))
        moved = cut(moved.join(jump, "to", "left").select("node", "old", F.least("to", "further").alias("group")))
        labels = moved.select("node", "group")
        if moved.where("group < old").limit(1).count() == 0:
            return labels


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups after links (a, b) between nodes were added: only the groups that they connect are worked on."""
    of = lambda node, name: groups.select(F.col("node").alias(node), F.col("group").alias(name))
    between = links.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left").select(
        "a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")).where("x <> y")
    between = cut(between.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    if between.limit(1).count() == 0:
        return groups
    moved = components(between)
    fresh = moved.join(groups.select("node"), "node", "left_anti")
    renamed = groups.join(moved.select(F.col("node").alias("group"), F.col("group").alias("to")), "group", "left").select("node", F.coalesce("to", "group").alias("group"))
    return cut(renamed.unionByName(fresh))


def _labelled(documents: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(doc_id, class_id, copy_of, total, d1, d2) of every row; the digest is null for texts without words."""
    signed = cut(signatures(documents, id_col, text_col))
    same = signed.where((F.col("total") > 0) & F.col("doc_id").isNotNull())
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    nodes = cut(same.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.max("total").alias("total"), F.first("bands").alias("bands"))
                .select(F.struct("id", "d1", "d2").alias("rep"), "total", "bands"))
    rows = nodes.select("rep", "total", F.explode("bands").alias("key"))

    # first round: one leader per bucket, the member of most fame
    sizes = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    n_buckets = sizes.count()
    held = cut(rows.join(near(sizes, n_buckets), "key"))
    members = cut(held.drop("n").join(held.groupBy("rep").agg(F.sum("n").alias("fame")), "rep").withColumn("luck", F.xxhash64("rep")))
    led = cut(members.groupBy("key").agg(F.min(F.struct(-F.col("fame"), "luck", "rep", "total")).alias("l"))
              .select("key", F.col("l.rep").alias("leader"), F.col("l.total").alias("size")))
    followers = members.join(near(led, n_buckets), "key").where("rep <> leader")
    # a multiset cannot overlap enough with one of another size
    alike = F.least("total", "size") >= F.lit(similarity) * F.greatest("total", "size") - 1e-9
    a_b = [F.greatest("rep", "leader").alias("a"), F.least("rep", "leader").alias("b")]
    groups = components(cut(verify(cut(followers.where(alike).select(*a_b).distinct()), texts, similarity)))
    open_rows, share = followers.select("key", "rep", "total", "fame", "luck"), 1
    while True:
        labelled = open_rows.join(groups, open_rows["rep"] == groups["node"], "left").drop("node").withColumn("group", F.coalesce("group", "rep"))
        apart = labelled.groupBy("key").agg(F.min("group").alias("x"), F.max("group").alias("y"), F.count("*").alias("n")).where("x <> y")
        apart = apart.select("key", (1 + F.col("n") / SLICE_ROWS).cast("int").alias("slices"))
        labelled = cut(labelled.join(apart, "key"))
        if labelled.isEmpty():
            break
        if share == 1:
            # what only members of undecided buckets need: their sketches and all their band keys, which take ten times a key row
            reps = cut(labelled.select("rep").distinct())
            n_reps = reps.count()
            drawn = sketches(texts.join(near(reps.select(F.col("rep.id").alias("doc_id")), n_reps), "doc_id", "left_semi"))
            bands = nodes.join(near(reps, n_reps), "rep", "left_semi").select("rep", "bands")
            extra = near(cut(drawn.join(bands, "rep")), 10 * n_reps)
        share *= GROWTH
        ranked = labelled.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.desc("fame"), "luck", "rep")))
        led = cut(ranked.where(F.col("rank") <= share).select("key", F.col("rep").alias("leader"), F.col("total").alias("size"), F.col("group").alias("home"), "slices"))
        # a pair is named in the first bucket that it shares
        shared = F.filter(F.zip_with("bands", "lead_bands", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
        once = F.get(shared, F.lit(0)) == F.col("key")
        # followers of a large bucket are dealt over slices, each of which all leaders visit
        leading = led.join(extra.toDF("leader", "lead", "lead_bands"), "leader").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
        following = labelled.join(extra, "rep").withColumn("slice", F.pmod("luck", "slices").cast("int"))
        fresh = cut(following.join(leading, ["key", "slice"]).where((F.col("group") != F.col("home")) & alike & promising("sketch", "lead") & once)
                    .select(*a_b).distinct())
        if not fresh.isEmpty():
            groups = merged(groups, cut(verify(fresh, texts, similarity)))
        open_rows = labelled.drop("group", "slices").join(led.select("key", F.col("leader").alias("rep")), ["key", "rep"], "left_anti")
    of_text = nodes.join(groups, nodes["rep"] == groups["node"], "left").select(
        "rep.d1", "rep.d2", F.col("rep.id").alias("copy_of"), F.coalesce("group", "rep").getField("id").alias("group"))
    keyed = signed.select("doc_id", "total", F.when(F.col("total") > 0, F.col("d1")).alias("d1"), F.when(F.col("total") > 0, F.col("d2")).alias("d2"))
    none, some = keyed.where("d1 IS NULL"), keyed.where("d1 IS NOT NULL")
    own = F.when(F.col("doc_id").isNotNull(), F.col("group"))
    return (some.join(of_text, ["d1", "d2"], "left").select("doc_id", own.alias("class_id"), "copy_of", "total", "d1", "d2")
            .unionByName(none.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), "total", "d1", "d2")))


def near_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, copy_of, total): one row per document row; class_id is the least id of the group.

    copy_of is the least id with the same multiset. Texts without words (null, empty) are groups of their own. Rows with a null id
    keep a null class and link nothing. Repeated rows give repeated rows; different texts under one id are grouped each
    by its own shingles. Other columns are ignored; an empty table gives an empty result.
    """
    return _labelled(documents, id_col, text_col, similarity).drop("d1", "d2")


def drop_near_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """documents without near copies: of each group the row of the least id stays.

    Rows with a null id stay. Several rows under one id are judged text by text: of rows with equal shingles the least one stays,
    if its group has no lesser id; rows without words are one text of their id. Near copies of different shingles under the
    one id that leads their group all stay.
    """
    judged = cut(_labelled(documents, id_col, text_col, similarity).where("doc_id IS NOT NULL").groupBy("doc_id", "d1", "d2").agg(
        F.count("*").alias("n"), F.max((F.col("doc_id") == F.col("class_id")).cast("int")).alias("stays")))
    found = cut(judged.groupBy("doc_id").agg(F.sum("n").alias("n"), F.max("stays").alias("stays")).where("stays = 0 OR n > 1"))
    repeated = found.where("stays = 1").select(F.col("doc_id").alias("_again"))
    n_found, n_repeated = found.count(), repeated.count()
    kept = documents.join(near(found.select(F.col("doc_id").alias("_gone")), n_found), F.col(id_col) == F.col("_gone"), "left_anti")
    if n_repeated == 0:
        return kept
    rows = documents.join(near(repeated, n_repeated), F.col(id_col) == F.col("_again"), "left_semi")
    key = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    rows = rows.select(F.col(id_col).alias("_id"), key.alias("_key"), F.struct(*documents.columns).alias("_row"))
    texts = rows.select("_key", F.col(f"_row.{text_col}").alias("_text")).groupBy("_key").agg(F.min("_text").alias("_text"))
    digest = [F.when(F.col("total") > 0, F.col(d)).alias(f"_{d}") for d in ("d1", "d2")]
    digests = signatures(texts, "_key", "_text").select(F.col("doc_id").alias("_key"), *digest)
    stay = judged.where("stays = 1").drop("n", "stays")
    of_text = (F.col("_id") == stay["doc_id"]) & F.col("_d1").eqNullSafe(stay["d1"]) & F.col("_d2").eqNullSafe(stay["d2"])
    least = rows.join(digests, "_key").join(stay, of_text, "left_semi").groupBy("_id", "_d1", "_d2").agg(F.min("_row").alias("_row"))
    return kept.unionByName(least.select("_row.*"))


@CATALOGUE.register("op7_near_dedup")
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_of", F.col("total").alias("n_shingles"))
