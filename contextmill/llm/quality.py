"""Quality classifier: a byte-level convolutional network in numpy.

Bytes become learned vectors of 8 numbers plus one fixed channel that marks bytes which repeat what stood up to 20
bytes before. Filters of 8 bytes slide with stride 4; their rectified outputs are averaged in chunks of 256 bytes that
overlap by half and cover the whole text. A small dense layer describes each chunk; descriptions are max-pooled
over all chunks, averaged as well, and combined into one probability.

The network is trained by gradient descent in numpy on a bounded sample of labelled rows. Texts are scored where
they are scanned, in blocks of bounded size, so neither long texts nor large batches need much memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..plans.catalogue import Catalogue
from .common import table

CATALOGUE = Catalogue()
CHUNK, HALF, WIDTH, STRIDE = 256, 128, 8, 4
EMBED, FILTERS, HIDDEN = 8, 24, 12
SLOTS = HALF // STRIDE  # filter outputs per half chunk
MAX_LAG = 20
#: At most this many labelled rows are learned from, those with the smallest hash of their id, and of each text at most
#: this many half chunks, evenly spread in runs of two.
MAX_TRAINING_ROWS = 4_000
MAX_TRAINING_HALVES = 48
EPOCHS, BATCH, RATE = 14, 64, 4e-3
#: Small samples are gone through more often, up to so many steps.
MIN_STEPS = 500
#: Half chunks convolved at once.
BLOCK = 4096


def repeats(data: np.ndarray) -> np.ndarray:
    """1 where the four bytes ending here also end 3 to MAX_LAG bytes before; data is uint8."""
    out = np.zeros(len(data), np.float32)
    if len(data) < 8:
        return out
    x = data.astype(np.uint32)
    gram = x[3:] | x[2:-1] << 8 | x[1:-2] << 16 | x[:-3] << 24
    hit = np.zeros(len(gram), bool)
    for lag in range(3, min(MAX_LAG, len(gram) - 1) + 1):
        hit[lag:] |= gram[lag:] == gram[:-lag]
    out[3:] = hit
    return out


def halves_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The text's bytes as rows of HALF + WIDTH - STRIDE bytes, zero-padded, with the repeat channel. At least two rows."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    rows = max(2, -(-len(data) // HALF))
    size = rows * HALF + WIDTH - STRIDE
    padded, marks = np.zeros(size, np.uint8), np.zeros(size, np.float32)
    padded[:len(data)], marks[:len(data)] = data, repeats(data)
    window = HALF + WIDTH - STRIDE
    cut = lambda a: np.lib.stride_tricks.as_strided(a, (rows, window), (a.strides[0] * HALF, a.strides[0]))
    return cut(padded), cut(marks)


class ByteConvNet:
    """Parameters, forward pass and gradients."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        normal = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {"emb": normal(256, EMBED, scale=0.5), "conv": normal(WIDTH * (EMBED + 1), FILTERS, scale=0.15), "cb": np.zeros(FILTERS, np.float32),
                  "dense": normal(FILTERS, HIDDEN, scale=0.4), "db": np.zeros(HIDDEN, np.float32),
                  "out": normal(2 * HIDDEN, scale=0.3), "ob": np.zeros(1, np.float32)}

    def _windows(self, data: np.ndarray, marks: np.ndarray) -> np.ndarray:
        n = len(data)
        x = np.empty((n, data.shape[1], EMBED + 1), np.float32)
        x[:, :, :EMBED] = self.p["emb"][data]
        x[:, :, EMBED] = marks
        s = x.strides
        view = np.lib.stride_tricks.as_strided(x, (n, SLOTS, WIDTH, EMBED + 1), (s[0], s[1] * STRIDE, s[1], s[2]))
        return view.reshape(n * SLOTS, WIDTH * (EMBED + 1))

    def local(self, data: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Mean rectified filter outputs of half chunks."""
        out = np.empty((len(data), FILTERS), np.float32)
        for i in range(0, len(data), BLOCK):
            z = self._windows(data[i:i + BLOCK], marks[i:i + BLOCK]) @ self.p["conv"] + self.p["cb"]
            np.maximum(z, 0, out=z)
            out[i:i + BLOCK] = z.reshape(-1, SLOTS, FILTERS).mean(axis=1)
        return out

    def combine(self, local: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probability per text; starts says where each text's half chunks begin. Overlapping chunks are pairs of halves."""
        ends = np.append(starts[1:], len(local))
        keep = np.ones(len(local), bool)
        keep[ends - 1] = False
        pair = (local + np.roll(local, -1, axis=0))[keep] / 2
        first = starts - np.arange(len(starts))
        h = np.tanh(pair @ self.p["dense"] + self.p["db"])
        pooled = np.hstack([np.maximum.reduceat(h, first), np.add.reduceat(h, first) / (ends - starts - 1)[:, None]])
        return 1 / (1 + np.exp(-np.clip(pooled @ self.p["out"] + self.p["ob"], -30, 30)))

    def gradients(self, texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> dict[str, np.ndarray]:
        data, marks = np.vstack([d for d, _ in texts]), np.vstack([m for _, m in texts])
        sizes = np.array([len(d) for d, _ in texts])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        p, x = self.p, self._windows(data, marks)
        z = x @ p["conv"] + p["cb"]
        local = np.maximum(z, 0).reshape(-1, SLOTS, FILTERS).mean(axis=1)
        keep = np.ones(len(local), bool)
        keep[ends - 1] = False
        at = np.flatnonzero(keep)
        pair = (local[at] + local[at + 1]) / 2
        h = np.tanh(pair @ p["dense"] + p["db"])
        first, count = starts - np.arange(len(starts)), sizes - 1
        top = np.maximum.reduceat(h, first)
        pooled = np.hstack([top, np.add.reduceat(h, first) / count[:, None]])
        q = 1 / (1 + np.exp(-np.clip(pooled @ p["out"] + p["ob"], -30, 30)))
        g = (q - y) / len(y)
        of = np.repeat(np.arange(len(sizes)), count)
        share = (h == top[of]).astype(np.float32)
        share /= np.add.reduceat(share, first)[of]
        gh = (g[:, None] * p["out"][:HIDDEN])[of] * share + ((g / count)[:, None] * p["out"][HIDDEN:])[of]
        gh *= 1 - h * h
        gl = np.zeros_like(local)
        gp = gh @ p["dense"].T / 2
        np.add.at(gl, at, gp)
        np.add.at(gl, at + 1, gp)
        gz = np.repeat(gl / SLOTS, SLOTS, axis=0) * (z > 0)
        gx = (gz @ p["conv"].T).reshape(len(data), SLOTS, WIDTH, EMBED + 1)[..., :EMBED]
        s = data.strides
        bytes_at = np.lib.stride_tricks.as_strided(data, (len(data), SLOTS, WIDTH), (s[0], s[1] * STRIDE, s[1])).reshape(-1)
        flat = gx.reshape(-1, EMBED)
        emb = np.stack([np.bincount(bytes_at, weights=flat[:, k], minlength=256) for k in range(EMBED)], axis=1).astype(np.float32)
        return {"emb": emb, "conv": x.T @ gz, "cb": gz.sum(axis=0), "dense": pair.T @ gh, "db": gh.sum(axis=0), "out": pooled.T @ g, "ob": np.array([g.sum()])}

    def train(self, texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        """Adam with a falling rate."""
        r, t = np.random.default_rng(seed), 0
        epochs = max(epochs, -(-MIN_STEPS // -(-len(texts) // BATCH)))
        m, v = ({k: np.zeros_like(a, dtype=np.float32) for k, a in self.p.items()} for _ in range(2))
        steps = max(1, epochs * -(-len(texts) // BATCH))
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for i in range(0, len(order), BATCH):
                pick = order[i:i + BATCH]
                t += 1
                rate = RATE * (1 - 0.95 * t / steps)
                for k, g in self.gradients([texts[j] for j in pick], y[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities; the half chunks of many texts share a block."""
        local, sizes, block, waiting = [], [], [], 0
        for text in texts:
            data, marks = halves_of(text)
            sizes.append(len(data))
            block.append((data, marks))
            waiting += len(data)
            if waiting >= BLOCK:
                local.append(self._block(block))
                block, waiting = [], 0
        if block:
            local.append(self._block(block))
        if not sizes:
            return np.empty(0)
        return self.combine(np.vstack(local), np.cumsum(sizes) - np.array(sizes))

    def _block(self, block: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if len(block) == 1:
            return self.local(*block[0])
        return self.local(np.vstack([d for d, _ in block]), np.vstack([m for _, m in block]))


def _sampled(text: str | None) -> tuple[bytes, bytes, int]:
    data, marks = halves_of(text)
    if len(data) > MAX_TRAINING_HALVES:
        firsts = np.linspace(0, len(data) - 2, MAX_TRAINING_HALVES // 2).astype(int)
        rows = np.unique(np.concatenate([firsts, firsts + 1]))
        data, marks = data[rows], marks[rows]
    return data.tobytes(), marks.astype(np.uint8).tobytes(), len(data)


def fit_quality(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                max_rows: int = MAX_TRAINING_ROWS) -> ByteConvNet:
    """A trained network. At most max_rows labelled rows reach the driver, each as at most 13 kB.

    Null labels and ids are ignored; of repeated labels of an id the smallest counts. Without labels the network is untrained.
    """
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("y"))
             .orderBy(F.xxhash64("_id"), "_id").limit(max_rows))
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "_id").select("_id", "text", "y")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_sampled(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.binary()),
                                              pa.array([g[2] for g in got], pa.int32())], names=["_id", "y", "data", "marks", "n"])

    kind = rows.schema["_id"].dataType.simpleString()
    got = rows.mapInArrow(sample, f"_id {kind}, y int, data binary, marks binary, n int").toArrow().sort_by("_id")
    net, texts = ByteConvNet(), []
    for d, m, n in zip(got["data"].to_pylist(), got["marks"].to_pylist(), got["n"].to_pylist(), strict=True):
        texts.append((np.frombuffer(d, np.uint8).reshape(n, -1), np.frombuffer(m, np.uint8).reshape(n, -1).astype(np.float32)))
    y = got["y"].to_numpy().astype(np.float32)
    if len(texts) and 0 < y.mean() < 1:
        net.train(texts, y)
    return net


def score_quality(documents: DataFrame, net: ByteConvNet, text_col: str = "text") -> DataFrame:
    """documents with quality_score (0 to 1). Null and empty texts are scored as chunks of zero bytes; repeats score alike."""
    kept = documents.drop("quality_score")
    at = kept.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(net.score(batch.column(at).to_pylist()).astype(np.float64), pa.float64())],
                                             names=[*batch.schema.names, "quality_score"])

    return kept.mapInArrow(score, StructType([*kept.schema.fields, *StructType.fromDDL("quality_score double").fields]))


def training_labels(labels: DataFrame) -> DataFrame:
    """Rows that may be learned from: crc32 of the id as text, modulo 5, is not 0."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


@CATALOGUE.register("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    net = fit_quality(documents, training_labels(table(spark, sf_dir, "labels")))
    return score_quality(documents.select("doc_id", "text"), net).select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))
