"""Embedding models as Spark functions.

An embedder turns a batch of texts into vectors of one size. It runs inside the tasks, in Arrow batches;
the model is created once per Python worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

DIMS = 768
BATCH = 32


class Embedder(Protocol):
    """Fixed interface: texts in, one row of `dims` numbers per text out."""

    dims: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Deterministic feature hashing of words (signed buckets, unit length). Not a semantic model: it
    stands in where none is available."""

    def __init__(self, dims: int = DIMS) -> None:
        self.dims = dims

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in re.findall(r"\w+", (text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[row, h % self.dims] += 1.0 if h >> 63 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)


class OnnxEmbedder:
    """A local ONNX sentence model (mean-pooled, unit length), with its tokenizer file."""

    def __init__(self, model_path: str, tokenizer_path: str, dims: int = DIMS, max_tokens: int = 128) -> None:
        import onnxruntime
        from tokenizers import Tokenizer
        self.dims = dims
        self._session = onnxruntime.InferenceSession(model_path)
        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        self._tokenizer.enable_truncation(max_tokens)
        self._tokenizer.enable_padding()

    def embed(self, texts: list[str]) -> np.ndarray:
        encoded = self._tokenizer.encode_batch(texts)
        feed = {"input_ids": np.array([e.ids for e in encoded], dtype=np.int64),
                "attention_mask": np.array([e.attention_mask for e in encoded], dtype=np.int64),
                "token_type_ids": np.array([e.type_ids for e in encoded], dtype=np.int64)}
        names = {i.name for i in self._session.get_inputs()}
        hidden = self._session.run(None, {k: v for k, v in feed.items() if k in names})[0]
        mask = feed["attention_mask"][:, :, None]
        pooled = (hidden * mask).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)
        return pooled / np.maximum(np.linalg.norm(pooled, axis=1, keepdims=True), 1e-12)


class HttpEmbedder:
    """A service with an OpenAI-style '/embeddings' route (local servers speak it too)."""

    def __init__(self, url: str, model: str, dims: int = DIMS, key: str | None = None) -> None:
        self.url, self.model, self.dims, self.key = url, model, dims, key

    def embed(self, texts: list[str]) -> np.ndarray:
        import json
        from urllib.request import Request, urlopen
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        body = json.dumps({"model": self.model, "input": texts}).encode()
        with urlopen(Request(self.url, body, headers), timeout=120) as response:
            rows = sorted(json.load(response)["data"], key=lambda r: r["index"])
        return np.array([r["embedding"] for r in rows], dtype=np.float32)


def embed_column(make: Callable[[], Embedder], text: Column) -> Column:
    """Embedding of a text column; a vector of another size than the model's is an error."""
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            texts = batch.fillna("").tolist()
            rows = [model.embed(texts[i:i + BATCH]) for i in range(0, len(texts), BATCH)]
            found = np.concatenate(rows) if rows else np.zeros((0, model.dims))
            if found.shape[1] != model.dims:
                raise ValueError(f"expected {model.dims} dimensions, got {found.shape[1]}")
            yield pd.Series(list(found.astype(np.float32)))

    return run(text)


def embedding_texts(symbols: DataFrame) -> DataFrame:
    """(content_hash, project_path, symbol_id, source_file, name, kind, text): one text for symbols of equal code."""
    text = F.concat(F.col("kind"), F.lit(" "), F.col("name"), F.lit(": "), F.substring(F.col("source").cast("binary"), 1, 500).cast("string"))
    unique = symbols.where(F.coalesce("embed_hash", F.lit("")) != "").groupBy("embed_hash", "project_path").agg(
        F.min_by(F.struct(F.col("id").alias("symbol_id"), F.col("file").alias("source_file"), "name", "kind", text.alias("text")), "id").alias("s"))
    return unique.select(F.col("embed_hash").alias("content_hash"), "project_path", "s.*")


def embed_symbols(symbols: DataFrame, make: Callable[[], Embedder]) -> DataFrame:
    """Code vectors for symbols, keyed by content hash; equal texts are embedded once."""
    rows = embedding_texts(symbols)
    return rows.withColumn("embedding", embed_column(make, F.col("text"))).withColumn("doc_type", F.lit("code")).drop("text")
