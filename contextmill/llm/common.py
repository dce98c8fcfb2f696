"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of text that a task turns into Python objects at once; a batch of Arrow can be a whole partition.
SLICE_BYTES = 1 << 22
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a scratch folder where it is unset (tests).

    On a cluster a folder of the driver alone would be of no use, so an unset one is an error there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if path is None and current is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if path is None:
        path = current or tempfile.mkdtemp(prefix="contextmill-llm-")
    if current is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: a lost executor costs no recomputation of what lies before it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column number text takes at most so many bytes (SLICE_BYTES); a longer text comes alone. Nothing is copied."""
    most = SLICE_BYTES if most is None else most
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text).cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
        ends, first = np.cumsum(sizes, dtype=np.int64), 0
        while first < len(ends):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(first, last - first)
            first = last


def parts_of(total_bytes: int | None, bound: int) -> int:
    """How many passes keep what each of them broadcasts within bound bytes."""
    return max(1, -(-int(total_bytes or 0) // bound))
