"""Session construction and the few runtime settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app: str = "contextmill", cpus: str = "*", memory: str = "16g") -> SparkSession:
    """Local session for tests and benchmarks; clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread_small(scan: DataFrame) -> DataFrame:
    """Use every core for CPU-heavy row work on a scan with fewer splits than cores.

    Fewer splits than cores means the input is smaller than cores * spark.sql.files.maxPartitionBytes.
    Larger inputs already arrive as many splits and are returned untouched, so no shuffle of wide rows
    is ever added at scale.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


MAX_PINNED_ROWS = 200_000


def pin_small(df: DataFrame, max_rows: int = MAX_PINNED_ROWS) -> DataFrame:
    """A request-sized DataFrame as a local relation marked for broadcast.

    The rows are counted first: beyond max_rows the DataFrame is returned as it was, without a hint,
    and Spark joins it by shuffle.
    """
    found = df.limit(max_rows + 1).toArrow()
    if found.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema))


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Only a local session may do without."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="contextmill-")
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
