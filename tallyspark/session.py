"""Session helpers: a local session for tests and benches, and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# How many rows of an aggregate may be settled on the driver and broadcast.
SMALL_ROWS = 100_000


def local_session(app: str, cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_FOLDERS: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """Shared folder for stage tables: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own (tests, benches).
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    if sc.master != "local" and not sc.master.startswith("local["):  # local-cluster has machines of its own
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if sc.applicationId not in _FOLDERS:
        _FOLDERS[sc.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _FOLDERS[sc.applicationId]


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a stage table to the shared folder and read it back.

    Cuts lineage, survives lost executors, is computed once and stays columnar for later readers.
    """
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, max_rows: int = SMALL_ROWS) -> tuple[DataFrame, bool]:
    """Measure an aggregate: up to ``max_rows`` it becomes a local table, else it stays a plan.

    Returns the table and whether it is small enough to broadcast.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df, False
    return df.sparkSession.createDataFrame(rows, df.schema), True


def broadcast_if_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast side of a join when its measured size allows it, a plain side otherwise."""
    from pyspark.sql import functions as F

    table, small = settle(df, max_rows)
    return F.broadcast(table) if small else table


def keep(df: DataFrame) -> DataFrame:
    """Cache rows that several jobs read; lost blocks are recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
