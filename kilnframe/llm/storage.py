"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..shipping import ship

#: Rows that a Python function is handed at a time.
SLICE_ROWS = 512
_CLEANED: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where the setting is absent and no executor is elsewhere."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="kilnframe-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may already be gone at exit
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts lineage so that lost executors cost at most the current stage, and gives the planner the table's true
    size, on which its choice of a broadcast rests. Scratch of a session goes when the driver exits.
    """
    spark = df.sparkSession
    folder = f"{shared_root(spark)}/kilnframe-{spark.sparkContext.applicationId}"
    if folder not in _CLEANED:
        _CLEANED.add(folder)
        atexit.register(_remove, spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def schema_of(**kinds: T.DataType | str) -> T.StructType:
    """A schema from names and types, given as types or as DDL."""
    return T.StructType([T.StructField(name, T.DataType.fromDDL(kind) if isinstance(kind, str) else kind) for name, kind in kinds.items()])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most SLICE_ROWS rows each, without copies."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _give_back() -> None:
    """Freed memory goes back to the machine, as a worker lives on and stands beside its executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """df.mapInArrow, with this package at hand in the workers, in batches of few rows."""
    ship(df.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(_slices(batches))
        finally:
            _give_back()

    return df.mapInArrow(whole, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
