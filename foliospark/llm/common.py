"""Shared helpers of the training-data operators: shared storage, batching, text hashing."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local session gets a temporary folder; a cluster is refused, as its executors share none.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("foliospark.local.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="foliospark-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("foliospark.local.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


_SCOPES: list[list[str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder, which outlives lost executors."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has written there; DataFrames over it can't be read any more."""
    _delete(spark, shared_root(spark))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables written within are deleted at the end, but for those taken off the list."""
    _SCOPES.append([])
    try:
        yield _SCOPES[-1]
    finally:
        for path in _SCOPES.pop():
            _delete(spark, path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever the case."""
    held = {c.lower() for c in df.columns}
    while name in held:
        name += "_"
    return name


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that go to a Python worker at once: whole texts in both processes' buffers.
ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ROWS rows; a lower setting stays."""
    if not 0 < int(spark.conf.get(BATCH_ROWS, "10000")) <= ROWS:
        spark.conf.set(BATCH_ROWS, str(ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a scan has them in fewer partitions (few large row groups) than there are cores.

    Partitions are counted from the files' own row counts; no column is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.groupBy(F.spark_partition_id().alias("part")).count().agg(F.count("*").alias("parts"), F.sum("count").alias("rows")).first()
    return df.repartition(2 * cores) if held["parts"] < cores < (held["rows"] or 0) else df


def give_back() -> None:
    """Returns freed memory to the system; called at a task's end, as workers stay for later tasks and other stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that only a little of a batch is held as Python values at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
        del b
    give_back()


def text_bytes(docs: DataFrame) -> int:
    """Bytes of UTF-8 in the text column; sizes partition counts by the data."""
    return docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def parts_for(spark: SparkSession, n_bytes: int, per_part: int) -> int:
    """Partition count in proportion to the bytes, and no lower than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // per_part), 1)
