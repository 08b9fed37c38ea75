"""Shared pieces of the training-data operators: tables, scratch tables, bounded broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a side may have to be broadcast; a larger side goes through a shuffle join.
BROADCAST_ROWS = 100_000
#: Bytes of text that one numpy pass works on inside a task.
BLOCK_BYTES = 1_000_000
#: Bytes of rows that go to a Python worker at once, where the session sets no number of its own.
ARROW_BYTES = 4_000_000
_local_scratch: list[str] = []
_scopes: list[list[str]] = []


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends rows to Python workers a few megabytes at a time: the JVM and the worker each hold such
    a batch outside the heap, for every task that runs. A session that sets the size itself keeps its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, ARROW_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset, a local one in local mode, else an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_scratch:
        _local_scratch.append(tempfile.mkdtemp(prefix="spark-"))
    return _local_scratch[0]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lumenlake/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """Collects the paths of the scratch tables that are written inside, for delete_paths() once their readers are done."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        _scopes.pop()


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a DataFrame made by materialize() that nothing reads any more."""
    names = df.inputFiles()[:1]
    delete_paths(df.sparkSession, [n.rsplit("/", 1)[0] for n in names if "/lumenlake/" in n])


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only when a count shows that df has at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded(rows: DataFrame, most: dict[int, int]) -> DataFrame:
    """rows(y, h, ...) of training features: each h once a class, and at most most[y] rows of class y in the order of h, so
    that an id with very many rows sends no more to the driver than any other sample."""
    rows = materialize(rows.dropDuplicates(["y", "h"]), "training-rows")
    parts = [rows.where(F.col("y") == y).orderBy("h").limit(n) for y, n in most.items()]
    return reduce(DataFrame.unionByName, parts)


def held_out(doc_id, modulus: int, remainder: int):
    """crc32 of the id as text, modulo: True for rows whose labels must not be learned. Null ids: False."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def _trim() -> None:
    """Give freed memory back to the system: Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def blocks(batch: pa.RecordBatch, column: str, max_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most max_bytes of text each (a longer row comes alone)."""
    import numpy as np

    from lumenlake.llm.bytetok import utf8

    _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    start, n = 0, batch.num_rows
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + max_bytes, "right")) - 1)
        yield batch.slice(start, min(stop, n) - start)
        start = stop
    _trim()
