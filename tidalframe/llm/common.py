"""What the operators of this subpackage share: scratch tables, partition counts, batches."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Scratch folder where the cluster names none, as in tests on one machine.
LOCAL_SCRATCH = "/tmp/checkpoints"

#: Estimates beyond this are the optimizer's way to say that it doesn't know.
UNKNOWN_BYTES = 1 << 50

#: Most bytes of text that numpy code looks at in one go, so a worker's memory is bounded.
CHUNK_BYTES = 2 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and keep Arrow batches small."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    env.setdefault("MALLOC_ARENA_MAX", "2")
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def lean(run: Callable) -> Callable:
    """A worker function over batches that gives freed memory back to the system when its task ends.

    Workers outlive tasks; without this each keeps the peak of all tasks it has run.
    """
    return lambda batches: _then_release(run(batches))


def lean_group(run: Callable) -> Callable:
    """``lean`` for a function of a group's key and table."""

    def group(key, table):
        try:
            return run(key, table)
        finally:
            release()

    return group


def _then_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    try:
        yield from batches
    finally:
        release()


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else, on one machine only, a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return named or LOCAL_SCRATCH


def materialise(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder, partitioned ``by`` columns, and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation, and what follows
    sees the same rows on every attempt.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch__ = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialise`` that nothing will read again."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch__)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(df: DataFrame, bytes_each: int) -> int:
    """Partitions that hold about ``bytes_each`` of ``df``, by the optimizer's size estimate.

    Where the estimate is no size at all (over ``UNKNOWN_BYTES``: rows from Python, products of
    joins), the session's number of shuffle partitions.
    """
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size > UNKNOWN_BYTES else int(min(max(least, size // bytes_each), 200_000))


def document_texts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` as a long and ``text`` as a string, whatever else the table holds."""
    return docs.select(docs[key].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in runs of at most ``most`` bytes of ``column`` (one long row alone)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, upto - at)
            at = upto
