"""What the operators share: reading a table, intermediate tables in the shared folder, blocks of Arrow rows."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A whole table, by Spark's own reader (sf_dir may be in a store that only Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where it is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="corpusloom-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


class Scratch:
    """Tables written to the shared folder so that a lost executor costs one stage at most.

    keep() writes a DataFrame and gives it back as a scan; drop() deletes what is no longer
    read. What a lazy result still reads goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/corpusloom/{label}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n}-{name}"

    def keep(self, df: DataFrame, name: str, at: str | None = None) -> DataFrame:
        at = at or self.path(name)
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, at: str | None = None) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(at or self.root)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended
            pass


#: Bytes of an Arrow batch that goes to Python. Spark's own bound is a number of rows, which says nothing about texts.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the session's batches by bytes, unless it has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not 0 < int("".join(c for c in now if c.isdigit() or c == "-") or 0) < 2**31 - 1:
        spark.conf.set(key, str(BATCH_BYTES))


def release(spark: SparkSession) -> None:
    """Let the cleaner delete the shuffle files of finished jobs now, not when the driver's heap fills up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Freed memory of this Python worker goes back to the system; workers idle for long and there are several of them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that gives its memory back at the end of its task."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def blocks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Each batch cut so that a block's column takes about max_bytes, or one row if that alone is larger."""
    for batch in batches:
        at, n = 0, batch.num_rows
        while at < n:
            step = min(max_rows, n - at)
            while step > 1 and batch.column(column).slice(at, step).nbytes > max_bytes:
                step = max(1, step // 2)
            yield batch.slice(at, step)
            at += step


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as str, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]
