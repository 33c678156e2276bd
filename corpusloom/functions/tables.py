"""Tables cut from their lineage, and places in an order that no single task has to sort."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values.
BATCH_BYTES = 8_000_000


def _shared(spark: SparkSession) -> None:
    """Sets the shared folder to the one that spark.checkpoint.dir names; to a temporary one only where it is unset, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusloom-"))


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, unless it has a bound of its own: 10,000 long texts may not fit a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not 0 < int("".join(c for c in now if c.isdigit() or c == "-") or 0) < 2**31 - 1:
        spark.conf.set(key, str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """df as it is now, in the shared folder, so that a lost executor costs no more than a read."""
    _shared(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, deleted when the driver ends."""
    _shared(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may have ended
            pass

    atexit.register(drop)
    return root


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "place", weight: Column | None = None) -> DataFrame:
    """df with each row's place, from 1, in the order of its group; with weight, the sum of the weights up to it. A group may hold any share of the rows.

    Rows are dealt by ranges of group and order, so a large group lies in many parts. What a group has
    in the parts before is a sum of counts, a row a group and part. Equal rows get different places.
    """
    names = df.columns
    at = [f"_o{i}" for i in range(len(order))]
    keyed = df.select(*names, *(o.alias(a) for o, a in zip(order, at)))
    dealt = cut(keyed.repartitionByRange(*by, *at).withColumn("_part", F.spark_partition_id()))
    one = F.lit(1) if weight is None else weight
    own = F.sum(one).over(Window.partitionBy("_part", *by).orderBy(*at).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = dealt.groupBy("_part", *by).agg(F.sum(one).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return dealt.withColumn("_own", own).join(sums, ["_part", *by]).select(*names, (F.col("_own") + F.col("_before")).alias(name))


class Log:
    """The finished writes of a table that is kept as files under one folder: a row a write, added when all of it is there.

    A reader sees what the last row says, so a write that fails before its row changes nothing that can be
    seen. There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.at = spark, f"{root}/log"

    def version(self) -> int:
        """The last finished write; 0 where there is none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return 0
        return self.spark.read.schema("version long").parquet(self.at).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def add(self, version: int) -> None:
        self.spark.range(1).select(F.lit(version).cast("long").alias("version")).coalesce(1).write.mode("append").parquet(self.at)
