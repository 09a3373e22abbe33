"""Helpers shared by the operators: shared storage, global order, checked joins."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only when it was counted to have at most so many rows.
BROADCAST_ROWS = 200_000

#: Rows of a text table that go to Python at once; keeps a worker's memory small when texts are long.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is named and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidegrid-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a copy on the shared folder, which outlives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, partitionBy=partition_by, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds what one Arrow batch of texts holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def swept(spark: SparkSession) -> None:
    """Has the driver's garbage collected, so that Spark removes the shuffle files and checkpoints of steps that are over
    and the heap doesn't grow by them."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_prefix(df: DataFrame, order: list[Column], values: dict[str, Column], number: int | None = None) -> DataFrame:
    """Adds exclusive running totals of ``values`` over the whole table in the given order.

    The rows are dealt by ranges of the order and kept once, so the ranges hold; each range then adds its own totals
    and the sum of the ranges before it.  Only one row for each range ever meets in one task.
    """
    n = number or shuffle_partitions(df.sparkSession)
    names = list(values)
    kept = materialise(
        df.withColumns({f"__v_{k}": v for k, v in values.items()}).repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id())
    )
    before = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = kept.groupBy("__range").agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in names])
    ranges = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("__range"), *[F.coalesce(F.sum(f"__t_{k}").over(ranges), F.lit(0)).alias(f"__o_{k}") for k in names])
    return (
        kept.withColumns({f"__r_{k}": F.coalesce(F.sum(f"__v_{k}").over(before), F.lit(0)) for k in names})
        .join(F.broadcast(offsets), "__range")  # as many rows as ranges
        .withColumns({k: F.col(f"__r_{k}") + F.col(f"__o_{k}") for k in names})
        .drop("__range", *[f"__{p}_{k}" for k in names for p in "vro"])
    )


def join_checked(large: DataFrame, small: DataFrame, key: str, rows: int, salts: int = 32) -> DataFrame:
    """Left join on a nullable key.  ``rows`` is the counted size of ``small``; beyond the bound for a broadcast,
    hot keys of ``large`` are dealt over ``salts`` copies of ``small``."""
    other = small.withColumnRenamed(key, "__key")
    on = large[key].eqNullSafe(F.col("__key"))
    if rows <= BROADCAST_ROWS:
        return large.join(F.broadcast(other), on, "left").drop("__key")
    other = other.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = large.withColumn("__salt", F.pmod(F.xxhash64(*large.columns), F.lit(salts)).cast("int"))
    return dealt.join(other, dealt[key].eqNullSafe(F.col("__key")) & (F.col("__salt") == F.col("__copy")), "left").drop("__key", "__salt", "__copy")


def unit(*columns: Column) -> Column:
    """A double in [0, 1) from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") * F.lit(2.0**-53)
