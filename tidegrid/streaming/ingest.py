"""Samples that arrive, into the tables of a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..functions import labels as L
from ..sources.tables import Source, checked, series_id


def append(stream: DataFrame, path: str, checkpoint: str, *, late: str = "10 minutes", available_now: bool = True) -> StreamingQuery:
    """Appends a stream of (labels, ts, f[, is_stale]) to the tables under ``path``; ``ts`` is a timestamp.

    Samples later than ``late`` behind the newest are dropped, a sample that comes again within that time is appended
    once.  A batch is written as a whole: its samples by day, and the series that it is the first to have.  Should a
    batch run again, its files replace those that it wrote before.
    """
    rows = stream.withColumn("is_stale", F.col("is_stale") if "is_stale" in stream.columns else F.lit(False)).withColumn("series_id", series_id(F.col("labels")))
    once = rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["series_id", "ts"])

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.withColumn("ts_ms", F.floor(F.unix_micros("ts") / 1000).cast("long")).persist()
        fine = checked(kept.select("series_id", "ts_ms", "f", "is_stale")).withColumn("day", F.to_date(F.timestamp_millis("ts_ms"))).withColumn("batch", F.lit(number))
        _replace(fine.repartition("day").sortWithinPartitions("series_id", "ts_ms"), f"{path}/samples", ["day", "batch"])
        _replace(kept.groupBy("series_id").agg(F.first("labels").alias("labels")).withColumn("batch", F.lit(number)), f"{path}/series", ["batch"])
        kept.unpersist()

    writer = once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _replace(rows: DataFrame, path: str, by: list[str]) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read(spark: SparkSession, path: str) -> Source:
    """The source of what was appended; a series that several batches brought counts once."""
    series = spark.read.parquet(f"{path}/series").dropDuplicates(["series_id"]).select("series_id", "labels")
    return Source(series, spark.read.parquet(f"{path}/samples").drop("batch"))


def zero_samples(samples: DataFrame) -> DataFrame:
    """For samples with a start time ``st_ms``: a sample of 0 at each new start, where it lies before the sample and
    after the one before."""
    order = Window.partitionBy("series_id").orderBy("ts_ms")
    before = samples.withColumns({"was": F.lag("st_ms").over(order), "prev": F.lag("ts_ms").over(order)})
    fresh = (F.col("st_ms") > 0) & (F.col("st_ms") < F.col("ts_ms")) & ~F.col("st_ms").eqNullSafe(F.col("was")) & F.coalesce(F.col("st_ms") > F.col("prev"), F.lit(True))
    return before.where(fresh).select("series_id", F.col("st_ms").alias("ts_ms"), F.lit(0.0).alias("f"), F.lit(False).alias("is_stale"))


def rolled_up(stream: DataFrame, span: str, by: dict[str, Column] | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts, sums and extremes by window of a stream of (labels, ts, f), each window given out once, when it is past."""
    key = L.of(by) if by else F.col("labels")
    return stream.withWatermark("ts", late).groupBy(F.window("ts", span), key.alias("labels")).agg(F.count("*").alias("n"), F.sum("f").alias("sum"), F.min("f").alias("min"), F.max("f").alias("max"))
