"""Series and samples as tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as L
from ..lang.nodes import Matcher


#: Bytes of samples, as the planner estimates them and times the steps each is dealt to, that one task takes.
TASK = 4 << 20
#: No more tasks than these, and no estimate beyond this size is one.
MOST_TASKS, KNOWN = 10_000, 1 << 60


def tasks(samples: DataFrame, copies: int) -> int | None:
    """How many tasks take the samples in parts that don't grow with them; none where as many run anyway, or where
    their size isn't known.  Spark would put shuffled parts together by the few bytes they have before they are dealt."""
    plan = getattr(samples, "_jdf", None)  # not there on a remote session
    if plan is None:
        return None
    size, spark = int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes())), samples.sparkSession
    n = min(MOST_TASKS, -(-size * copies // TASK))
    usual = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return n if size < KNOWN and n > usual else None


@dataclass(frozen=True)
class Source:
    """``series``: series_id, labels.  ``samples``: series_id, ts_ms, f, is_stale, and, where it is kept by day, day.

    A query filters series first, by their labels, and reads the samples of the time that it needs; the day is filtered
    too, so that other days' files are not opened.
    """

    series: DataFrame
    samples: DataFrame

    def select(self, matchers: tuple[Matcher, ...], low: int, high: int, copies: int = 0) -> tuple[DataFrame, DataFrame]:
        """(series, samples as key, t, f, stale) of what matches, in [low, high] milliseconds.  Samples that will be
        sorted and copied to up to so many steps are dealt over tasks by their size."""
        series = self.series.where(L.matches(F.col("labels"), matchers))
        rows = self.samples.where(F.col("ts_ms").between(low, high))
        if "day" in rows.columns:
            day = lambda x: F.to_date(F.timestamp_millis(F.lit(x)))
            rows = rows.where(F.col("day").between(day(low), day(high)))
        n = tasks(rows, copies) if copies else None
        if n and all(m.name == L.NAME for m in matchers):
            # Nearly all samples stay, so one shuffle is for the join and what follows; below it a semi join would be moved.
            rows = rows.repartition(n, "series_id").join(series.select("series_id"), "series_id")
        else:
            rows = rows.join(series.select("series_id"), "series_id", "left_semi")
            rows = rows.repartition(n, "series_id") if n else rows
        return series, rows.select(F.col("series_id").alias("key"), F.col("ts_ms").alias("t"), "f", F.col("is_stale").alias("stale"))

    def label_names(self, matchers: tuple[Matcher, ...] = (), limit: int | None = None) -> DataFrame:
        found = self.series.where(L.matches(F.col("labels"), matchers)).select(F.explode("labels.key").alias("name")).distinct().orderBy("name")
        return found if limit is None else found.limit(limit)

    def label_values(self, name: str, matchers: tuple[Matcher, ...] = (), limit: int | None = None) -> DataFrame:
        found = self.series.where(L.matches(F.col("labels"), matchers)).select(L.value(F.col("labels"), name).alias("value")).where("value <> ''").distinct()
        return (found if limit is None else found.limit(limit)).orderBy("value")

    def between(self, low: int, high: int) -> Source:
        return Source(self.series, self.samples.where(F.col("ts_ms").between(low, high)))

    def without(self, tombstones: DataFrame) -> Source:
        """Without the samples that the intervals (series_id, mint, maxt) cover."""
        merged = merged_intervals(tombstones)
        gone = (merged["series_id"] == self.samples["series_id"]) & self.samples["ts_ms"].between(merged["mint"], merged["maxt"])
        return Source(self.series, self.samples.join(merged, gone, "left_anti"))

    def delete(self, matchers: tuple[Matcher, ...], low: int, high: int) -> DataFrame:
        """Tombstones for the matching series' samples in [low, high]."""
        return self.series.where(L.matches(F.col("labels"), matchers)).select("series_id", F.lit(low).cast("long").alias("mint"), F.lit(high).cast("long").alias("maxt"))

    def __or__(self, other: Source) -> Source:
        return Source(self.series.unionByName(other.series).dropDuplicates(["series_id"]), self.samples.unionByName(other.samples, allowMissingColumns=True))


def merged_intervals(tombstones: DataFrame) -> DataFrame:
    """Overlapping and adjacent intervals of a series put together."""
    order = Window.partitionBy("series_id").orderBy("mint", "maxt")
    reach = F.max("maxt").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = tombstones.withColumn("new", F.coalesce(F.col("mint") > reach + 1, F.lit(True)).cast("int"))
    runs = starts.withColumn("run", F.sum("new").over(order))
    return runs.groupBy("series_id", "run").agg(F.min("mint").alias("mint"), F.max("maxt").alias("maxt")).drop("run")


def series_id(labels: Column) -> Column:
    return F.xxhash64(labels)


def from_rows(rows: DataFrame) -> Source:
    """Of rows (labels, ts_ms, f[, is_stale])."""
    named = rows.withColumn("series_id", series_id(F.col("labels")))
    if "is_stale" not in rows.columns:
        named = named.withColumn("is_stale", F.lit(False))
    # Told apart by hashing; a first() of label sets would sort all samples.
    series = named.select("series_id", "labels").distinct()
    return Source(series, named.select("series_id", "ts_ms", "f", "is_stale"))


def union(*sources: Source) -> Source:
    return reduce(lambda a, b: a | b, sources)


def write(source: Source, path: str) -> None:
    """Series in one table, samples by day, sorted by series and time, so that readers skip files and row groups."""
    source.series.write.mode("overwrite").parquet(f"{path}/series")
    day = source.samples.select("series_id", "ts_ms", "f", "is_stale").withColumn("day", F.to_date(F.timestamp_millis("ts_ms")))
    day.repartition("day", F.pmod("series_id", F.lit(16))).sortWithinPartitions("day", "series_id", "ts_ms").write.mode("overwrite").partitionBy("day").parquet(f"{path}/samples")


def read(spark: SparkSession, path: str) -> Source:
    return Source(spark.read.parquet(f"{path}/series"), spark.read.parquet(f"{path}/samples"))


def checked(samples: DataFrame) -> DataFrame:
    """Samples ready to be appended: repeated ones once; reading fails where one moment of a series has two values."""
    same = F.struct("f", "is_stale")
    found = samples.groupBy("series_id", "ts_ms").agg(F.min(same).alias("a"), F.max(same).alias("b"))
    fine = F.col("a").eqNullSafe(F.col("b"))
    return found.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.lit("duplicate sample for timestamp")).cast("boolean"))).select("series_id", "ts_ms", "a.*")
