"""The star schema's tables as series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as L
from .tables import Source, from_rows, union

#: Bounds of the classic histogram over the events' values.
BOUNDS = ("1", "5", "10", "50", "100", "+Inf")


def millis(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1000).cast("long")


def _of(rows: DataFrame, metric: str, names: list[str], ts: Column, f: Column) -> Source:
    """Labels are few, so series are found without reading samples twice: from the distinct labels."""
    labels = L.of({L.NAME: F.lit(metric), **{n: F.col(n) for n in names}})
    return from_rows(rows.select(labels.alias("labels"), ts.alias("ts_ms"), f.cast("double").alias("f")))


def events_value(spark: SparkSession, path: str, by: tuple[str, ...] = ("event_type",)) -> Source:
    rows = spark.read.parquet(f"{path}/events.parquet")
    return _of(rows, "events_value", list(by), millis(F.col("ts")), F.col("value"))


def events_total(spark: SparkSession, path: str) -> Source:
    """A counter: how many events of a type there were so far."""
    rows = spark.read.parquet(f"{path}/events.parquet").select("event_type", "ts", "event_id")
    n = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    return _of(rows.withColumn("n", n), "events_total", ["event_type"], millis(F.col("ts")), F.col("n"))


def events_buckets(spark: SparkSession, path: str) -> Source:
    """A classic histogram: how many events of a type so far had a value up to each bound."""
    rows = spark.read.parquet(f"{path}/events.parquet").select("event_type", "ts", "event_id", "value")
    order = Window.partitionBy("event_type").orderBy("ts", "event_id")
    counts = F.array(*[F.struct(F.lit(b).alias("le"), F.sum(F.when(F.lit(True) if b == "+Inf" else F.col("value") <= float(b), 1).otherwise(0)).over(order).alias("n")) for b in BOUNDS])
    flat = rows.withColumn("counts", counts).withColumn("b", F.explode("counts")).select("event_type", "ts", "b.le", "b.n")
    return _of(flat, "events_value_bucket", ["event_type", "le"], millis(F.col("ts")), F.col("n"))


def lineitem_quantity(spark: SparkSession, path: str) -> Source:
    rows = spark.read.parquet(f"{path}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"), "l_shipdate").agg(F.sum("l_quantity").alias("q"))
    return _of(rows, "lineitem_quantity", ["returnflag", "linestatus"], millis(F.col("l_shipdate")), F.col("q"))


def orders_total_price(spark: SparkSession, path: str) -> Source:
    rows = spark.read.parquet(f"{path}/orders.parquet").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_orderdate").agg(F.sum("o_totalprice").alias("p"))
    return _of(rows, "orders_total_price", ["status", "priority"], millis(F.col("o_orderdate")), F.col("p"))


def everything(spark: SparkSession, path: str) -> Source:
    return union(events_value(spark, path), events_total(spark, path), events_buckets(spark, path), lineitem_quantity(spark, path), orders_total_price(spark, path))
