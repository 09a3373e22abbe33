"""Aggregations of all series of a group at each step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ieee, labels as L
from ..functions.ieee import lit


def group_of(grouping: tuple[str, ...], without: bool) -> Column:
    return L.drop(F.col("labels"), (*grouping, L.NAME)) if without else L.keep(F.col("labels"), grouping)


def _variance() -> Column:
    f = F.col("f")
    return F.when(F.max(F.isnan(f) | (F.abs(f) == lit(ieee.INF))), lit(ieee.NAN)).otherwise(F.var_pop(F.when(~F.isnan(f), f)))


PLAIN = {
    "sum": lambda: F.sum("f"), "avg": lambda: F.avg("f"), "count": lambda: F.count("*").cast("double"), "group": lambda: F.max(lit(1.0)),
    "min": lambda: ieee.least(F.col("f")), "max": lambda: ieee.largest(F.col("f")), "stdvar": _variance, "stddev": lambda: F.sqrt(_variance()),
}


def _gone(grouping: tuple[str, ...], without: bool) -> Column:
    """A name kept by grouping goes if it was to go before."""
    return F.max("gone") if L.NAME in grouping and not without else F.lit(False)


def aggregate(rows: DataFrame, op: str, grouping: tuple[str, ...], without: bool) -> DataFrame:
    """Partial sums are built before rows move, by group and step.  ``p``: the parameter at each row's step."""
    grouped = rows.withColumn("g", group_of(grouping, without))
    if op in PLAIN:
        return grouped.groupBy("g", "ts").agg(PLAIN[op]().alias("f"), _gone(grouping, without).alias("gone")).select(F.col("g").alias("labels"), "ts", "f", "gone")
    if op == "quantile":
        out = grouped.groupBy("g", "ts").agg(F.collect_list("f").alias("v"), F.max("p").alias("p"), _gone(grouping, without).alias("gone"))
        return out.select(F.col("g").alias("labels"), "ts", ieee.quantile(F.col("v"), F.col("p")).alias("f"), "gone")
    if op == "limit_ratio":
        place = F.shiftrightunsigned(F.xxhash64("labels"), 11).cast("double") * lit(2.0**-53)
        ratio = F.greatest(F.least(F.col("p"), lit(1.0)), lit(-1.0))
        return grouped.where(F.when(ratio >= 0, place < ratio).otherwise(place >= 1 + ratio)).select("labels", "ts", "f", "gone")
    order = {"topk": [F.isnan("f"), F.desc("f"), "labels"], "bottomk": [F.isnan("f"), F.asc("f"), "labels"], "limitk": ["labels"]}[op]
    k = F.when(F.abs(F.col("p")) < 9.2e18, F.col("p").cast("long"))
    ranked = grouped.withColumn("r", F.row_number().over(Window.partitionBy("g", "ts").orderBy(*order)))
    checked = F.when(k.isNull(), F.raise_error(F.lit("Parameter value is NaN or overflows a 64-bit integer")).cast("long")).otherwise(k)
    return ranked.where(F.col("r") <= checked).select("labels", "ts", "f", "gone")


def count_values(rows: DataFrame, label: str, grouping: tuple[str, ...], without: bool) -> DataFrame:
    """How many series of a group have each value, which becomes a label."""
    key = L.put(group_of(grouping, without), label, ieee.text(F.col("f")))
    return rows.groupBy(key.alias("labels"), "ts").agg(F.count("*").cast("double").alias("f")).withColumn("gone", F.lit(False))
