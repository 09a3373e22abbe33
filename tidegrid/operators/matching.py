"""Operators between two vectors: joins by the labels that have to be the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ieee, labels as L
from ..functions.ieee import lit
from ..lang.nodes import Matching
from ..lang.parser import COMPARISONS


def demand(rows: DataFrame, holds: Column, otherwise: str) -> DataFrame:
    """The rows; reading them fails where a condition doesn't hold."""
    return rows.where(F.when(holds, F.lit(True)).otherwise(F.raise_error(F.lit(otherwise)).cast("boolean")))


def signature(m: Matching) -> Column:
    return L.keep(F.col("labels"), m.labels) if m.on else L.drop(F.col("labels"), (*m.labels, L.NAME))


def applied(frame: DataFrame, op: str, a: Column, b: Column, kept: Column, as_bool: bool) -> DataFrame:
    """An operator's results in ``f``: comparisons keep the rows for which they hold, with ``kept``, or give 0 and 1."""
    if op not in COMPARISONS:
        return frame.withColumns({"f": ieee.arithmetic(op, a, b), "gone": F.lit(True)})
    if as_bool:
        return frame.withColumns({"f": ieee.compare(op, a, b).cast("double"), "gone": F.lit(True)})
    return frame.where(ieee.compare(op, a, b)).withColumn("f", kept)


def set_operation(a: DataFrame, b: DataFrame, op: str, m: Matching) -> DataFrame:
    """and, unless: a semi and an anti join by signature and step; or: the left and what only the right has."""
    names = ["labels", "ts", "f", "gone"]
    left, right = (x.select(*names, signature(m).alias("sig")) for x in (a, b))
    keys = lambda x: x.select("sig", "ts")
    match op:
        case "and":
            return left.join(keys(right), ["sig", "ts"], "left_semi").select(*names)
        case "unless":
            return left.join(keys(right), ["sig", "ts"], "left_anti").select(*names)
    return a.select(*names).unionByName(right.join(keys(left), ["sig", "ts"], "left_anti").select(*names))


def joined(a: DataFrame, b: DataFrame, op: str, m: Matching, as_bool: bool, strict: bool) -> DataFrame:
    """One-to-one, or many-to-one with the many on the side that the matching names."""
    swap = m.card == "one-to-many"
    many, one = (b, a) if swap else (a, b)
    per = Window.partitionBy("sig", "ts")
    one = one.select(signature(m).alias("sig"), "ts", F.col("labels").alias("ol"), F.col("f").alias("of"))
    many = many.select(signature(m).alias("sig"), "ts", "labels", "f", "gone")
    if strict:  # the join deals its rows in the same way, so that counting adds no shuffle
        one = demand(one.withColumn("n", F.count("*").over(per)), F.col("n") == 1, f"found duplicate series for the match group on the {'left' if swap else 'right'} hand-side of the operation; many-to-many matching not allowed: matching labels must be unique on one side").drop("n")
        if m.card == "one-to-one":
            many = many.withColumn("n", F.count("*").over(per))
    fill_many, fill_one = (m.fill_right, m.fill_left) if swap else (m.fill_left, m.fill_right)
    how = {(False, False): "inner", (True, False): "right", (False, True): "left", (True, True): "full"}[(fill_many is not None, fill_one is not None)]
    rows = many.join(one, ["sig", "ts"], how)
    if strict and m.card == "one-to-one":
        rows = demand(rows, F.coalesce(F.col("n") == 1, F.lit(True)), "multiple matches for labels: many-to-one matching must be explicit (group_left/group_right)").drop("n")
    f = F.coalesce("f", lit(fill_many)) if fill_many is not None else F.col("f")
    of = F.coalesce("of", lit(fill_one)) if fill_one is not None else F.col("of")
    own = F.coalesce("labels", "sig")
    if m.card == "one-to-one":
        named = F.filter(own, lambda x: x["key"].isin(*m.labels)) if m.on and m.labels else L.empty() if m.on else L.drop(own, m.labels)
    else:
        named = own
        for name in m.include:
            named = L.put(named, name, L.value(F.coalesce("ol", F.col("sig")), name))
    rows = rows.select(named.alias("labels"), "ts", f.alias("f"), of.alias("of"), F.coalesce("gone", F.lit(False)).alias("gone"))
    x, y = (F.col("of"), F.col("f")) if swap else (F.col("f"), F.col("of"))
    out = applied(rows, op, x, y, x, as_bool).select("labels", "ts", "f", "gone")
    if strict and m.card != "one-to-one" and m.include:
        n = F.count("*").over(Window.partitionBy("labels", "ts"))
        out = demand(out.withColumn("n", n), F.col("n") == 1, "multiple matches for labels: grouping labels must ensure unique matches").drop("n")
    return out


def info(rows: DataFrame, found: DataFrame, wanted: tuple[str, ...], required: bool, identifying: tuple[str, ...] = ("instance", "job")) -> DataFrame:
    """Rows with the labels of the info series of the same instance and job, the newest if there are several.

    A label of the row itself stays.  Where labels are required, rows without an info series go.
    """
    sig = L.keep(F.col("labels"), identifying)
    data = L.drop(F.col("labels"), (*identifying, L.NAME))
    data = L.keep(data, wanted) if wanted else data
    infos = found.select(sig.alias("sig"), "ts", F.col("labels").alias("whole"), data.alias("data"), "t").groupBy("sig", "ts").agg(F.max_by("data", F.struct("t", "whole")).alias("data"))
    joined = rows.withColumn("sig", sig).join(infos, ["sig", "ts"], "left")
    own = F.transform("labels", lambda x: x["key"])
    more = F.filter(F.coalesce("data", L.empty()), lambda x: ~F.array_contains(own, x["key"]))
    out = joined.withColumn("labels", F.array_sort(F.concat("labels", more)))
    if required:
        out = out.where(F.col("data").isNotNull() & (F.size("data") > 0))
    return out.select("labels", "ts", "f", "gone")
