"""Quantiles and fractions of cumulative buckets, as expressions over an array of (le, count)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ieee
from .ieee import lit

#: By so much, relatively, a bucket may fall short of the one before it without being wrong.
SLACK = 1e-12


def bound(text: Column) -> Column:
    """A bucket's upper bound from its label; null if it is no number."""
    low = F.lower(text)
    return F.when(low.isin("+inf", "inf"), lit(ieee.INF)).when(low == "-inf", lit(-ieee.INF)).otherwise(text.try_cast("double"))


def cleaned(buckets: Column) -> Column:
    """Sorted by bound, equal bounds put together, counts never falling."""
    ordered = F.array_sort(buckets)
    start = F.array().cast("array<struct<le:double,n:double>>")

    def join(done: Column, b: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        same = F.coalesce(last["le"] == b["le"], F.lit(False))
        whole = F.struct(b["le"].alias("le"), (last["n"] + b["n"]).alias("n"))
        return F.when(same, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(whole))).otherwise(F.concat(done, F.array(F.struct(b["le"].alias("le"), b["n"].alias("n")))))

    def rise(done: Column, b: Column) -> Column:
        last = F.coalesce(F.try_element_at(done, F.lit(-1))["n"], lit(-ieee.INF))
        falls = (b["n"] < last) | (F.abs(b["n"] - last) <= SLACK * F.abs(b["n"]))
        return F.concat(done, F.array(F.struct(b["le"].alias("le"), F.when(falls, last).otherwise(b["n"]).alias("n"))))

    return F.aggregate(F.aggregate(ordered, start, join), start, rise)


def quantile(b: Column, q: Column) -> Column:
    """Of cleaned buckets: linear within the bucket where the rank falls; the lowest bucket starts at 0."""
    size = F.size(b)
    last = F.try_element_at(b, F.lit(-1))
    total = last["n"]
    rank = q * total
    at = F.array_position(F.transform(b, lambda x: x["n"] >= rank), F.lit(True)).cast("int")
    here, before = F.try_element_at(b, at), F.try_element_at(b, F.greatest(at - 1, F.lit(1)))
    low = F.when(at > 1, before["le"]).otherwise(lit(0.0))
    below = F.when(at > 1, before["n"]).otherwise(lit(0.0))
    inner = low + (here["le"] - low) * ieee.div(rank - below, here["n"] - below)
    return (
        F.when(F.isnan(q), lit(ieee.NAN)).when(q < 0, lit(-ieee.INF)).when(q > 1, lit(ieee.INF))
        .when(F.coalesce(last["le"] != lit(ieee.INF), F.lit(True)) | (size < 2) | F.isnan(total) | (total == 0), lit(ieee.NAN))
        .when(at == size, F.try_element_at(b, size - 1)["le"]).when((at == 1) & (here["le"] <= 0), here["le"]).otherwise(inner)
    )


def fraction(b: Column, lower: Column, upper: Column) -> Column:
    """The share of what was counted between two values."""
    size = F.size(b)
    total = F.try_element_at(b, F.lit(-1))["n"]

    def rank(v: Column) -> Column:
        at = F.array_position(F.transform(b, lambda x: x["le"] >= v), F.lit(True)).cast("int")
        here, before = F.try_element_at(b, at), F.try_element_at(b, F.greatest(at - 1, F.lit(1)))
        low = F.when(at > 1, before["le"]).when(here["le"] > 0, lit(0.0)).otherwise(lit(-ieee.INF))
        below = F.when(at > 1, before["n"]).otherwise(lit(0.0))
        inner = F.when((v <= low) | (low == lit(-ieee.INF)) & (v < here["le"]), below).when((here["le"] == lit(ieee.INF)) & (v < lit(ieee.INF)), below).otherwise(below + (here["n"] - below) * ieee.div(v - low, here["le"] - low))
        return F.when(v == lit(ieee.INF), total).when(v == here["le"], here["n"]).otherwise(inner)

    return (
        F.when(F.isnan(lower) | F.isnan(upper) | (size < 2) | (F.try_element_at(b, F.lit(-1))["le"] != lit(ieee.INF)) | F.isnan(total) | (total == 0), lit(ieee.NAN))
        .when(lower >= upper, lit(0.0)).otherwise(ieee.div(rank(upper) - rank(lower), total))
    )
