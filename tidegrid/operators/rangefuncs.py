"""Functions of windows, as aggregations of one group for each series and step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ieee
from ..functions.ieee import lit

class _Columns:
    """The columns of windows, named when they are used: importing needs no session."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


at = _Columns()


def _count_pairs(differs: Column) -> Column:
    return F.sum(F.when(at.inside & differs, 1).otherwise(0)).cast("double")


def _drop() -> Column:
    return ieee.compare("<", at.f, at.pf)


def _change() -> Column:
    return ieee.compare("!=", at.f, at.pf) & ~(F.isnan(at.f) & F.isnan(at.pf))


def _first() -> Column:
    """The value of the window's first sample, the only one without another before it inside."""
    return F.max(F.when(~at.inside, at.f))


def _last() -> Column:
    return F.max_by(F.when(at.final, at.f), F.when(at.final, at.t))


def _extremum(sign: int) -> Column:
    """The time of the largest or smallest value, the latest of equal ones; without numbers the latest sample's."""
    value = at.f if sign > 0 else -at.f
    return F.coalesce(F.max(F.when(~F.isnan(at.f), F.struct(value.alias("v"), at.t.alias("t"))))["t"], F.max(at.t)) / 1000.0


def _values() -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("t", "f"))), lambda x: x["f"])


def _variance() -> Column:
    return F.when(F.max(F.isnan(at.f) | (F.abs(at.f) == lit(ieee.INF))), lit(ieee.NAN)).otherwise(F.var_pop(F.when(~F.isnan(at.f), at.f)))


#: One value for each window; the name is kept where the second says so.
SIMPLE: dict[str, Callable[[], Column]] = {
    "count_over_time": lambda: F.count("*").cast("double"),
    "present_over_time": lambda: F.max(lit(1.0)),
    "sum_over_time": lambda: F.sum(at.f),
    "avg_over_time": lambda: F.avg(at.f),
    "min_over_time": lambda: ieee.least(at.f),
    "max_over_time": lambda: ieee.largest(at.f),
    "stddev_over_time": lambda: F.sqrt(_variance()),
    "stdvar_over_time": _variance,
    "first_over_time": _first,
    "last_over_time": _last,
    "ts_of_first_over_time": lambda: F.min(at.t) / 1000.0,
    "ts_of_last_over_time": lambda: F.max(at.t) / 1000.0,
    "ts_of_max_over_time": lambda: _extremum(1),
    "ts_of_min_over_time": lambda: _extremum(-1),
    "changes": lambda: _count_pairs(_change()),
    "resets": lambda: _count_pairs(_drop()),
}
KEEP_NAME = ("first_over_time", "last_over_time")


def simple(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("key", "ts").agg(SIMPLE[name]().alias("f"))


def quantile(rows: DataFrame, q: Column) -> DataFrame:
    return rows.groupBy("key", "ts").agg(F.collect_list("f").alias("v")).select("key", "ts", ieee.quantile(F.col("v"), q).alias("f"))


def mad(rows: DataFrame) -> DataFrame:
    """The median of the distances to the median."""
    half = lit(0.5)
    grouped = rows.groupBy("key", "ts").agg(F.collect_list("f").alias("v")).withColumn("m", ieee.quantile(F.col("v"), half))
    return grouped.select("key", "ts", ieee.quantile(F.transform("v", lambda x: F.abs(x - F.col("m"))), half).alias("f"))


def rate(rows: DataFrame, name: str, span: int, offset: int) -> DataFrame:
    """rate, increase and delta: the difference over the window, drops of counters added back, carried on to the
    window's edges as far as samples stand about that far apart."""
    counter, per_second = name != "delta", name == "rate"
    lost = F.sum(F.when(at.inside & _drop(), at.pf).otherwise(0.0)) if counter else F.max(lit(0.0))
    g = rows.groupBy("key", "ts").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), _first().alias("f0"), _last().alias("f1"), lost.alias("lost")).where("n >= 2")
    g = g.withColumn("result", F.col("f1") - F.col("f0") + F.col("lost")).withColumn("sampled", (F.col("t1") - F.col("t0")) / 1000.0)
    g = g.withColumn("mean", F.col("sampled") / (F.col("n") - 1))
    start = (F.col("t0") - (F.col("ts") - offset - span)) / 1000.0
    end = (F.col("ts") - offset - F.col("t1")) / 1000.0
    near = lambda x: F.when(x >= F.col("mean") * 1.1, F.col("mean") / 2).otherwise(x)
    g = g.withColumns({"a": near(start), "b": near(end)})
    if counter:
        zero = F.col("sampled") * (F.col("f0") / F.when(F.col("result") > 0, F.col("result")))
        g = g.withColumn("a", F.when((F.col("result") > 0) & (F.col("f0") >= 0), F.least("a", zero)).otherwise(F.col("a")))
    out = F.col("result") * ieee.div(F.col("sampled") + F.col("a") + F.col("b"), F.col("sampled"))
    return g.select("key", "ts", (out / (span / 1000.0) if per_second else out).alias("f"))


def edge_rate(inner: DataFrame, left: DataFrame, name: str, span: int, right: DataFrame | None) -> DataFrame:
    """rate, increase, delta, changes and resets over windows with edges, without carrying on.

    ``inner``: the window's own samples (as ``windows``); ``left``: the value at its left edge; ``right``: at its right
    edge, where the window is smoothed.  Without a left edge the first sample stands there.
    """
    pairs = {"changes": _change(), "resets": _drop()}.get(name)
    own = inner.groupBy("key", "ts").agg(
        _first().alias("f0"), _last().alias("f1"), F.sum(F.when(at.inside & _drop(), at.pf).otherwise(0.0)).alias("lost"), F.count("*").alias("n"),
        (_count_pairs(pairs) if pairs is not None else F.max(lit(0.0))).alias("pairs"),
    )
    g = own.join(left.select("key", "ts", F.col("f").alias("e0"), "real_f"), ["key", "ts"], "full" if right is not None else "left")
    if right is not None:
        g = g.join(right.select("key", "ts", F.col("f").alias("e1")), ["key", "ts"], "left")
    first = F.coalesce("e0", "f0")
    last = F.coalesce(F.col("e1"), F.col("f1"), F.col("e0")) if right is not None else F.coalesce("f1", "e0")
    if pairs is not None:
        seam = {"changes": ieee.compare("!=", F.col("f0"), F.col("e0")) & ~(F.isnan("f0") & F.isnan("e0")), "resets": ieee.compare("<", F.col("f0"), F.col("e0"))}[name]
        return g.select("key", "ts", (F.col("pairs") + F.coalesce(seam, F.lit(False)).cast("double")).alias("f"))
    result = last - first
    if name != "delta":
        result = result + F.coalesce("lost", lit(0.0)) + F.when(F.col("f0") < F.col("e0"), F.col("e0")).otherwise(0.0)
        if right is not None:
            result = result + F.when(F.col("e1") < F.col("f1"), F.col("f1")).otherwise(0.0)
    return g.where(first.isNotNull()).select("key", "ts", (result / (span / 1000.0) if name == "rate" else result).alias("f"))


def instant(rows: DataFrame, name: str) -> DataFrame:
    """irate and idelta: of the window's last two samples."""
    last = F.max_by(F.struct("f", "pf", "t", "pt", "inside"), "t").alias("l")
    g = rows.where("final").groupBy("key", "ts").agg(last).where("l.inside").select("key", "ts", "l.*")
    gone = at.f - at.pf if name == "idelta" else F.when(_drop(), at.f).otherwise(at.f - at.pf)
    return g.select("key", "ts", (gone if name == "idelta" else ieee.div(gone, (at.t - at.pt) / 1000.0)).alias("f"))


def line(rows: DataFrame, name: str, ahead: Column | None) -> DataFrame:
    """deriv and predict_linear: the slope of the least-squares line, or its value ``ahead`` seconds after the step."""
    x = (at.t - F.col("ts")) / 1000.0
    g = rows.groupBy("key", "ts").agg(
        F.count("*").alias("n"), F.covar_pop(x, at.f).alias("xy"), F.var_pop(x).alias("xx"), F.avg(x).alias("mx"), F.avg("f").alias("my"), F.min("f").alias("low"), F.max("f").alias("high")
    ).where("n >= 2")
    constant = F.col("low") == F.col("high")
    infinite = constant & (F.abs("low") == lit(ieee.INF))
    slope = F.when(infinite, lit(ieee.NAN)).when(constant, lit(0.0)).otherwise(ieee.div(F.col("xy"), F.col("xx")))
    if name == "deriv":
        return g.select("key", "ts", slope.alias("f"))
    g = g.withColumn("slope", slope)
    base = F.when(infinite, lit(ieee.NAN)).when(constant, F.col("low")).otherwise(F.col("my") - F.col("slope") * F.col("mx"))
    return g.select("key", "ts", (F.col("slope") * ahead + base).alias("f"), "slope")


def smoothing(rows: DataFrame, level: float, trend: float) -> DataFrame:
    """Holt's linear smoothing over the window's samples in order."""
    g = rows.groupBy("key", "ts").agg(_values().alias("v")).where(F.size("v") >= 2)
    begin = F.struct(F.element_at("v", 1).alias("s"), (F.element_at("v", 2) - F.element_at("v", 1)).alias("b"))

    def step(a: Column, x: Column) -> Column:
        s = lit(level) * x + lit(1 - level) * (a["s"] + a["b"])
        return F.struct(s.alias("s"), (lit(trend) * (s - a["s"]) + lit(1 - trend) * a["b"]).alias("b"))

    return g.select("key", "ts", F.aggregate(F.slice("v", 2, 1_000_000_000), begin, step)["s"].alias("f"))
