"""Samples to steps: the newest sample at each step, and windows of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.grid import Grid

#: Later than any sample.
NEVER = (1 << 62) - 1


def held(samples: DataFrame, grid: Grid, lookback: int, offset: int) -> DataFrame:
    """(key, f, t, k0, k1): a sample and the numbers of the first and last step at which it is the newest one in
    (step - offset - lookback, step - offset].

    A sample holds until the next one of its series or until it is too old, so it is dealt to the steps of that span;
    steps and samples are not joined.  A stale marker ends the sample before it and holds nowhere itself.  Of
    samples of one moment the largest holds.
    """
    after = F.lead("t").over(Window.partitionBy("key").orderBy("t", "f"))
    until = F.least(F.coalesce(after, F.lit(NEVER)) - 1, F.col("t") + F.lit(lookback - 1))
    first, last = grid.covered(F.col("t"), F.col("until"), offset)
    return samples.withColumn("until", until).where("NOT stale").select("key", "f", "t", first.alias("k0"), last.alias("k1")).where("k0 <= k1")


def dealt(held: DataFrame, grid: Grid) -> DataFrame:
    """What is held, once for each of its steps, with ``ts``.  Labels are joined before: that keeps the order of the
    series, which dealt rows would have to be sorted into again."""
    return held.withColumn("k", F.explode(F.sequence("k0", "k1"))).withColumn("ts", grid.at(F.col("k"))).drop("k", "k0", "k1")


def smoothed(samples: DataFrame, grid: Grid, lookback: int, offset: int) -> DataFrame:
    """(key, ts, f, t): as ``held`` and dealt, but on the line to the following sample if that comes within the look-back;
    a series' first sample stands for the look-back before it too."""
    order = Window.partitionBy("key").orderBy("t", "f")
    rows = samples.where("NOT stale").withColumns({"nt": F.lead("t").over(order), "nf": F.lead("f").over(order), "pt": F.lag("t").over(order)})
    until = F.least(F.coalesce(F.col("nt"), F.lit(NEVER)) - 1, F.col("t") + F.lit(lookback - 1))
    since = F.when(F.col("pt").isNull() | (F.col("t") - F.col("pt") >= lookback), F.greatest(F.col("t") - F.lit(lookback - 1), F.coalesce(F.col("pt") + F.lit(lookback), F.col("t") - F.lit(lookback - 1)))).otherwise(F.col("t"))
    first, last = grid.covered(F.col("since"), F.col("until"), offset)
    held = rows.withColumns({"until": until, "since": since}).withColumns({"k0": first, "k1": last}).where("k0 <= k1")
    dealt = held.withColumn("k", F.explode(F.sequence("k0", "k1"))).withColumn("ts", grid.at(F.col("k")))
    ref = F.col("ts") - offset
    between = (ref > F.col("t")) & F.col("nt").isNotNull() & (F.col("nt") - ref < lookback)
    f = F.when(between, F.col("f") + (F.col("nf") - F.col("f")) * (ref - F.col("t")) / (F.col("nt") - F.col("t"))).otherwise(F.col("f"))
    return dealt.select("key", "ts", f.alias("f"), "t")


def windows(samples: DataFrame, grid: Grid, span: int, offset: int) -> DataFrame:
    """A row for each sample and each step whose window (step - offset - span, step - offset] holds it:
    key, ts, t, f, and pt, pf, of the series' sample before it, with ``inside`` where that is in the window too, and
    ``final``, whether none of the same moment follows.  Samples of one moment stand in the order of their values."""
    order = Window.partitionBy("key").orderBy("t", "f")
    final = F.coalesce(F.lead("t").over(order) > F.col("t"), F.lit(True))
    rows = samples.where("NOT stale").withColumns({"pt": F.lag("t").over(order), "pf": F.lag("f").over(order), "final": final})
    first, last = grid.covered(F.col("t"), F.col("t") + F.lit(span - 1), offset)
    rows = rows.withColumns({"k0": first, "k1": last}).where("k0 <= k1").withColumn("k", F.explode(F.sequence("k0", "k1")))
    ts = grid.at(F.col("k"))
    inside = F.coalesce(F.col("pt") > ts - F.lit(offset + span), F.lit(False))
    return rows.select("key", ts.alias("ts"), "t", "f", "pt", "pf", inside.alias("inside"), "final")


def edges(samples: DataFrame, grid: Grid, span: int, offset: int, lookback: int, both: bool) -> DataFrame:
    """Windows with their edges: as ``windows``, plus the sample at or before the left edge (not older than the
    look-back) moved to it; with ``both``, values at the edges on the line between neighbours."""
    order = Window.partitionBy("key").orderBy("t", "f")
    rows = samples.where("NOT stale").withColumns({"nt": F.lead("t").over(order), "nf": F.lead("f").over(order), "pt": F.lag("t").over(order), "pf": F.lag("f").over(order)})
    # As long as a sample is the newest before a left edge, it is dealt to that edge's step.
    until = F.least(F.coalesce("nt", F.lit(NEVER)) - 1, F.col("t") + F.lit(lookback - 1))
    first, last = grid.covered(F.col("t") + F.lit(span), F.col("until") + F.lit(span), offset)
    left = rows.withColumn("until", until).withColumns({"k0": first, "k1": last}).where("k0 <= k1").withColumn("k", F.explode(F.sequence("k0", "k1")))
    edge = grid.at(F.col("k")) - F.lit(offset + span)
    on_line = F.col("f") + (F.col("nf") - F.col("f")) * (edge - F.col("t")) / (F.col("nt") - F.col("t"))
    drop = F.col("nf") < F.col("f")
    value = F.when((edge > F.col("t")) & F.col("nt").isNotNull() & (F.col("nt") - edge < lookback), on_line).otherwise(F.col("f")) if both else F.col("f")
    left = left.select("key", grid.at(F.col("k")).alias("ts"), edge.alias("t"), value.alias("f"), F.col("t").alias("real"), F.col("f").alias("real_f"), drop.alias("drop"), F.col("nf").alias("nf"))
    return left


def spread(rows: DataFrame, grid: Grid) -> DataFrame:
    """Rows of one moment, repeated at every step."""
    return rows.drop("ts").withColumn("ts", F.explode(F.sequence(F.lit(grid.start).cast("long"), F.lit(grid.last).cast("long"), F.lit(grid.step).cast("long"))) if grid.n > 1 else F.lit(grid.start).cast("long")) if grid.n else rows.where("false")


__all__ = ["held", "dealt", "smoothed", "windows", "edges", "spread", "Column"]
