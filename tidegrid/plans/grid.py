"""The steps at which an expression is evaluated."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Steps from ``start`` to ``end`` (milliseconds), the end included if a step hits it."""

    start: int
    end: int
    step: int

    @property
    def n(self) -> int:
        return max(0, (self.end - self.start) // self.step + 1)

    @property
    def last(self) -> int:
        return self.start + (self.n - 1) * self.step

    def covered(self, first: Column, last: Column, offset: int) -> tuple[Column, Column]:
        """The numbers of the first and last step whose reference time, ``offset`` before the step, lies in
        [first, last]; none if the first is larger."""
        low = F.ceil((first + F.lit(offset - self.start)) / F.lit(self.step)) if self.step > 1 else first + F.lit(offset - self.start)
        high = F.floor((last + F.lit(offset - self.start)) / F.lit(self.step)) if self.step > 1 else last + F.lit(offset - self.start)
        return F.greatest(low.cast("long"), F.lit(0)), F.least(high.cast("long"), F.lit(self.n - 1))

    def most(self, span: int) -> int:
        """At most how many steps lie within a span."""
        return max(1, min(self.n, -(-span // self.step)))

    def at(self, k: Column) -> Column:
        return F.lit(self.start) + k * F.lit(self.step)

    def steps(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.n).select(self.at(F.col("id")).alias("ts"))
