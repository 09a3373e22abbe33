"""Functions of single values and of times."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ieee
from .ieee import lit, within

INF = ieee.INF

MATH = {
    "abs": F.abs, "ceil": ieee.ceil, "floor": ieee.floor, "exp": F.exp, "sqrt": F.sqrt, "sgn": ieee.sign,
    "ln": lambda x: ieee.logarithm(F.ln, x), "log2": lambda x: ieee.logarithm(F.log2, x), "log10": lambda x: ieee.logarithm(F.log10, x),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "asinh": lambda x: F.when(F.abs(x) == lit(INF), x).otherwise(F.asinh(x)), "acosh": lambda x: within(x, 1.0, INF, F.acosh), "atanh": lambda x: within(x, -1.0, 1.0, F.atanh),
    "rad": lambda x: x * lit(math.pi / 180), "deg": lambda x: x * lit(180 / math.pi),
}


def rounded(x: Column, to: Column) -> Column:
    """The nearest multiple, halves upwards."""
    inverse = ieee.div(lit(1.0), to)
    return ieee.div(ieee.floor(x * inverse + 0.5), inverse)


def _moment(x: Column) -> Column:
    return F.timestamp_seconds(ieee.floor(x).cast("long"))


#: Of seconds since 1970, in UTC (which the session's time zone has to be).
CALENDAR = {
    "year": lambda x: F.year(_moment(x)), "month": lambda x: F.month(_moment(x)), "day_of_month": lambda x: F.dayofmonth(_moment(x)),
    "day_of_week": lambda x: F.dayofweek(_moment(x)) - 1, "day_of_year": lambda x: F.dayofyear(_moment(x)), "days_in_month": lambda x: F.dayofmonth(F.last_day(_moment(x).cast("date"))),
    "hour": lambda x: F.hour(_moment(x)), "minute": lambda x: F.minute(_moment(x)),
}


def calendar(name: str, x: Column) -> Column:
    return F.when(F.isnan(x), lit(ieee.NAN)).otherwise(CALENDAR[name](F.when(~F.isnan(x), x).otherwise(lit(0.0))).cast("double"))
