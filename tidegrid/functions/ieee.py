"""Arithmetic on doubles as IEEE 754 has it, which Spark's own operators do not give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def lit(x: float) -> Column:
    return F.lit(float(x))


def div(a: Column, b: Column) -> Column:
    """Division by a zero of either sign is infinite, of zero by zero is NaN."""
    return F.when(b == 0, a * F.pow(b, lit(-1.0))).otherwise(a / F.when(b != 0, b))


def mod(a: Column, b: Column) -> Column:
    return F.when((b == 0) | F.isnan(b) | F.isnan(a), lit(NAN)).otherwise(a % F.when(b != 0, b))


def power(a: Column, b: Column) -> Column:
    return F.when(a == 1, lit(1.0)).when((a == -1) & (F.abs(b) == lit(INF)), lit(1.0)).otherwise(F.pow(a, b))


def compare(op: str, a: Column, b: Column) -> Column:
    """With NaN every comparison is false but inequality."""
    known = ~F.isnan(a) & ~F.isnan(b)
    match op:
        case "==":
            return known & (a == b)
        case "!=":
            return ~(known & (a == b))
        case "<":
            return known & (a < b)
        case "<=":
            return known & (a <= b)
        case ">":
            return known & (a > b)
        case _:
            return known & (a >= b)


def arithmetic(op: str, a: Column, b: Column) -> Column:
    match op:
        case "+":
            return a + b
        case "-":
            return a - b
        case "*":
            return a * b
        case "/":
            return div(a, b)
        case "%":
            return mod(a, b)
        case "^":
            return power(a, b)
        case _:
            return F.atan2(a, b)


def _rounded(how) -> "callable":
    # Beyond 2^52 a double has no fraction; Spark's result would be a 64-bit integer.
    return lambda x: F.when(F.abs(x) < 2.0**52, how(F.when(F.abs(x) < 2.0**52, x).otherwise(lit(0.0))).cast("double")).otherwise(x)


floor, ceil = _rounded(F.floor), _rounded(F.ceil)


def logarithm(how, x: Column) -> Column:
    return F.when(F.isnan(x) | (x < 0), lit(NAN)).when(x == 0, lit(-INF)).otherwise(how(F.when(x > 0, x).otherwise(lit(1.0))))


def within(x: Column, low: float, high: float, how) -> Column:
    """A function that is NaN outside of [low, high]."""
    return F.when((x >= low) & (x <= high) & ~F.isnan(x), how(x)).otherwise(lit(NAN))


def least(x: Column) -> Column:
    """The smallest of a group; NaN only if there is nothing else."""
    return F.coalesce(F.min(F.when(~F.isnan(x), x)), lit(NAN))


def largest(x: Column) -> Column:
    return F.coalesce(F.max(F.when(~F.isnan(x), x)), lit(NAN))


def sign(x: Column) -> Column:
    return F.when(compare("<", x, lit(0)), lit(-1.0)).when(compare(">", x, lit(0)), lit(1.0)).otherwise(x)


def clamp(x: Column, low: Column | None, high: Column | None) -> Column:
    out = x
    if low is not None:
        out = F.when(F.isnan(out) | F.isnan(low), lit(NAN)).otherwise(F.greatest(out, low))
    if high is not None:
        out = F.when(F.isnan(out) | F.isnan(high), lit(NAN)).otherwise(F.least(out, high))
    return out


def quantile(values: Column, q: Column) -> Column:
    """Of an array of doubles: linear between the ranks q (n - 1), NaN counting as the smallest."""
    ordered = F.concat(F.filter(values, F.isnan), F.array_sort(F.filter(values, lambda v: ~F.isnan(v))))
    last = (F.size(values) - 1).cast("double")
    rank = F.greatest(F.least(q, lit(1.0)), lit(0.0)) * last
    low = F.floor(rank).cast("int")
    high = F.least(low + 1, F.size(values) - 1)
    weight = rank - low
    inner = F.element_at(ordered, low + 1) * (1 - weight) + F.element_at(ordered, high + 1) * weight
    return F.when(F.isnan(q) | (F.size(values) == 0), lit(NAN)).when(q < 0, lit(-INF)).when(q > 1, lit(INF)).otherwise(inner)


def text(x: Column) -> Column:
    """The shortest decimal notation without an exponent."""
    whole = F.when((x == F.floor(F.when(F.abs(x) < 1e15, x).otherwise(lit(0.5)))) & (F.abs(x) < 1e15), F.floor(F.when(F.abs(x) < 1e15, x).otherwise(lit(0.0))).cast("string"))
    plain = F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return F.when(F.isnan(x), "NaN").when(x == lit(INF), "+Inf").when(x == lit(-INF), "-Inf").otherwise(F.coalesce(whole, F.when(x.cast("string").contains("E"), plain).otherwise(x.cast("string"))))
