"""Label sets: sorted arrays of (key, value) without empty values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.nodes import Matcher

TYPE = "array<struct<key:string,value:string>>"
NAME = "__name__"


def of(pairs: dict[str, Column]) -> Column:
    """A label set of the named columns; null and empty values are no labels."""
    each = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in sorted(pairs.items())]
    return F.filter(F.array(*each), lambda x: x["value"].isNotNull() & (x["value"] != "")) if each else empty()


def empty() -> Column:
    return F.array().cast(TYPE)


def value(labels: Column, name: str) -> Column:
    """The value of a label; empty if it is not there."""
    return F.coalesce(F.try_element_at(F.transform(F.filter(labels, lambda x: x["key"] == name), lambda x: x["value"]), F.lit(1)), F.lit(""))


def keep(labels: Column, names: tuple[str, ...]) -> Column:
    return F.filter(labels, lambda x: x["key"].isin(*names)) if names else empty()


def drop(labels: Column, names: tuple[str, ...]) -> Column:
    return F.filter(labels, lambda x: ~x["key"].isin(*names)) if names else labels


def put(labels: Column, name: str, new: Column) -> Column:
    """With the label set; an empty value takes it away."""
    rest = drop(labels, (name,))
    one = F.array(F.struct(F.lit(name).alias("key"), new.alias("value")))
    return F.when(F.coalesce(new, F.lit("")) == "", rest).otherwise(F.array_sort(F.concat(rest, one)))


def pattern(regex: str) -> str:
    """Matches whole values, a dot also line ends."""
    return f"^(?s:{re.sub(r'[(][?]P<', '(?<', regex)})\\z"


def matches(labels: Column, matchers: tuple[Matcher, ...]) -> Column:
    out = F.lit(True)
    for m in matchers:
        found = value(labels, m.name)
        match m.op:
            case "=":
                out = out & (found == m.value)
            case "!=":
                out = out & (found != m.value)
            case _:
                literal = re.fullmatch(r"[\w \-]+(?:\|[\w \-]+)*", m.value)
                fits = found.isin(*m.value.split("|")) if literal else found.rlike(pattern(m.value))
                out = out & (fits if m.op == "=~" else ~fits)
    return out
