"""Lowers expression trees to DataFrames."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import buckets, elementwise, ieee, labels as L
from ..functions.ieee import lit
from ..lang import nodes as N
from ..lang.parser import COMPARISONS, SETS, ParseError, fits_empty, fold_span, kind, parse
from ..operators import aggregate, matching, rangefuncs, selectors
from ..sources.tables import Source
from .grid import Grid


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Scalar:
    """One number for each step: an expression over ``ts``, or a table (ts, s) of all steps."""

    column: Column | None = None
    frame: DataFrame | None = None
    constant: float | None = None


@dataclass(frozen=True)
class Context:
    """Where an expression stands: the steps, and those of the whole query, which start() and end() mean."""

    grid: Grid
    whole: Grid
    instant: bool


@dataclass(frozen=True)
class Samples:
    """Input of windows: (key, t, f, stale); ``named`` puts labels back in place of keys."""

    rows: DataFrame
    named: "callable"


class Engine:
    """Evaluates expressions over a source of series and samples.

    Results are rows (labels, ts, f), one for each series and step.  Within, rows also have ``gone``, whether the metric
    name is to be dropped at the end.  Nothing is collected: errors that depend on data (two series that match where one
    may) are raised when the result is read.
    """

    def __init__(self, spark: SparkSession, source: Source, *, lookback: int = 300_000, subquery_step: int = 60_000, strict: bool = True):
        self.spark, self.source, self.lookback, self.subquery_step, self.strict = spark, source, lookback, subquery_step, strict

    # Queries

    def range(self, query: str | N.Node, start: int, end: int, step: int) -> DataFrame:
        node = parse(query) if isinstance(query, str) else query
        if kind(node) not in (N.SCALAR, N.VECTOR):
            raise QueryError(f"invalid expression type {kind(node)!r} for range query, must be scalar or instant vector")
        return self._run(node, Grid(start, end, step), False)

    def instant(self, query: str | N.Node, ts: int) -> DataFrame:
        node = parse(query) if isinstance(query, str) else query
        grid = Grid(ts, ts, 1)
        if kind(node) == N.STRING:
            return self.spark.createDataFrame([(N.bare(node).value, ts)], "value string, ts long")
        if kind(node) == N.MATRIX:
            return self._raw(node, Context(grid, grid, True))
        out = self._run(node, grid, True)
        top = N.bare(node)
        if isinstance(top, N.Call) and top.name.startswith("sort"):
            out = self._sorted(top, out)
        return out

    def _run(self, node: N.Node, grid: Grid, instant: bool) -> DataFrame:
        context = Context(grid, grid, instant)
        if kind(node) == N.SCALAR:
            return self._steps(self.scalar(node, context), grid).select(L.empty().alias("labels"), "ts", F.col("s").alias("f"))
        rows = self.vector(node, context)
        out = rows.select(F.when(F.col("gone"), L.drop(F.col("labels"), (L.NAME,))).otherwise(F.col("labels")).alias("labels"), "ts", "f", "gone")
        if not self.strict:
            return out.drop("gone")
        # Only rows that lost their names can have come to be the same.
        n = F.count("*").over(Window.partitionBy("labels", "ts"))
        return matching.demand(out.withColumn("__n", n), F.col("__n") == 1, "vector cannot contain metrics with the same labelset").drop("__n", "gone") if self._renames(node) else out.drop("gone")

    def _renames(self, node: N.Node) -> bool:
        return not isinstance(N.bare(node), (N.Selector, N.Aggregate))

    def _raw(self, node: N.Node, context: Context) -> DataFrame:
        samples, grid, span, offset = self._samples(N.bare(node), context)
        rows = selectors.windows(samples.rows, grid, span, offset)
        return samples.named(rows.select("key", "t", "f")).select("labels", F.col("t").alias("ts"), "f")

    # Selectors

    def _at(self, node, context: Context) -> Grid | None:
        if node.at is None:
            return None
        at = {"start": context.whole.start, "end": context.whole.end}.get(node.at, node.at)
        return Grid(at, at, 1)

    def _span(self, span: N.Span, context: Context) -> int:
        return fold_span(span, 0 if context.instant else context.whole.step, context.whole.end - context.whole.start)

    def _positive(self, span: N.Span, context: Context) -> int:
        out = self._span(span, context)
        if out <= 0:
            raise ParseError("duration must be greater than 0")
        return out

    def _stored(self, s: N.Selector, low: int, high: int, copies: int = 0) -> Samples:
        """``copies``: to how many steps a sample may be dealt."""
        series, rows = self.source.select(s.matchers, low, high, copies)

        def named(frame: DataFrame) -> DataFrame:
            return frame.join(series.select(F.col("series_id").alias("key"), "labels"), "key").drop("key").withColumn("gone", F.lit(False))

        return Samples(rows, named)

    def _samples(self, node: N.Range | N.Subquery, context: Context) -> tuple[Samples, Grid, int, int]:
        """What a window reads; the steps of its references, its length and its offset."""
        span = self._positive(node.range, context)
        inner = node.selector if isinstance(node, N.Range) else node
        grid, offset = self._at(inner, context) or context.grid, self._span(inner.offset, context)
        if isinstance(node, N.Range):
            more = self.lookback if inner.mode else 0
            low, high = grid.start - offset - span - more, grid.last - offset + (more if inner.mode == "smoothed" else 0)
            return self._stored(inner, low + 1, high, grid.most(span)), grid, span, offset
        step = self._span(node.step, context) or self.subquery_step
        first = math.trunc((grid.start - offset - span) / step) * step
        if first <= grid.start - offset - span:
            first += step
        inner_grid = Grid(first, grid.last - offset, step)
        rows = self.vector(node.expr, replace(context, grid=inner_grid))
        rows = rows.select(F.struct("labels", "gone").alias("key"), F.col("ts").alias("t"), "f", F.lit(False).alias("stale"))
        return Samples(rows, lambda frame: frame.select("*", "key.labels", "key.gone").drop("key")), grid, span, offset

    def _select(self, s: N.Selector, context: Context) -> DataFrame:
        """(labels, ts, f, gone, t)."""
        at, offset = self._at(s, context), self._span(s.offset, context)
        grid = at or context.grid
        low, high = grid.start - offset - self.lookback + 1, grid.last - offset
        if s.mode == "smoothed":
            samples = self._stored(s, low, high + self.lookback, grid.most(self.lookback))
            rows = samples.named(selectors.smoothed(samples.rows, grid, self.lookback, offset))
        else:
            samples = self._stored(s, low, high, grid.most(self.lookback))
            rows = selectors.dealt(samples.named(selectors.held(samples.rows, grid, self.lookback, offset)), grid)
        return selectors.spread(rows, context.grid) if at else rows

    # Scalars

    def scalar(self, node: N.Node, context: Context) -> Scalar:
        node = N.bare(node)
        match node:
            case N.Number(value=v):
                return Scalar(lit(v), constant=v)
            case N.Unary(op=op, expr=e):
                return self._with([self.scalar(e, context)], lambda x: -x if op == "-" else x, context)
            case N.Binary(op=op, left=a, right=b):
                how = (lambda x, y: ieee.compare(op, x, y).cast("double")) if op in COMPARISONS else (lambda x, y: ieee.arithmetic(op, x, y))
                return self._with([self.scalar(a, context), self.scalar(b, context)], how, context)
            case N.Call(name="pi"):
                return Scalar(lit(math.pi), constant=math.pi)
            case N.Call(name="time"):
                return Scalar(F.col("ts") / 1000.0)
            case N.Call(name="start" | "end" | "step" | "range" as name):
                w = context.whole
                value = {"start": w.start, "end": w.end, "step": 0 if context.instant else w.step, "range": w.end - w.start}[name] / 1000.0
                return Scalar(lit(value), constant=value)
            case N.Call(name="max_of" | "min_of" as name, args=args):
                how = F.greatest if name == "max_of" else F.least
                guard = lambda x, y: F.when(F.isnan(x) | F.isnan(y), F.when(x.isin(ieee.INF if name == "max_of" else -ieee.INF), x).when(y.isin(ieee.INF if name == "max_of" else -ieee.INF), y).otherwise(lit(ieee.NAN))).otherwise(how(x, y))
                return self._with([self.scalar(a, context) for a in args], guard, context)
            case N.Call(name="scalar", args=(e,)):
                one = self.vector(e, context).groupBy("ts").agg(F.count("*").alias("n"), F.max("f").alias("v"))
                steps = context.grid.steps(self.spark)
                return Scalar(frame=steps.join(one, "ts", "left").select("ts", F.when(F.col("n") == 1, F.col("v")).otherwise(lit(ieee.NAN)).alias("s")))
        raise QueryError(f"unhandled scalar expression {node}")

    def _steps(self, s: Scalar, grid: Grid) -> DataFrame:
        return s.frame if s.frame is not None else grid.steps(self.spark).select("ts", s.column.alias("s"))

    def _with(self, parts: list[Scalar], how, context: Context) -> Scalar:
        if all(p.frame is None for p in parts):
            return Scalar(how(*[p.column for p in parts]))
        frames = [self._steps(p, context.grid).withColumnRenamed("s", f"s{i}") for i, p in enumerate(parts)]
        joined = reduce(lambda a, b: a.join(b, "ts"), frames)
        return Scalar(frame=joined.select("ts", how(*[F.col(f"s{i}") for i in range(len(parts))]).alias("s")))

    def _attach(self, rows: DataFrame, s: Scalar, name: str) -> DataFrame:
        """Rows with a scalar's value at their step."""
        if s.frame is None:
            return rows.withColumn(name, s.column)
        return rows.join(s.frame.withColumnRenamed("s", name), "ts")

    # Vectors

    def vector(self, node: N.Node, context: Context) -> DataFrame:
        node = N.bare(node)
        match node:
            case N.Selector():
                return self._select(node, context).drop("t")
            case N.Unary(op=op, expr=e):
                rows = self.vector(e, context)
                return rows.withColumns({"f": -F.col("f"), "gone": F.lit(True)}) if op == "-" else rows
            case N.Aggregate():
                return self._aggregate(node, context)
            case N.Binary():
                return self._binary(node, context)
            case N.Call():
                return self._call(node, context)
        raise QueryError(f"unhandled expression {node}")

    def _aggregate(self, node: N.Aggregate, context: Context) -> DataFrame:
        rows = self.vector(node.expr, context)
        if node.op == "count_values":
            return aggregate.count_values(rows, N.bare(node.param).value, node.grouping, node.without)
        if node.param is not None:
            rows = self._attach(rows, self.scalar(node.param, context), "p")
        return aggregate.aggregate(rows, node.op, node.grouping, node.without)

    def _binary(self, node: N.Binary, context: Context) -> DataFrame:
        left, right = kind(node.left), kind(node.right)
        if node.op in ("</", ">/"):
            raise QueryError("trim operators apply to native histograms, which this engine does not hold")
        if N.SCALAR in (left, right):
            rows, s = (node.right, node.left) if left == N.SCALAR else (node.left, node.right)
            frame = self._attach(self.vector(rows, context), self.scalar(s, context), "s")
            a, b = (F.col("s"), F.col("f")) if left == N.SCALAR else (F.col("f"), F.col("s"))
            return matching.applied(frame, node.op, a, b, F.col("f"), node.bool).drop("s")
        a, b = self.vector(node.left, context), self.vector(node.right, context)
        m = node.matching or N.Matching()
        if node.op in SETS:
            return matching.set_operation(a, b, node.op, m)
        return matching.joined(a, b, node.op, m, node.bool, self.strict)

    # Functions

    def _call(self, node: N.Call, context: Context) -> DataFrame:
        name, args = node.name, node.args
        if args and any(kind(a) == N.MATRIX for a in args):
            return self._window(name, args, context)
        if name in elementwise.CALENDAR:
            rows = self.vector(args[0], context) if args else context.grid.steps(self.spark).select(L.empty().alias("labels"), "ts", (F.col("ts") / 1000.0).alias("f"))
            return rows.withColumns({"f": elementwise.calendar(name, F.col("f")), "gone": F.lit(bool(args))})
        if name == "vector":
            return self._steps(self.scalar(args[0], context), context.grid).select(L.empty().alias("labels"), "ts", F.col("s").alias("f"), F.lit(False).alias("gone"))
        if name == "timestamp":
            inner = N.bare(args[0])
            rows = self._select(inner, context).withColumn("f", F.col("t") / 1000.0).drop("t") if isinstance(inner, N.Selector) else self.vector(inner, context).withColumn("f", F.col("ts") / 1000.0)
            return rows.withColumn("gone", F.lit(True))
        if name == "absent":
            return self._absent(self.vector(args[0], context).select("ts"), args[0], context)
        if name in ("histogram_quantile", "histogram_fraction", "histogram_quantiles"):
            return self._buckets(name, args, context)
        if name in ("label_replace", "label_join"):
            return self._relabelled(name, self.vector(args[0], context), [N.bare(a).value for a in args[1:]])
        if name.startswith("sort"):
            return self.vector(args[0], context)
        if name == "info":
            return matching.info(self.vector(args[0], context), *self._info(args, context))
        if name.startswith("histogram_"):  # plain numbers are no histograms
            return self.vector(args[0], context).where("false")
        rows = self.vector(args[0], context)
        if name in elementwise.MATH:
            return rows.withColumns({"f": elementwise.MATH[name](F.col("f")), "gone": F.lit(True)})
        extra = [self.scalar(a, context) for a in args[1:]]
        for i, s in enumerate(extra):
            rows = self._attach(rows, s, f"a{i}")
        a0, a1 = F.col("a0"), F.col("a1")
        match name:
            case "round":
                f = elementwise.rounded(F.col("f"), a0 if extra else lit(1.0))
            case "clamp":
                rows, f = rows.where(~(a0 > a1) | F.isnan(a0) | F.isnan(a1)), ieee.clamp(F.col("f"), a0, a1)
            case "clamp_min":
                f = ieee.clamp(F.col("f"), a0, None)
            case "clamp_max":
                f = ieee.clamp(F.col("f"), None, a0)
            case _:
                raise QueryError(f"unhandled function {name}")
        return rows.withColumns({"f": f, "gone": F.lit(True)}).drop("a0", "a1")

    def _window(self, name: str, args: tuple[N.Node, ...], context: Context) -> DataFrame:
        node = N.bare(next(a for a in args if kind(a) == N.MATRIX))
        others = [a for a in args if kind(a) != N.MATRIX]
        samples, grid, span, offset = self._samples(node, context)
        inner = node.selector if isinstance(node, N.Range) else node
        mode = getattr(inner, "mode", "")
        rows = selectors.windows(samples.rows, grid, span, offset)
        fixed = grid is not context.grid
        if name == "absent_over_time":
            found = rows.select("ts").distinct()
            return self._absent(selectors.spread(found, context.grid) if fixed else found, node, context)
        if mode:
            left = selectors.edges(samples.rows, grid, span, offset, self.lookback, mode == "smoothed")
            right = selectors.smoothed(samples.rows, grid, self.lookback, offset) if mode == "smoothed" else None
            out = rangefuncs.edge_rate(rows, left, name, span, right)
        elif name in rangefuncs.SIMPLE:
            out = rangefuncs.simple(rows, name)
        elif name in ("rate", "increase", "delta"):
            out = rangefuncs.rate(rows, name, span, offset)
        elif name in ("irate", "idelta"):
            out = rangefuncs.instant(rows, name)
        elif name == "mad_over_time":
            out = rangefuncs.mad(rows)
        elif name == "deriv":
            out = rangefuncs.line(rows, name, None)
        elif name == "double_exponential_smoothing":
            level, trend = (self._constant(a, context) for a in others)
            for x, what in ((level, "smoothing"), (trend, "trend")):
                if not 0 < x < 1:
                    raise QueryError(f"invalid {what} factor. Expected: 0 < {what[0]}f < 1, got: {x}")
            out = rangefuncs.smoothing(rows, level, trend)
        else:
            s = self.scalar(others[0], context)
            if s.frame is None:
                rows, parameter = rows, s.column
            else:
                rows, parameter = rows.join(s.frame, "ts"), F.max("s")
            if name == "quantile_over_time":
                out = rangefuncs.quantile(rows, s.column) if s.frame is None else self._attach(rangefuncs.quantile(rows.drop("s"), lit(0.5)), s, "s").drop("s")
            else:
                out = rangefuncs.line(rows, name, s.column if s.frame is None else parameter)
        if fixed:
            out = selectors.spread(out, context.grid)
            if name == "predict_linear":  # the line is that of the fixed moment, but it is read at the step
                out = out.withColumn("f", F.col("f") + F.col("slope") * (F.col("ts") - F.lit(grid.start)) / 1000.0)
        out = out.select("key", "ts", "f")
        named = samples.named(out)
        return named if name in rangefuncs.KEEP_NAME else named.withColumn("gone", F.lit(True))

    def _constant(self, node: N.Node, context: Context) -> float:
        node = N.bare(node)
        if isinstance(node, N.Unary):
            return -self._constant(node.expr, context) if node.op == "-" else self._constant(node.expr, context)
        if not isinstance(node, N.Number):
            raise QueryError("this argument has to be a number")
        return node.value

    def _absent(self, found: DataFrame, arg: N.Node, context: Context) -> DataFrame:
        """1 at steps without rows; its labels are those that the selector asks for by equality, once."""
        inner = N.bare(arg)
        inner = inner.selector if isinstance(inner, N.Range) else inner
        wanted: dict[str, str | None] = {}
        for m in inner.matchers if isinstance(inner, N.Selector) else ():
            if m.name != L.NAME:
                wanted[m.name] = m.value if m.op == "=" and m.name not in wanted else None
        labels = L.of({k: F.lit(v) for k, v in wanted.items() if v})
        return context.grid.steps(self.spark).join(found.distinct(), "ts", "left_anti").select(labels.alias("labels"), "ts", lit(1.0).alias("f"), F.lit(False).alias("gone"))

    def _buckets(self, name: str, args: tuple[N.Node, ...], context: Context) -> DataFrame:
        if name == "histogram_quantiles":
            rows, label, numbers = args[0], N.bare(args[1]).value, args[2:]
        else:
            rows, label, numbers = args[-1], None, args[:-1]
        frame = self.vector(rows, context)
        frame = frame.withColumn("le", buckets.bound(L.value(F.col("labels"), "le"))).where(F.col("le").isNotNull())
        grouped = frame.groupBy(L.drop(F.col("labels"), ("le", L.NAME)).alias("labels"), "ts").agg(F.collect_list(F.struct("le", F.col("f").alias("n"))).alias("b"))
        grouped = grouped.withColumn("b", buckets.cleaned(F.col("b")))
        for i, number in enumerate(numbers):
            grouped = self._attach(grouped, self.scalar(number, context), f"q{i}")
        if name == "histogram_quantile":
            grouped = grouped.withColumn("f", buckets.quantile(F.col("b"), F.col("q0")))
        elif name == "histogram_fraction":
            grouped = grouped.withColumn("f", buckets.fraction(F.col("b"), F.col("q0"), F.col("q1")))
        else:
            each = F.explode(F.array(*[F.col(f"q{i}") for i in range(len(numbers))]))
            grouped = grouped.withColumn("q", each).withColumn("f", buckets.quantile(F.col("b"), F.col("q"))).withColumn("labels", L.put(F.col("labels"), label, ieee.text(F.col("q"))))
        return grouped.select("labels", "ts", "f", F.lit(False).alias("gone"))

    def _relabelled(self, name: str, rows: DataFrame, words: list[str]) -> DataFrame:
        labels = F.col("labels")
        if name == "label_join":
            into, separator, *sources = words
            new = F.concat_ws(separator, *[L.value(labels, s) for s in sources]) if sources else F.lit("")
            changed = L.put(labels, into, new)
        else:
            into, replacement, source, regex = words
            found, pattern = L.value(labels, source), L.pattern(regex)
            # Groups by number or name, with or without braces; a group that is not there is empty.
            new = F.regexp_replace(found, pattern, _template(replacement, regex))
            changed = F.when(found.rlike(pattern), L.put(labels, into, new)).otherwise(labels)
        out = rows.withColumn("labels", changed)
        if into == L.NAME:
            out = out.withColumn("gone", F.lit(False))
        if not self.strict:
            return out
        n = F.count("*").over(Window.partitionBy("labels", "ts"))
        return matching.demand(out.withColumn("__n", n), F.col("__n") == 1, "vector cannot contain metrics with the same labelset").drop("__n")

    def _info(self, args: tuple[N.Node, ...], context: Context) -> tuple[DataFrame, tuple[str, ...], bool]:
        """The info series, the labels wanted from them (none: all), and whether a row has to have them."""
        wanted = N.bare(args[1]).matchers if len(args) == 2 else ()
        named = tuple(m for m in wanted if m.name == L.NAME) or (N.Matcher(L.NAME, "=", "target_info"),)
        data = tuple(m for m in wanted if m.name != L.NAME)
        found = self._select(N.Selector(named + data), context)
        return found, tuple(m.name for m in data), any(not fits_empty(m) for m in data)

    def _sorted(self, node: N.Call, rows: DataFrame) -> DataFrame:
        nan = F.isnan("f")
        match node.name:
            case "sort":
                return rows.orderBy(nan, "f")
            case "sort_desc":
                return rows.orderBy(nan, F.desc("f"))
        names = [N.bare(a).value for a in node.args[1:]]
        keys = [_natural(L.value(F.col("labels"), n)) for n in names] + [F.col("labels")]
        return rows.orderBy(*[k.desc() if node.name.endswith("desc") else k.asc() for k in keys])


def _natural(x: Column) -> Column:
    """Text with runs of digits widened, so that they sort as numbers."""
    return F.transform(F.regexp_extract_all(x, F.lit(r"\d+|\D+"), F.lit(0)), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 40, "0")).otherwise(p))


def _template(replacement: str, regex: str) -> str:
    """A replacement in the notation that Spark takes."""
    names = re.findall(r"\(\?P?<([A-Za-z_]\w*)>", regex)
    groups = re.compile(re.sub(r"\(\?<([A-Za-z_])", r"(?P<\1", regex)).groups

    def one(m: re.Match) -> str:
        if m.group() == "$$":
            return "\\$"
        word = m.group(1) or m.group(2)
        if word.isdigit():
            return f"${word}" if int(word) <= groups else ""
        return f"${{{word}}}" if word in names else ""

    out, at = [], 0
    for m in re.finditer(r"\$\$|\$\{(\w+)\}|\$(\w+)", replacement):
        out += [replacement[at : m.start()].replace("\\", "\\\\"), one(m)]
        at = m.end()
    return "".join([*out, replacement[at:].replace("\\", "\\\\").replace("$", "\\$")])
