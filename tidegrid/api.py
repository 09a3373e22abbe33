"""The operators without the language: ``series("m", job="x").rate("5m").sum(by=["zone"])``."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from .lang import nodes as N
from .lang.parser import check, duration
from .lang.signatures import AGGREGATIONS, FUNCTIONS, PARAMETERS
from .plans.engine import Engine


def _ms(x: str | int) -> int:
    return duration(x) if isinstance(x, str) else x


def _node(x: Any) -> N.Node:
    return x.node if isinstance(x, Expr) else N.Text(x) if isinstance(x, str) else N.Number(float(x))


@dataclass(frozen=True)
class Expr:
    """An expression.  Functions and aggregations of the language are methods; comparisons keep rows, as there."""

    node: N.Node

    def _shifted(self, **change) -> Expr:
        if isinstance(self.node, N.Range):
            return Expr(N.replace(self.node, selector=N.replace(self.node.selector, **change)))
        return Expr(N.replace(self.node, **change))

    def window(self, span: str | int, step: str | int | None = None) -> Expr:
        if isinstance(self.node, N.Selector) and step is None:
            return Expr(N.Range(self.node, _ms(span)))
        return Expr(N.Subquery(self.node, _ms(span), _ms(step or 0)))

    def offset(self, by: str | int) -> Expr:
        return self._shifted(offset=_ms(by))

    def at(self, moment: int | str) -> Expr:
        return self._shifted(at=moment)

    def __getattr__(self, name: str):
        if name in AGGREGATIONS:
            return lambda param=None, *, by=(), without=None: Expr(check(N.Aggregate(name, self.node, _node(param) if name in PARAMETERS else None, tuple(by if without is None else without), without is not None)))
        if name in FUNCTIONS:
            return lambda *args: self._call(name, args)
        raise AttributeError(name)

    def _call(self, name: str, args: tuple) -> Expr:
        """The expression takes the place of the function's first series; a duration before others is its window."""
        wanted, args = FUNCTIONS[name].args, list(args)
        place = next((i for i, kind in enumerate(wanted) if kind in (N.VECTOR, N.MATRIX)), 0)
        subject: Expr = self
        if wanted and wanted[place] == N.MATRIX and not isinstance(self.node, (N.Range, N.Subquery)):
            subject = self.window(args.pop(0))
        nodes = [_node(a) for a in args]
        nodes.insert(place, subject.node)
        return Expr(check(N.Call(name, tuple(nodes))))

    def match(self, op: str, other: Any, *, on=None, ignoring=None, left=None, right=None, bool: bool = False, fill: float | None = None) -> Expr:
        """An operator between series; ``left`` and ``right``: labels to take along from the one side."""
        many = "many-to-one" if left is not None else "one-to-many" if right is not None else "one-to-one"
        plain = on is None and ignoring is None and many == "one-to-one" and fill is None
        m = None if plain else N.Matching(on is not None, tuple(on or ignoring or ()), many, tuple(left or right or ()), fill, fill)
        return Expr(check(N.Binary(op, N.Paren(self.node), N.Paren(_node(other)), bool, m)))

    def evaluate(self, engine: Engine, start: int, end: int, step: int) -> DataFrame:
        return engine.range(self.node, start, end, step)


def _operator(op: str, swap: bool = False):
    return lambda self, other: Expr(other if isinstance(other, N.Node.__args__) else _node(other)).match(op, self) if swap else self.match(op, other)


for _name, _op in {"add": "+", "sub": "-", "mul": "*", "truediv": "/", "mod": "%", "pow": "^"}.items():
    setattr(Expr, f"__{_name}__", _operator(_op))
    setattr(Expr, f"__r{_name}__", _operator(_op, True))
for _name, _op in {"gt": ">", "ge": ">=", "lt": "<", "le": "<=", "and": "and", "or": "or"}.items():
    setattr(Expr, f"__{_name}__", _operator(_op))


def series(name: str, *matchers: N.Matcher, **labels: str) -> Expr:
    return Expr(N.Selector((N.Matcher("__name__", "=", name), *matchers, *[N.Matcher(k, "=", v) for k, v in labels.items()])))
