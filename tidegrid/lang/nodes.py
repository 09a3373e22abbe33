"""The expression tree.  Nodes are values: equal trees are equal, nothing is changed in place."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Union

SCALAR, VECTOR, MATRIX, STRING = "scalar", "instant vector", "range vector", "string"


@dataclass(frozen=True)
class Matcher:
    name: str
    op: str  # = != =~ !~
    value: str

    def __str__(self) -> str:
        return f"{self.name}{self.op}{quote(self.value)}"


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Selector:
    """``at``: milliseconds, or "start" or "end".  Durations are milliseconds, or expressions to be folded."""

    matchers: tuple[Matcher, ...]
    offset: "Span" = 0
    at: Union[int, str, None] = None
    mode: str = ""  # anchored, smoothed


@dataclass(frozen=True)
class Range:
    selector: Selector
    range: "Span"


@dataclass(frozen=True)
class Subquery:
    expr: "Node"
    range: "Span"
    step: "Span" = 0
    offset: "Span" = 0
    at: Union[int, str, None] = None


@dataclass(frozen=True)
class Unary:
    op: str
    expr: "Node"


@dataclass(frozen=True)
class Matching:
    on: bool = False
    labels: tuple[str, ...] = ()
    card: str = "one-to-one"
    include: tuple[str, ...] = ()
    fill_left: Union[float, None] = None
    fill_right: Union[float, None] = None


@dataclass(frozen=True)
class Binary:
    op: str
    left: "Node"
    right: "Node"
    bool: bool = False
    matching: Union[Matching, None] = None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple["Node", ...]


@dataclass(frozen=True)
class Aggregate:
    op: str
    expr: "Node"
    param: Union["Node", None] = None
    grouping: tuple[str, ...] = ()
    without: bool = False


@dataclass(frozen=True)
class Paren:
    expr: "Node"


@dataclass(frozen=True)
class DurationOp:
    """Arithmetic inside brackets and offsets: seconds, ``step()``, ``range()``, ``min_of``, ``max_of``."""

    op: str
    args: tuple["Span", ...] = field(default=())


Span = Union[int, float, DurationOp]
Node = Union[Number, Text, Selector, Range, Subquery, Unary, Binary, Call, Aggregate, Paren]


def quote(x: str) -> str:
    return '"' + x.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"'


def bare(node: Node) -> Node:
    while isinstance(node, Paren):
        node = node.expr
    return node


__all__ = [x for x in dir() if x[0].isupper()] + ["bare", "quote", "replace"]
