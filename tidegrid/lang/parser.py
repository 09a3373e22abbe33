"""From text to a checked expression tree."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from .nodes import (MATRIX, SCALAR, STRING, VECTOR, Aggregate, Binary, Call, DurationOp, Matcher, Matching, Node, Number, Paren, Range, Selector, Span, Subquery, Text, Unary, bare, replace)
from .signatures import AGGREGATIONS, FUNCTIONS, PARAMETERS


class ParseError(ValueError):
    """What is wrong with a query, and at which of its characters."""

    def __init__(self, what: str, at: int = 0):
        super().__init__(f"parse error at char {at + 1}: {what}")
        self.at = at


#: Units of durations in the order in which they may follow each other, in milliseconds.
UNITS = {"y": 31_536_000_000, "w": 604_800_000, "d": 86_400_000, "h": 3_600_000, "m": 60_000, "s": 1000, "ms": 1}
_DURATION = r"(?:\d+(?:ms|[ywdhms]))+(?![A-Za-z0-9_.])"
_TOKENS = re.compile(
    rf"""(?P<space>\s+|\#[^\n]*)
    |(?P<duration>{_DURATION})
    |(?P<number>0[xX][0-9a-fA-F_]+(?![A-Za-z0-9_.])|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?(?![A-Za-z0-9_.])|(?:[iI][nN][fF]|[nN][aA][nN])(?![A-Za-z0-9_:]))
    |(?P<name>[A-Za-z_:][A-Za-z0-9_:]*)
    |(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)
    |(?P<mark>=~|!~|==|!=|>=|<=|</|>/|[-+*/%^=<>(){{}}\[\],:@])""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def tokens(text: str) -> list[Token]:
    out, at, inside = [], 0, 0
    while at < len(text):
        found = _TOKENS.match(text, at)
        if found and inside and ":" in found.group() and found.lastgroup == "name":  # a colon parts range and step there
            found = _TOKENS.match(text[: at + max(1, found.group().index(":"))], at) if found.group()[0] != ":" else re.compile("(?P<mark>:)").match(text, at)
        if not found:
            raise ParseError("unterminated quoted string" if text[at] in "\"'`" else f"unexpected character: {text[at]!r}", at)
        if found.lastgroup != "space":
            out.append(Token(found.lastgroup, found.group(), at))
            inside += {"[": 1, "]": -1}.get(found.group(), 0)
        at = found.end()
    return [*out, Token("end", "", at)]


def duration(text: str) -> int:
    """Milliseconds; each unit once at most, the larger first."""
    total, last = 0, -1
    order = list(UNITS)
    if text == "0":
        return 0
    if not re.fullmatch(r"(?:\d+(?:ms|[ywdhms]))+", text):
        raise ParseError(f"not a valid duration string: {text!r}")
    for n, unit in re.findall(r"(\d+)(ms|[ywdhms])", text):
        if order.index(unit) <= last:
            raise ParseError(f"not a valid duration string: {text!r}")
        last = order.index(unit)
        total += int(n) * UNITS[unit]
    return total


_ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", "'": "'", '"': '"'}


def unquote(token: str) -> str:
    if token[0] == "`":
        return token[1:-1]

    def one(m: re.Match) -> str:
        x = m.group(1)
        if x in _ESCAPES:
            return _ESCAPES[x]
        if len(x) > 1:
            code = int(x[1:], 16) if x[0] in "xuU" else int(x, 8)
            if code > 0x10FFFF or 0xD800 <= code < 0xE000 or x[0] not in "xuU" and code > 255:
                raise ParseError(f"no character has the escape sequence \\{x}")
            return chr(code)
        raise ParseError(f"unknown escape sequence \\{x}")

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.)", one, token[1:-1], flags=re.S)


def number(text: str) -> float:
    plain = text.replace("_", "").lower()
    if plain.startswith("0x"):
        return float(int(plain, 16))
    if plain in ("inf", "nan"):
        return float(plain)
    if re.fullmatch(r"0[0-7]+", plain):
        return float(int(plain, 8))
    return float(plain)


#: Binary operators by how tightly they bind.
LEVELS = {"or": 1, "and": 2, "unless": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "</": 3, ">/": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5, "atan2": 5, "^": 6}
COMPARISONS, SETS = ("==", "!=", "<", "<=", ">", ">="), ("and", "or", "unless")


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, tokens(text), 0

    @property
    def next(self) -> Token:
        return self.tokens[self.at]

    def take(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def is_next(self, *texts: str) -> bool:
        return self.next.kind in ("mark", "name") and (self.next.text in texts or self.next.kind == "name" and self.next.text.lower() in texts)

    def maybe(self, *texts: str) -> Token | None:
        return self.take() if self.is_next(*texts) else None

    def need(self, text: str, where: str = "") -> Token:
        if not self.is_next(text):
            raise self.unexpected(where or f"expected {text!r}")
        return self.take()

    def unexpected(self, where: str) -> ParseError:
        return ParseError(f"unexpected {self.next.text!r}" * bool(self.next.text) + "unexpected end of input" * (not self.next.text) + f", {where}", self.next.at)

    # Expressions

    def whole(self) -> Node:
        if self.next.kind == "end":
            raise ParseError("no expression found in input")
        out = self.expression(0)
        if self.next.kind != "end":
            raise self.unexpected("expected an operator or the end")
        return out

    def expression(self, least: int) -> Node:
        left = self.unary()
        while True:
            op = self.next.text.lower() if self.next.kind in ("mark", "name") else ""
            level = LEVELS.get(op, 0)
            if not level or level < least:
                return left
            self.take()
            left = self.binary(op, left, level if op == "^" else level + 1)

    def unary(self) -> Node:
        if sign := self.maybe("-", "+"):
            inner = self.expression(LEVELS["^"])
            if isinstance(inner, Number):
                return Number(-inner.value if sign.text == "-" else inner.value)
            return Unary(sign.text, inner)
        return self.postfix(self.primary())

    def binary(self, op: str, left: Node, least: int) -> Node:
        as_bool = bool(self.maybe("bool"))
        matching = None
        if word := self.maybe("on", "ignoring"):
            matching = Matching(word.text.lower() == "on", self.labels())
            if side := self.maybe("group_left", "group_right"):
                include = self.labels() if self.is_next("(") else ()
                matching = replace(matching, card="many-to-one" if side.text.lower() == "group_left" else "one-to-many", include=include)
        while fill := self.maybe("fill", "fill_left", "fill_right"):
            self.need("(")
            sign = -1.0 if self.maybe("-") else 1.0
            self.maybe("+")
            if self.next.kind != "number":
                raise self.unexpected("expected a number to fill in")
            value = sign * number(self.take().text)
            self.need(")")
            matching = matching or Matching()
            sides = {"fill_left": ("fill_left",), "fill_right": ("fill_right",)}.get(fill.text.lower(), ("fill_left", "fill_right"))
            matching = replace(matching, **{s: value for s in sides})
        return Binary(op, left, self.expression(least), as_bool, matching)

    def labels(self) -> tuple[str, ...]:
        self.need("(")
        out = []
        while not self.is_next(")"):
            if self.next.kind not in ("name", "text"):
                raise self.unexpected("expected a label name")
            token = self.take()
            out.append(unquote(token.text) if token.kind == "text" else token.text)
            if not self.maybe(","):
                break
        self.need(")")
        return tuple(out)

    def primary(self) -> Node:
        token = self.next
        if token.kind == "number":
            return Number(number(self.take().text))
        if token.kind == "duration":
            return Number(duration(self.take().text) / 1000)
        if token.kind == "text":
            return Text(unquote(self.take().text))
        if self.maybe("("):
            inner = self.expression(0)
            self.need(")", "unclosed left parenthesis")
            return Paren(inner)
        if self.is_next("{"):
            return Selector(self.matchers(()))
        if token.kind != "name":
            raise self.unexpected("expected an expression")
        word, after = token.text, self.tokens[self.at + 1]
        if word.lower() in AGGREGATIONS and (after.text == "(" or after.text.lower() in ("by", "without")):
            return self.aggregate()
        if after.text == "(":
            return self.call()
        self.take()
        name = (Matcher("__name__", "=", word),)
        return Selector(self.matchers(name) if self.is_next("{") else name)

    def matchers(self, first: tuple[Matcher, ...]) -> tuple[Matcher, ...]:
        self.need("{")
        out = list(first)
        while not self.is_next("}"):
            if self.next.kind not in ("name", "text"):
                raise self.unexpected("expected a label matcher")
            token = self.take()
            name = unquote(token.text) if token.kind == "text" else token.text
            if token.kind == "text" and self.is_next(",", "}"):
                if any(m.name == "__name__" for m in out):
                    raise ParseError(f"metric name must not be set twice: {name!r}", token.at)
                out.append(Matcher("__name__", "=", name))
            else:
                op = self.maybe("=", "!=", "=~", "!~")
                if not op:
                    raise self.unexpected("expected a matching operator")
                if self.next.kind != "text":
                    raise self.unexpected("expected a quoted label value")
                out.append(Matcher(name, op.text, unquote(self.take().text)))
                if first and name == "__name__":
                    raise ParseError("metric name must not be set twice", token.at)
            if not self.maybe(","):
                break
        self.need("}")
        return tuple(out)

    def aggregate(self) -> Node:
        op = self.take()
        by = self.maybe("by", "without")
        grouping = self.labels() if by else ()
        args = self.arguments()
        if not by and (by := self.maybe("by", "without")):
            grouping = self.labels()
        name = op.text.lower()
        wanted = 2 if name in PARAMETERS else 1
        if len(args) != wanted:
            raise ParseError(f"wrong number of arguments for aggregate expression provided, expected {wanted}, got {len(args)}", op.at)
        return Aggregate(name, args[-1], args[0] if wanted == 2 else None, grouping, bool(by) and by.text.lower() == "without")

    def arguments(self) -> tuple[Node, ...]:
        self.need("(")
        out = []
        while not self.is_next(")"):
            out.append(self.expression(0))
            if not self.maybe(","):
                break
            if self.is_next(")"):
                raise self.unexpected("trailing commas not allowed in function call args")
        self.need(")")
        return tuple(out)

    def call(self) -> Node:
        name = self.take()
        if name.text not in FUNCTIONS:
            raise ParseError(f"unknown function with name {name.text!r}", name.at)
        return Call(name.text, self.arguments())

    def postfix(self, node: Node) -> Node:
        while True:
            at = self.next.at
            if self.maybe("["):
                span = self.span()
                if self.maybe(":"):
                    step = 0 if self.is_next("]") else self.span()
                    self.need("]")
                    node = Subquery(node, span, step)
                else:
                    self.need("]", "expected ':' or ']'")
                    if not isinstance(node, Selector):
                        raise ParseError("ranges only allowed for vector selectors", at)
                    if node.offset != 0 or node.at is not None:
                        raise ParseError("no offset or @ modifiers allowed before range", at)
                    node = Range(node, span)
            elif self.maybe("offset"):
                sign = -1 if self.maybe("-") else 1
                self.maybe("+")
                span = self.span_atom()
                node = self._with(node, "offset", span if sign > 0 else DurationOp("neg", (span,)) if isinstance(span, DurationOp) else -span, at)
            elif self.maybe("@"):
                node = self._with(node, "at", self.instant(), at)
            elif word := self.maybe("anchored", "smoothed"):
                inner = node.selector if isinstance(node, Range) else node
                if not isinstance(inner, Selector):
                    raise ParseError(f"{word.text} modifier only allowed on selectors", at)
                inner = replace(inner, mode=word.text.lower())
                node = replace(node, selector=inner) if isinstance(node, Range) else inner
            else:
                return node

    def _with(self, node: Node, what: str, value, at: int) -> Node:
        inner = node.selector if isinstance(node, Range) else node
        if not isinstance(inner, (Selector, Subquery)):
            raise ParseError(f"{'offset' if what == 'offset' else '@'} modifier must be preceded by an instant vector selector or range vector selector or a subquery", at)
        if getattr(inner, what) not in (0, None):
            raise ParseError(f"{'offset' if what == 'offset' else '@ <timestamp>'} may not be set multiple times", at)
        inner = replace(inner, **{what: value})
        return replace(node, selector=inner) if isinstance(node, Range) else inner

    def instant(self) -> int | str:
        if word := self.maybe("start", "end"):
            self.need("(")
            self.need(")")
            return word.text.lower()
        sign = -1 if self.maybe("-") else 1
        self.maybe("+")
        token = self.take()
        if token.kind not in ("number", "duration"):
            raise ParseError("expected a timestamp after @", token.at)
        value = sign * (number(token.text) if token.kind == "number" else duration(token.text) / 1000)
        if not math.isfinite(value) or abs(value) > 9.2e15:
            raise ParseError("timestamp out of bounds for @ modifier", token.at)
        return math.floor(value * 1000 + 0.5)

    # Durations, which may be calculated

    def span(self, least: int = 0) -> Span:
        left = self.span_atom()
        while self.next.text in ("+", "-", "*", "/", "%", "^") and LEVELS[self.next.text] >= max(least, 1):
            op = self.take().text
            left = _span_op(op, left, self.span(LEVELS[op] if op == "^" else LEVELS[op] + 1))
        return left

    def span_atom(self) -> Span:
        token = self.next
        if self.maybe("-"):
            inner = self.span_atom()
            return DurationOp("neg", (inner,)) if isinstance(inner, DurationOp) else -inner
        if self.maybe("+"):
            return self.span_atom()
        if token.kind == "duration":
            return duration(self.take().text)
        if token.kind == "number":
            return number(self.take().text) * 1000
        if self.maybe("("):
            inner = self.span()
            self.need(")")
            return inner
        if word := self.maybe("step", "range"):
            self.need("(")
            self.need(")")
            return DurationOp(word.text.lower())
        if word := self.maybe("min_of", "max_of", "min", "max"):
            self.need("(")
            a = self.span()
            self.need(",")
            b = self.span()
            self.need(")")
            return DurationOp(word.text.lower()[:3], (a, b))
        raise self.unexpected("expected a duration")


def _span_op(op: str, a: Span, b: Span) -> Span:
    return DurationOp(op, (a, b))


def fold_span(span: Span, step: int, whole: int) -> int:
    """Milliseconds of a duration expression."""

    def seconds(x: Span) -> float:
        if not isinstance(x, DurationOp):
            return x / 1000
        a = [seconds(y) for y in x.args]
        match x.op:
            case "neg":
                return -a[0]
            case "step":
                return step / 1000
            case "range":
                return whole / 1000
            case "min":
                return min(a)
            case "max":
                return max(a)
            case "+":
                return a[0] + a[1]
            case "-":
                return a[0] - a[1]
            case "*":
                return a[0] * a[1]
            case "/" | "%":
                if a[1] == 0:
                    raise ParseError("division by zero" if x.op == "/" else "modulo by zero")
                return a[0] / a[1] if x.op == "/" else math.fmod(a[0], a[1])
            case _:
                return a[0] ** a[1]

    out = seconds(span)
    if not math.isfinite(out) or abs(out) > 9.22e9:
        raise ParseError("duration out of range")
    return int(out * 1000 + (1e-6 if out > 0 else -1e-6))


# Types


def kind(node: Node) -> str:
    match node:
        case Number():
            return SCALAR
        case Text():
            return STRING
        case Range() | Subquery():
            return MATRIX
        case Unary(expr=e) | Paren(expr=e):
            return kind(e)
        case Binary(left=a, right=b):
            return SCALAR if kind(a) == kind(b) == SCALAR else VECTOR
        case Call(name=name):
            return FUNCTIONS[name].result
    return VECTOR


def _expect(node: Node, wanted: str, where: str) -> None:
    if kind(node) != wanted:
        raise ParseError(f"expected type {wanted} in {where}, got {kind(node)}")


def check(node: Node) -> Node:
    """Raises ``ParseError`` if the types don't fit; returns the node."""
    match node:
        case Paren(expr=e):
            check(e)
        case Unary(expr=e):
            check(e)
            if kind(e) not in (SCALAR, VECTOR):
                raise ParseError(f'unary expression only allowed on expressions of type "scalar" or "instant vector", got {kind(e)!r}')
        case Selector():
            _check_selector(node)
        case Range(selector=s):
            _check_selector(s)
        case Subquery(expr=e):
            check(e)
            if kind(e) != VECTOR:
                raise ParseError(f"subquery is only allowed on instant vector, got {kind(e)} instead")
        case Call(name=name, args=args):
            _check_call(name, args)
        case Aggregate():
            check(node.expr)
            _expect(node.expr, VECTOR, "aggregation expression")
            if node.param is not None:
                check(node.param)
                _expect(node.param, PARAMETERS[node.op], "aggregation parameter")
        case Binary():
            _check_binary(node)
    return node


def _check_selector(s: Selector) -> None:
    if all(fits_empty(m) for m in s.matchers):
        raise ParseError("vector selector must contain at least one non-empty matcher")


def fits_empty(m: Matcher) -> bool:
    if m.op in ("=~", "!~"):
        return (re.fullmatch(m.value, "") is not None) == (m.op == "=~")
    return (m.value == "") == (m.op == "=")


def _check_call(name: str, args: tuple[Node, ...]) -> None:
    s = FUNCTIONS[name]
    most = len(s.args) if s.optional >= 0 else math.inf
    least = len(s.args) - (s.optional if s.optional >= 0 else 1)
    if len(args) < least:
        raise ParseError(f"expected {'at least ' * bool(s.optional)}{least} argument(s) in call to {name!r}, got {len(args)}")
    if len(args) > most:
        raise ParseError(f"expected {'at most ' * bool(s.optional)}{most} argument(s) in call to {name!r}, got {len(args)}")
    for i, arg in enumerate(args):
        if not (name == "info" and i == 1):  # its labels are a filter of another selector's
            check(arg)
        _expect(arg, s.args[min(i, len(s.args) - 1)], f"call to function {name!r}")
    if name == "info" and len(args) == 2 and not isinstance(bare(args[1]), Selector):
        raise ParseError("expected label selectors only")
    for i, arg in enumerate(args):
        inner = bare(arg)
        mode = inner.selector.mode if isinstance(inner, Range) else ""
        if mode == "anchored" and name not in ("resets", "changes", "rate", "increase", "delta"):
            raise ParseError(f"anchored modifier can only be used with: changes, delta, increase, rate, resets - not with {name}")
        if mode == "smoothed" and name not in ("rate", "increase", "delta"):
            raise ParseError(f"smoothed modifier can only be used with: delta, increase, rate - not with {name}")


def _check_binary(node: Binary) -> None:
    check(node.left)
    check(node.right)
    left, right = kind(node.left), kind(node.right)
    for side in (left, right):
        if side not in (SCALAR, VECTOR):
            raise ParseError("binary expression must contain only scalar and instant vector types")
    if node.bool and node.op not in COMPARISONS:
        raise ParseError("bool modifier can only be used on comparison operators")
    if node.op in COMPARISONS and left == right == SCALAR and not node.bool:
        raise ParseError("comparisons between scalars must use BOOL modifier")
    if node.op in SETS:
        if SCALAR in (left, right):
            raise ParseError(f"set operator {node.op!r} not allowed in binary scalar expression")
        if node.matching and node.matching.card != "one-to-one":
            raise ParseError(f"no grouping allowed for {node.op!r} operation")
        if node.matching and (node.matching.fill_left is not None or node.matching.fill_right is not None):
            raise ParseError(f"filling in missing series not allowed for {node.op!r} operation")
    if node.matching:
        if SCALAR in (left, right):
            raise ParseError("vector matching only allowed between instant vectors")
        if node.matching.on:
            for name in node.matching.include:
                if name in node.matching.labels:
                    raise ParseError(f"label {name!r} must not occur in ON and GROUP clause at once")


def parse(text: str) -> Node:
    return check(Parser(text).whole())
