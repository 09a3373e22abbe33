import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegrid.lang import nodes as N
from tidegrid.lang.parser import ParseError, duration, parse
from tidegrid.lang.printer import show
from tidegrid.lang.series import values

GOOD = """
1 + 2 * 3 ^ 2 ^ 2
-1 ^ 2
foo{a="b", c!="d", e=~"f.*", g!~"h"}
{"foo.bar", a="b"}
foo[5m] offset 1h
rate(foo[5m:1m] @ 100.5 offset -5m)
sum by (a, b) (rate(foo[5m]))
sum without (a) (foo)
sum(foo) by (a)
topk(5, foo)
count_values("v", foo)
foo * on (a) group_left (b) bar
foo / ignoring (a) group_right () bar
foo + on (a) fill (0) bar
foo - fill_left (1) fill_right (2) bar
foo and bar or baz unless on (x) qux
foo > bool 5
1 == bool 1
label_replace(foo, "a", "$1", "b", "(.*)")
histogram_quantile(0.9, sum by (le) (rate(foo_bucket[1h])))
max_over_time((1 - foo)[1h:])
absent(foo{a="b"}) or vector(1)
foo @ start() + foo @ end()
rate(foo[5m + step()])
increase(foo[1m] anchored)
foo smoothed
0x1f + 1e3 + .5 + 1_000 + Inf + NaN
5m + 1h30m
foo atan2 bar
clamp(foo, -1, +1)
by + sum
predict_linear(foo[1h], 3600)
""".strip().splitlines()

BAD = {
    "": "no expression", "foo[5m": "expected", "sum(foo": "expected", "1 == 1": "BOOL", "foo and 1": "not allowed", "foo + bool bar": "bool modifier", '{a=""}': "non-empty", "{}": "non-empty",
    "rate(foo)": "expected type range vector", "foo[5m] offset 1h[5m]": "ranges only", "foo offset 1m offset 2m": "multiple times", "foo @ 1 @ 2": "multiple times", "nope(foo)": "unknown function",
    "sum(1)": "expected type", "topk(foo, 5)": "expected type", "foo * on (a) group_left (a) bar": "ON and GROUP", "foo and on (a) group_left () bar": "no grouping", "1 + on (a) foo": "vector matching only",
    "sum(foo,)": "trailing commas", '"a" + 1': "binary expression", "-foo[5m]": "unary", "foo[5m:1m][5m]": "ranges only", "quantile_over_time(foo[5m])": "argument", "rate(foo[5m], 1)": "at most|argument",
    "avg_over_time(foo[1m] anchored)": "anchored", 'foo{a="b"': "expected", "foo 5": "expected an operator", "foo offset": "expected a duration", 'foo{__name__="x"}': "twice", "(foo": "left paren",
}


@pytest.mark.parametrize("text", GOOD)
def test_printed_text_parses_to_the_same(text):
    tree = parse(text)
    assert parse(show(tree)) == tree or "NaN" in text and show(parse(show(tree))) == show(tree)


@pytest.mark.parametrize("text", BAD)
def test_errors(text):
    with pytest.raises(ParseError) as found:
        parse(text)
    assert any(part in str(found.value) for part in BAD[text].split("|"))


def test_shapes():
    assert parse("-1 ^ 2") == N.Unary("-", N.Binary("^", N.Number(1.0), N.Number(2.0)))
    assert parse("2 ^ 3 ^ 2").right == N.Binary("^", N.Number(3.0), N.Number(2.0))
    assert parse("a - b - c").left == parse("a - b")
    assert parse("a or b and c").op == "or" and parse("a + b > c * d").op == ">"
    assert parse("5m") == N.Number(300.0) and math.isinf(parse("-Inf").value)
    assert parse("foo[1h:5m]").step == 300_000 and parse("foo[1h:]").step == 0


def test_durations():
    assert duration("1h30m") == 5_400_000 and duration("1y2w") == 365 * 86_400_000 + 14 * 86_400_000 and duration("5ms") == 5
    for bad in ("5m1h", "1h1h", "h", "5", ""):
        with pytest.raises(ParseError):
            duration(bad)


def test_series_notation():
    assert values("1 _ 2x2 0+10x3 stale _x2 5-1x1 -Inf") == [1.0, None, 2.0, 2.0, 2.0, 0.0, 10.0, 20.0, 30.0, "stale", None, None, 5.0, 4.0, -math.inf]
    with pytest.raises(ParseError):
        values("1 two")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc(){}[]+-*/^<>=!~\"'`,:@ 0123456789msxy_.", max_size=25))
def test_any_text_parses_or_says_why(text):
    try:
        parse(text)
    except ParseError:
        pass


@pytest.mark.parametrize("text", [r'"\x."', r'"\u."', r'"\U1"', r'"\ud800"', r"'\400'", r'"\UFFFFFFFF"', r'"\8"'])
def test_escapes_that_are_no_characters(text):
    with pytest.raises(ParseError):
        parse(text)


def test_escapes_that_are_characters():
    assert parse(r'"\x41\u00e9\101\n"').value == "A\u00e9A\n"
