"""Small series whose results are known, one group for each part of the language."""

import math

import pytest
from pyspark.sql import functions as F

from tidegrid.api import series
from tidegrid.lang.series import load
from tidegrid.plans.engine import Engine, QueryError

MINUTE = 60_000


@pytest.fixture(scope="module")
def engine(spark):
    cache = {}

    def of(text, gap, **options):
        key = (text, gap, tuple(options.items()))
        if key not in cache:
            source = load(spark, text, gap)
            cache[key] = Engine(spark, type(source)(source.series.cache(), source.samples.cache()), **options)
        return cache[key]

    return of


def labels(row):
    return ",".join(f"{x['key']}={x['value']}" for x in row["labels"])


def at(engine, query, ms):
    return {labels(r): r["f"] for r in engine.instant(query, ms).collect()}


def close(got, wanted):
    assert got.keys() == wanted.keys()
    for k, v in wanted.items():
        assert got[k] == pytest.approx(v, rel=1e-6, nan_ok=True), k


STALE = "metric 0 1 stale 2"


@pytest.mark.parametrize(("query", "second", "wanted"), [
    ("metric", 10, {"__name__=metric": 1}), ("metric", 20, {}), ("metric", 30, {"__name__=metric": 2}), ("metric", 329, {"__name__=metric": 2}), ("metric", 330, {}),
    ("count_over_time(metric[1m])", 30, {"": 3}), ("count_over_time(metric[10s])", 20, {}), ("count_over_time(metric[20s])", 20, {"": 1}),
])
def test_staleness_and_lookback(engine, query, second, wanted):
    close(at(engine(STALE, 10_000), query, second * 1000), wanted)


TWO = 'metric{job="1"} 0+1x1000\nmetric{job="2"} 0+2x1000'


@pytest.mark.parametrize(("query", "wanted"), [
    ("metric @ 100", (10, 20)), ("metric @ 1m40s", (10, 20)), ("metric @ 100 offset 50s", (5, 10)), ("metric offset 50s @ 100", (5, 10)), ("metric @ 0 offset -50s", (5, 10)),
    ("sum_over_time(metric[100s] @ 100)", (55, 110)), ("metric @ end()", (1, 2)), ("max_over_time(metric[50s:10s] @ 100)", (10, 20)),
])
def test_fixed_moments(engine, query, wanted):
    assert sorted(at(engine(TWO, 10_000), query, 10_000).values()) == list(wanted)


@pytest.mark.parametrize(("query", "second", "wanted"), [
    ("sum_over_time(metric_total[50s:10s])", 10, 3), ("sum_over_time(metric_total[50s:5s])", 10, 4), ("sum_over_time(metric_total[50s:10s])", 300, 10), ("sum_over_time(metric_total[60s:10s])", 359, 2),
    ("rate(metric_total[20s:10s])", 10, 0.1), ("rate(metric_total[20s:5s])", 20, 0.06666666666666667),
])
def test_subqueries(engine, query, second, wanted):
    close(at(engine("metric_total 1 2", 10_000), query, second * 1000), {"": wanted})


STEPS = "metric 1+1x4 9+1x4"


@pytest.mark.parametrize(("mode", "wanted"), [
    ("", {20: 1.833333333, 35: 2.833333333, 50: 4, 65: 4, 80: 8, 125: 4}),
    (" anchored", {5: 0, 20: 1, 35: 2, 50: 3, 65: 4, 80: 7, 95: 7, 125: 7}),
    (" smoothed", {5: 0.333333333, 20: 1.333333333, 35: 2.333333333, 50: 3.333333333, 65: 5, 80: 7, 125: 6}),
])
def test_increase_and_its_edges(engine, mode, wanted):
    rows = engine(STEPS, 15_000).range(f"increase(metric[1m]{mode})", 5_000, 125_000, 15_000).collect()
    got = {r["ts"] // 1000: r["f"] for r in rows}
    for second, value in wanted.items():
        assert got[second] == pytest.approx(value, rel=1e-6), second
    assert (5 in got) == (mode != "")


RESET = 'reset 0+10x4 0+10x5\nramp{i="1"} 0+80x10'


@pytest.mark.parametrize(("query", "minute", "wanted"), [
    ("deriv(reset[100m])", 50, {"": 0.010606060606060607}), ("predict_linear(reset[50m], 3600)", 50, {"": 70}), ("predict_linear(reset[55m] @ 3000, 3600)", 50, {"": 76.81818181818181}),
    ("predict_linear(reset[55m] @ 3000, 3600)", 10, {"": 51.36363636363637}), ("rate(ramp[50m])", 50, {"i=1": 0.26666666666666666}), ("resets(reset[100m])", 50, {"": 1}), ("changes(reset[100m])", 50, {"": 10}),
    ("irate(reset[50m])", 25, {"": 0}), ("idelta(reset[50m])", 25, {"": -40}), ("delta(ramp[20m])", 50, {"i=1": 320}),
])
def test_trends(engine, query, minute, wanted):
    close(at(engine(RESET, 5 * MINUTE), query, minute * MINUTE), wanted)


VECTORS = 'left{label="a"} 10\nleft{label="b"} 20\nleft{label="c"} 30\nright{label="a"} 100\nright{label="b"} 200\nright{label="d"} 400'


@pytest.mark.parametrize(("query", "wanted"), [
    ("left + fill(0) right", {"a": 110, "b": 220, "c": 30, "d": 400}), ("left + fill_left(0) right", {"a": 110, "b": 220, "d": 400}), ("left + fill_right(0) right", {"a": 110, "b": 220, "c": 30}),
    ("left + fill_left(5) fill_right(7) right", {"a": 110, "b": 220, "c": 37, "d": 405}), ("left * right", {"a": 1000, "b": 4000}), ("left unless right", {"c": 30}), ("left and right", {"a": 10, "b": 20}),
    ("left < bool on (label) right", {"a": 1, "b": 1}), ("left > 15", {"b": 20, "c": 30}), ("15 < left", {"b": 20, "c": 30}), ("left / 0 > 0", {"a": math.inf, "b": math.inf, "c": math.inf}), ("left % 0 != 1", {"a": math.nan, "b": math.nan, "c": math.nan}),
])
def test_operators_between_vectors(engine, query, wanted):
    got = {k.split("label=")[1]: v for k, v in at(engine(VECTORS, 5 * MINUTE), query, 0).items()}
    close(got, wanted)


def test_or_keeps_names(engine):
    close(at(engine(VECTORS, 5 * MINUTE), "left or right", 0), {"__name__=left,label=a": 10, "__name__=left,label=b": 20, "__name__=left,label=c": 30, "__name__=right,label=d": 400})


GRID = "\n".join(f'requests{{job="{j}", instance="{i}", group="{g}"}} 0+{10 * (k + 1)}x10' for k, (j, g, i) in enumerate((j, g, i) for j in ("api", "app") for g in ("production", "canary") for i in "01"))


@pytest.mark.parametrize(("query", "wanted"), [
    ("sum(requests)", {"": 3600}), ("sum by (group) (requests{job='api'})", {"group=canary": 700, "group=production": 300}), ("sum without (instance) (requests{job='api'})", {"group=canary,job=api": 700, "group=production,job=api": 300}),
    ("avg by (job) (requests)", {"job=api": 250, "job=app": 650}), ("count(requests)", {"": 8}), ("stddev(requests{job='api'})", {"": 111.80339887498948}), ("stdvar(requests{job='api'})", {"": 12500}), ("group by (job) (requests)", {"job=api": 1, "job=app": 1}),
    ("quantile(0.5, requests)", {"": 450}), ("quantile(2, requests)", {"": math.inf}), ("count_values('v', requests > 600)", {"v=700": 1, "v=800": 1}), ("sum by (job) (requests) / on (job) count by (job) (requests)", {"job=api": 250, "job=app": 650}),
    ("topk(2, requests)", {"__name__=requests,group=canary,instance=0,job=app": 700, "__name__=requests,group=canary,instance=1,job=app": 800}), ("bottomk by (job) (1, requests)", {"__name__=requests,group=production,instance=0,job=api": 100, "__name__=requests,group=production,instance=0,job=app": 500}),
    ("count(limitk(3, requests))", {"": 3}), ("count(limit_ratio(0.4, requests) or limit_ratio(-0.6, requests))", {"": 8}), ("count(limit_ratio(0.4, requests) and limit_ratio(-0.6, requests))", {}), ("topk(0, requests)", {}),
    ("max(requests) - min(requests)", {"": 700}), ("scalar(sum(requests)) + 1", {"": 3601}), ("scalar(requests)", {"": math.nan}), ("absent(requests)", {}), ("absent(nothing{a='b', c=~'d', e='f'})", {"a=b,e=f": 1}),
    ("label_join(sum by (job, group) (requests), 'x', '-', 'job', 'group') > 1000", {"group=canary,job=app,x=app-canary": 1500, "group=production,job=app,x=app-production": 1100}), ("label_replace(sum by (job) (requests), 'x', 'v$1', 'job', 'a(.*)')", {"job=api,x=vpi": 1000, "job=app,x=vpp": 2600}),
    ("label_replace(sum by (job) (requests), 'x', 'v$1', 'job', 'p')", {"job=api": 1000, "job=app": 2600}), ("vector(time())", {"": 3000}), ("round(vector(2.5)) + clamp(vector(9), 1, 3)", {"": 6}), ("clamp(vector(1), 5, 2)", {}), ("sgn(vector(-3))", {"": -1}), ("ln(vector(0))", {"": -math.inf}),
    ("sqrt(vector(-1))", {"": math.nan}), ("day_of_week(vector(1136239445))", {"": 1}), ("days_in_month(vector(1454284800))", {"": 29}), ("hour(vector(1136239445))", {"": 22}), ("2 ^ 3 ^ 2 + vector(0)", {"": 512}), ("max_of(1, 2) + vector(0)", {"": 2}), ("-sum(requests)", {"": -3600}),
])
def test_aggregations_and_functions(engine, query, wanted):
    close(at(engine(GRID, 5 * MINUTE), query, 50 * MINUTE), wanted)


def test_group_left_takes_labels_along(engine):
    text = 'many{job="a", x="1"} 2\nmany{job="a", x="2"} 4\none{job="a", zone="z"} 10'
    close(at(engine(text, MINUTE), "many * on (job) group_left (zone) one", 0), {"job=a,x=1,zone=z": 20, "job=a,x=2,zone=z": 40})
    close(at(engine(text, MINUTE), "one - on (job) group_right () many", 0), {"job=a,x=1": 8, "job=a,x=2": 6})
    for query in ("many * on (job) one", "one * on (job) many", "many * on (job) group_left () many"):
        with pytest.raises(Exception, match="match"):
            at(engine(text, MINUTE), query, 0)


def test_names_dropped_to_the_same_labels_fail(engine):
    with pytest.raises(Exception, match="same labelset"):
        at(engine("a 1\nb 2", MINUTE), "-{__name__=~'a|b'}", 0)


def test_info(engine):
    text = 'metric{instance="a", job="1", label="v"} 0\nother{instance="a", job="2"} 0\ntarget_info{instance="a", job="1", data="info", more="m"} 1'
    e = engine(text, 5 * MINUTE)
    close(at(e, "info(metric)", 0), {"__name__=metric,data=info,instance=a,job=1,label=v,more=m": 0})
    close(at(e, 'info(metric, {data=~".+"})', 0), {"__name__=metric,data=info,instance=a,job=1,label=v": 0})
    close(at(e, 'info(other, {data=~".*"})', 0), {"__name__=other,instance=a,job=2": 0})
    close(at(e, 'info(other, {data=~".+"})', 0), {})


def test_classic_histograms(engine):
    text = 'h_bucket{le="0.1"} 1\nh_bucket{le="0.2"} 3\nh_bucket{le="1e0"} 4\nh_bucket{le="+Inf"} 5\nbad_bucket{le="x"} 3'
    e = engine(text, MINUTE)
    close(at(e, "histogram_quantile(0.2, h_bucket)", 0), {"": 0.1})
    close(at(e, "histogram_quantile(0.5, h_bucket)", 0), {"": 0.175})
    close(at(e, "histogram_quantile(0.95, h_bucket)", 0), {"": 1})
    close(at(e, "histogram_quantile(-1, h_bucket)", 0), {"": -math.inf})
    close(at(e, "histogram_fraction(0, 0.2, h_bucket)", 0), {"": 0.6})
    close(at(e, 'histogram_quantiles(h_bucket, "q", 0.2, 0.5)', 0), {"q=0.2": 0.1, "q=0.5": 0.175})
    close(at(e, "histogram_quantile(0.5, bad_bucket)", 0), {})


def test_smoothing_and_deviation(engine):
    e = engine("trend 1 3 4 8\nv 4 6 2 1 999 1 2", 10_000)
    s, b = 1.0, 2.0
    for i, x in enumerate((3, 4, 8)):
        new = 0.5 * x + 0.5 * (s + b)
        b, s = 0.1 * (new - s) + 0.9 * b, new
    close(at(e, "double_exponential_smoothing(trend[1m], 0.5, 0.1)", 40_000), {"": s})
    close(at(e, "mad_over_time(v[70s])", 70_000), {"": 1})
    close(at(e, "quantile_over_time(0.5, v[70s])", 70_000), {"": 2})
    with pytest.raises(QueryError):
        at(e, "double_exponential_smoothing(trend[1m], 0.5, 1.5)", 40_000)


def test_ranges_and_sorting(engine):
    e = engine("a 0+1x10\nb 5 NaN 1 7", 10_000)
    rows = e.range("a", 0, 100_000, 30_000).collect()
    assert sorted((r["ts"], r["f"]) for r in rows) == [(0, 0.0), (30_000, 3.0), (60_000, 6.0), (90_000, 9.0)]
    assert sorted((r["ts"], r["f"]) for r in e.instant("b[30s]", 30_000).where(~F.isnan("f")).collect()) == [(20_000, 1.0), (30_000, 7.0)]
    assert [r["f"] for r in e.instant('sort_desc({__name__=~"a|b"})', 30_000).collect()] == [7.0, 3.0]
    with pytest.raises(QueryError):
        e.range("a[1m]", 0, 1, 1)


def test_the_fluent_way_is_the_language(engine):
    e = engine(GRID, 5 * MINUTE)
    expr = series("requests", job="api").rate("10m").sum(by=["group"]) * 2 > 0
    wanted = at(e, 'sum by (group) (rate(requests{job="api"}[10m])) * 2 > 0', 50 * MINUTE)
    assert {labels(r): r["f"] for r in e.instant(expr.node, 50 * MINUTE).collect()} == wanted and len(wanted) == 2
    assert len(e.instant(series("requests").topk(3).node, 50 * MINUTE).collect()) == 3


def test_plans_push_time_down_and_shuffle_little(spark, tmp_path, engine):
    from tidegrid.sources import tables

    source = load(spark, GRID, 5 * MINUTE)
    tables.write(source, str(tmp_path))
    stored = tables.read(spark, str(tmp_path))
    assert stored.samples.count() == source.samples.count()
    plan = Engine(spark, stored).range("sum by (job) (rate(requests[10m]))", 0, 10 * MINUTE, MINUTE)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts_ms" in plan and "PartitionFilters: [isnotnull(day" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
