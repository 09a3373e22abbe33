"""The registered queries over the star schema, with SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import labels as L
from .lang.nodes import Matcher
from .plans.engine import Engine
from .sources import tables, testdata

DAY, HOUR, MINUTE = 86_400_000, 3_600_000, 60_000
#: The steps: the 30 days of all events, from 2024-01-01 00:00 UTC on.
START, STEP, STEPS = 1_704_067_200_000, 6 * HOUR, 121
END = START + (STEPS - 1) * STEP

Query = Callable[[SparkSession, str], DataFrame]
#: Added before rounding, here and in SQL.
SHIFT = 1.23e-7
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def flat(rows: DataFrame, names: tuple[str, ...], digits: int = 6) -> DataFrame:
    """Named labels as columns, values rounded, for comparison with other engines."""
    value = lambda n: F.when(L.value(F.col("labels"), n) != "", L.value(F.col("labels"), n))
    # Shifted, since values of few digits often lie halfway; adding zero makes a negative zero positive.
    return rows.select(*[value(n).alias(n.strip("_")) for n in names], "ts", (F.round(F.col("f") + SHIFT, digits) + 0.0).alias("f"))


SOURCES: dict[str, Callable[[SparkSession, str], tables.Source]] = {
    "events": testdata.events_value,
    "users": lambda spark, path: testdata.events_value(spark, path, ("event_type", "user_id")),
    "total": testdata.events_total,
    "both": lambda spark, path: testdata.events_value(spark, path) | testdata.events_total(spark, path),
    "buckets": testdata.events_buckets,
    "quantity": testdata.lineitem_quantity,
    "price": testdata.orders_total_price,
}

#: The same series for the other engine, and the names of their labels.
_EVENTS = "SELECT event_type, epoch_us(ts) // 1000 AS t, value AS v FROM events"
_USERS = "SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 AS t, value AS v FROM events"
_TOTAL = "SELECT event_type, epoch_us(ts) // 1000 AS t, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS DOUBLE) AS v FROM events"
_BUCKETS = """SELECT e.event_type, b.le, epoch_us(e.ts) // 1000 AS t,
 CAST(sum(CASE WHEN b.le = '+Inf' OR e.value <= b.x THEN 1 ELSE 0 END) OVER (PARTITION BY e.event_type, b.le ORDER BY e.ts, e.event_id) AS DOUBLE) AS v
 FROM events e, (VALUES ('1', 1.0), ('5', 5.0), ('10', 10.0), ('50', 50.0), ('100', 100.0), ('+Inf', 1e308)) b(le, x)"""
_QUANTITY = "SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, epoch_us(CAST(l_shipdate AS TIMESTAMP)) // 1000 AS t, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY ALL"
_SERIES = {"events": (_EVENTS, ("event_type",)), "users": (_USERS, ("event_type", "user_id")), "total": (_TOTAL, ("event_type",)), "buckets": (_BUCKETS, ("event_type", "le")), "quantity": (_QUANTITY, ("returnflag", "linestatus"))}
_GRID = f"SELECT {START} + k * {STEP} AS ts FROM range(0, {STEPS}) r(k)"


def instants(source: str, lookback: int, offset: int = 0, grid: str = _GRID) -> str:
    """Common tables with ``i``: labels, ts, f, t of the newest sample at each step."""
    sql, names = _SERIES[source]
    keys = ", ".join(names)
    return f"""WITH s AS ({sql}), g AS ({grid}),
 i AS (SELECT {keys}, g.ts, arg_max(s.v, s.t) AS f, max(s.t) AS t FROM s JOIN g ON s.t > g.ts - {offset + lookback} AND s.t <= g.ts - {offset} GROUP BY {keys}, g.ts)"""


def in_windows(source: str, span: int, offset: int = 0) -> str:
    """Common tables with ``w``: labels, ts, t, v and the window's sample before each, pt and pv."""
    sql, names = _SERIES[source]
    keys = ", ".join(names)
    over = f"OVER (PARTITION BY {keys}, g.ts ORDER BY s.t)"
    return f"""WITH s AS ({sql}), g AS ({_GRID}),
 w AS (SELECT {keys}, g.ts, s.t, s.v, lag(s.v) {over} AS pv, lag(s.t) {over} AS pt FROM s JOIN g ON s.t > g.ts - {offset + span} AND s.t <= g.ts - {offset})"""


def register(name: str, query: str, names: tuple[str, ...], sql: str | None, *, source: str = "events", lookback: int = HOUR, start: int = START, end: int = END, step: int = STEP) -> None:
    def run(spark: SparkSession, path: str) -> DataFrame:
        engine = Engine(spark, SOURCES[source](spark, path), lookback=lookback)
        return flat(engine.range(query, start, end, step), names)

    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


def _rounded(x: str) -> str:
    return f"round({x} + {SHIFT}, 6) + 0.0"


E1 = ("event_type",)

# Windows: one aggregation each
for _name, _sql in {
    "count_over_time": "CAST(count(*) AS DOUBLE)", "present_over_time": "CAST(1 AS DOUBLE)", "sum_over_time": "sum(v)", "avg_over_time": "avg(v)", "min_over_time": "min(v)", "max_over_time": "max(v)",
    "stddev_over_time": "stddev_pop(v)", "stdvar_over_time": "var_pop(v)", "first_over_time": "arg_min(v, t)", "last_over_time": "arg_max(v, t)", "ts_of_first_over_time": "min(t) / 1000.0", "ts_of_last_over_time": "max(t) / 1000.0",
    "ts_of_max_over_time": "arg_max(t, {'v': v, 't': t}) / 1000.0", "ts_of_min_over_time": "arg_max(t, {'v': -v, 't': t}) / 1000.0",
    "changes": "CAST(count(CASE WHEN v <> pv THEN 1 END) AS DOUBLE)", "resets": "CAST(count(CASE WHEN v < pv THEN 1 END) AS DOUBLE)",
}.items():
    register(_name, f"{_name}(events_value[1d])", E1, f"{in_windows('events', DAY)} SELECT event_type, ts, {_rounded(_sql)} AS f FROM w GROUP BY event_type, ts")

register("quantile_over_time", "quantile_over_time(0.3, events_value[1d])", E1, f"{in_windows('events', DAY)} SELECT event_type, ts, {_rounded('quantile_cont(v, 0.3)')} AS f FROM w GROUP BY event_type, ts")
register("mad_over_time", "mad_over_time(events_value[1d])", E1, f"{in_windows('events', DAY)}, m AS (SELECT *, median(v) OVER (PARTITION BY event_type, ts) AS m FROM w) SELECT event_type, ts, {_rounded('median(abs(v - m))')} AS f FROM m GROUP BY event_type, ts")


def rate_sql(source: str, names: tuple[str, ...], name: str, span: int, offset: int = 0) -> str:
    """The extrapolated difference, of counters with drops added back."""
    counter, keys = name != "delta", ", ".join(names)
    lost = "coalesce(sum(CASE WHEN v < pv THEN pv END), 0)" if counter else "0"
    cap = "CASE WHEN res > 0 AND f0 >= 0 THEN least(x0, sa * (f0 / res)) ELSE x0 END" if counter else "x0"
    per = span / 1000.0 if name == "rate" else 1.0
    return f"""{in_windows(source, span, offset)},
 a AS (SELECT {keys}, ts, count(*) AS n, min(t) AS t0, max(t) AS t1, arg_min(v, t) AS f0, arg_max(v, t) - arg_min(v, t) + {lost} AS res FROM w GROUP BY {keys}, ts HAVING count(*) >= 2),
 b AS (SELECT *, (t1 - t0) / 1000.0 AS sa, (t1 - t0) / 1000.0 / (n - 1) AS av, (t0 - (ts - {span + offset})) / 1000.0 AS d0, (ts - {offset} - t1) / 1000.0 AS d1 FROM a),
 c AS (SELECT *, CASE WHEN d0 >= av * 1.1 THEN av / 2 ELSE d0 END AS x0, CASE WHEN d1 >= av * 1.1 THEN av / 2 ELSE d1 END AS x1 FROM b)
SELECT {keys}, ts, {_rounded(f'res * (sa + {cap} + x1) / sa / {per}')} AS f FROM c"""


for _name in ("rate", "increase", "delta"):
    register(_name, f"{_name}(events_value[6h])", E1, rate_sql("events", E1, _name, 6 * HOUR))
register("rate_counter", "rate(events_total[6h])", E1, rate_sql("total", E1, "rate", 6 * HOUR), source="total")
register("range_offset", "increase(events_value[6h] offset 3h)", E1, rate_sql("events", E1, "increase", 6 * HOUR, 3 * HOUR))
_last2 = "arg_max({'v': v, 'pv': pv, 't': t, 'pt': pt}, t)"
register("irate", "irate(events_value[1d])", E1, f"{in_windows('events', DAY)}, l AS (SELECT event_type, ts, {_last2} AS l FROM w GROUP BY event_type, ts HAVING count(*) >= 2) SELECT event_type, ts, {_rounded('CASE WHEN l.v < l.pv THEN l.v ELSE l.v - l.pv END / ((l.t - l.pt) / 1000.0)')} AS f FROM l")
register("idelta", "idelta(events_value[1d])", E1, f"{in_windows('events', DAY)}, l AS (SELECT event_type, ts, {_last2} AS l FROM w GROUP BY event_type, ts HAVING count(*) >= 2) SELECT event_type, ts, {_rounded('l.v - l.pv')} AS f FROM l")
register("deriv", "deriv(events_value[1d])", E1, f"{in_windows('events', DAY)} SELECT event_type, ts, {_rounded('regr_slope(v, (t - ts) / 1000.0)')} AS f FROM w GROUP BY event_type, ts HAVING count(*) >= 2")
register("predict_linear", "predict_linear(events_value[1d], 3600)", E1, f"{in_windows('events', DAY)} SELECT event_type, ts, {_rounded('regr_intercept(v, (t - ts) / 1000.0) + 3600 * regr_slope(v, (t - ts) / 1000.0)')} AS f FROM w GROUP BY event_type, ts HAVING count(*) >= 2")
register("double_exponential_smoothing", "double_exponential_smoothing(events_value[1d], 0.5, 0.3)", E1, None)
register("absent_over_time", 'absent_over_time(events_value{event_type="click"}[10m])', E1, f"{in_windows('events', 10 * MINUTE)} SELECT 'click' AS event_type, ts, CAST(1 AS DOUBLE) AS f FROM g WHERE ts NOT IN (SELECT ts FROM w WHERE event_type = 'click')")
register("anchored_increase", "increase(events_value[6h] anchored)", E1, None)
register("smoothed_rate", "rate(events_value[6h] smoothed)", E1, None)
register("smoothed_instant", "events_value smoothed", E1, None)

# Selectors
_I = instants("events", HOUR)
_f = f"event_type, ts, {_rounded('f')} AS f"
register("instant_selector", "events_value", ("__name__", *E1), f"{_I} SELECT 'events_value' AS name, {_f} FROM i")
register("selector_offset", "events_value offset 90m", E1, f"{instants('events', HOUR, 90 * MINUTE)} SELECT {_f} FROM i")
register("selector_negative_offset", "events_value offset -2h", E1, f"{instants('events', HOUR, -2 * HOUR)} SELECT {_f} FROM i")
register("selector_at", "events_value @ 1704370800", E1, f"{instants('events', HOUR, 0, 'SELECT 1704370800000 AS ts')}, h AS ({_GRID}) SELECT event_type, h.ts, {_rounded('f')} AS f FROM i CROSS JOIN h")
register("selector_at_end", "events_value @ end()", E1, f"{instants('events', HOUR, 0, f'SELECT {END} AS ts')}, h AS ({_GRID}) SELECT event_type, h.ts, {_rounded('f')} AS f FROM i CROSS JOIN h")
register("matcher_equal", 'events_value{event_type="click"}', E1, f"{_I} SELECT {_f} FROM i WHERE event_type = 'click'")
register("matcher_not_equal", 'events_value{event_type!="click"}', E1, f"{_I} SELECT {_f} FROM i WHERE event_type <> 'click'")
register("matcher_regex", 'events_value{event_type=~"c.*|view"}', E1, f"{_I} SELECT {_f} FROM i WHERE regexp_full_match(event_type, 'c.*|view')")
register("matcher_not_regex", 'events_value{event_type!~"c.*|view"}', E1, f"{_I} SELECT {_f} FROM i WHERE NOT regexp_full_match(event_type, 'c.*|view')")
_inner = f"SELECT k * {6 * HOUR} AS ts FROM range(({START} - {DAY}) // {6 * HOUR} + 1, {END} // {6 * HOUR} + 1) r(k)"
register("subquery", "max_over_time(events_value[1d:6h])", E1, f"{instants('events', HOUR, 0, _inner)}, h AS ({_GRID}) SELECT event_type, h.ts, {_rounded('max(f)')} AS f FROM i JOIN h ON i.ts > h.ts - {DAY} AND i.ts <= h.ts GROUP BY event_type, h.ts")
register("timestamp", "timestamp(events_value)", E1, f"{_I} SELECT event_type, ts, {_rounded('t / 1000.0')} AS f FROM i")

# Single values
for _name, _arg, _sql in (
    ("abs", "events_value - 50", "abs(f - 50)"), ("ceil", "events_value", "ceil(f)"), ("floor", "events_value", "floor(f)"), ("exp", "events_value / 100", "exp(f / 100)"), ("sqrt", "events_value", "sqrt(f)"),
    ("ln", "events_value", "ln(f)"), ("log2", "events_value", "log2(f)"), ("log10", "events_value", "log10(f)"), ("sin", "events_value", "sin(f)"), ("cos", "events_value", "cos(f)"), ("tan", "events_value / 1000", "tan(f / 1000)"),
    ("asin", "events_value / 1000", "asin(f / 1000)"), ("acos", "events_value / 1000", "acos(f / 1000)"), ("atan", "events_value", "atan(f)"), ("sinh", "events_value / 100", "sinh(f / 100)"), ("cosh", "events_value / 100", "cosh(f / 100)"),
    ("tanh", "events_value / 100", "tanh(f / 100)"), ("asinh", "events_value", "asinh(f)"), ("acosh", "events_value + 1", "acosh(f + 1)"), ("atanh", "events_value / 1000", "atanh(f / 1000)"), ("rad", "events_value", "radians(f)"),
    ("deg", "events_value", "degrees(f)"), ("sgn", "events_value - 50", "CAST(sign(f - 50) AS DOUBLE)"),
):
    _where = {"asin": "abs(f) <= 1000", "acos": "abs(f) <= 1000", "atanh": "abs(f) < 1000", "ln": "f > 0", "log2": "f > 0", "log10": "f > 0"}.get(_name, "true")
    _keep = {"asin": " <= 1000", "acos": " <= 1000", "atanh": " < 1000", "ln": " > 0", "log2": " > 0", "log10": " > 0"}.get(_name, "")
    register(_name, f"{_name}({_arg.replace('events_value', f'(events_value{_keep})') if _keep else _arg})", E1, f"{_I} SELECT event_type, ts, {_rounded(_sql)} AS f FROM i WHERE {_where}")
register("round", "round(events_value, 5)", E1, f"{_I} SELECT event_type, ts, {_rounded('floor(f * (1.0 / 5) + 0.5) / (1.0 / 5)')} AS f FROM i")
register("clamp", "clamp(events_value, 10, 50)", E1, f"{_I} SELECT event_type, ts, {_rounded('greatest(10, least(50, f))')} AS f FROM i")
register("clamp_min", "clamp_min(events_value, 10)", E1, f"{_I} SELECT event_type, ts, {_rounded('greatest(10, f)')} AS f FROM i")
register("clamp_max", "clamp_max(events_value, 50)", E1, f"{_I} SELECT event_type, ts, {_rounded('least(50, f)')} AS f FROM i")
for _name, _sql in {"year": "year(d)", "month": "month(d)", "day_of_month": "day(d)", "day_of_week": "dayofweek(d)", "day_of_year": "dayofyear(d)", "days_in_month": "day(last_day(d))", "hour": "hour(d)", "minute": "minute(d)"}.items():
    register(_name, f"{_name}(timestamp(events_value))", E1, f"{_I}, d AS (SELECT *, make_timestamp((t // 1000) * 1000000) AS d FROM i) SELECT event_type, ts, CAST({_sql} AS DOUBLE) AS f FROM d")
register("time", "time()", (), f"WITH g AS ({_GRID}) SELECT ts, {_rounded('ts / 1000.0')} AS f FROM g")
register("vector", "vector(1) * pi()", (), f"WITH g AS ({_GRID}) SELECT ts, {_rounded('pi()')} AS f FROM g")
register("scalar", 'vector(scalar(events_value{event_type="click"})) > 0', (), f"{_I} SELECT ts, {_rounded('f')} AS f FROM i WHERE event_type = 'click' AND f > 0")
register("absent", 'absent(events_value{event_type="click"})', E1, f"{_I} SELECT 'click' AS event_type, ts, CAST(1 AS DOUBLE) AS f FROM g WHERE ts NOT IN (SELECT ts FROM i WHERE event_type = 'click')")
register("unary_minus", "-events_value", E1, f"{_I} SELECT event_type, ts, {_rounded('-f')} AS f FROM i")

# Aggregations, over the series of each user
_U = instants("users", DAY)
for _name, _sql in {"sum": "sum(f)", "avg": "avg(f)", "min": "min(f)", "max": "max(f)", "count": "CAST(count(*) AS DOUBLE)", "group": "CAST(1 AS DOUBLE)", "stddev": "stddev_pop(f)", "stdvar": "var_pop(f)"}.items():
    register(f"{_name}_by", f"{_name} by (event_type) (events_value)", E1, f"{_U} SELECT event_type, ts, {_rounded(_sql)} AS f FROM i GROUP BY event_type, ts", source="users", lookback=DAY)
register("sum_without", "sum without (user_id) (events_value)", E1, f"{_U} SELECT event_type, ts, {_rounded('sum(f)')} AS f FROM i GROUP BY event_type, ts", source="users", lookback=DAY)
register("sum_all", "sum(events_value)", (), f"{_U} SELECT ts, {_rounded('sum(f)')} AS f FROM i GROUP BY ts", source="users", lookback=DAY)
register("quantile", "quantile by (event_type) (0.9, events_value)", E1, f"{_U} SELECT event_type, ts, {_rounded('quantile_cont(f, 0.9)')} AS f FROM i GROUP BY event_type, ts", source="users", lookback=DAY)
E2 = ("event_type", "user_id")
for _name, _order in {"topk": "f DESC, user_id", "bottomk": "f, user_id", "limitk": "user_id"}.items():
    register(_name, f"{_name} by (event_type) (3, events_value)", E2, f"{_U}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type, ts ORDER BY {_order}) AS r FROM i) SELECT event_type, user_id, ts, {_rounded('f')} AS f FROM r WHERE r <= 3", source="users", lookback=DAY)
register("limit_ratio", "limit_ratio(0.3, events_value)", E2, None, source="users", lookback=DAY)
register("count_values", 'count_values by (event_type) ("value", floor(events_value / 50))', ("event_type", "value"), f"{_U} SELECT event_type, CAST(CAST(floor(f / 50) AS BIGINT) AS VARCHAR) AS value, ts, CAST(count(*) AS DOUBLE) AS f FROM i GROUP BY ALL", source="users", lookback=DAY)
register("rate_then_sum", "sum by (event_type) (rate(events_value[1d]))", E1, f"SELECT event_type, ts, {_rounded('sum(f)')} AS f FROM ({rate_sql('users', E2, 'rate', DAY).replace('round(', '(').replace(f' + {SHIFT}, 6) + 0.0', ')')}) GROUP BY event_type, ts", source="users", lookback=DAY)

# Operators
for _name, _op, _sql in (("add", "+", "f + 2"), ("subtract", "-", "f - 2"), ("multiply", "*", "f * 2"), ("divide", "/", "f / 2"), ("modulo", "%", "f % 2"), ("power", "^", "pow(f, 2)"), ("atan2", "atan2", "atan2(f, 2)")):
    if _name == "atan2":
        continue  # between vectors only, below
    register(f"scalar_{_name}", f"events_value {_op} 2", E1, f"{_I} SELECT event_type, ts, {_rounded(_sql)} AS f FROM i")
for _name, _op, _sql in (("equal", "==", "="), ("not_equal", "!=", "<>"), ("less", "<", "<"), ("less_equal", "<=", "<="), ("greater", ">", ">"), ("greater_equal", ">=", ">=")):
    register(f"filter_{_name}", f"floor(events_value) {_op} 20", E1, f"{_I} SELECT event_type, ts, {_rounded('floor(f)')} AS f FROM i WHERE floor(f) {_sql} 20")
register("compare_bool", "events_value > bool 20", E1, f"{_I} SELECT event_type, ts, CASE WHEN f > 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f FROM i")
_B = f"""{_I}, t AS ({_TOTAL}), j AS (SELECT event_type, g.ts, arg_max(t.v, t.t) AS f FROM t JOIN g ON t.t > g.ts - {HOUR} AND t.t <= g.ts GROUP BY event_type, g.ts)"""
register("one_to_one", "events_value / on (event_type) events_total", E1, f"{_B} SELECT i.event_type, i.ts, {_rounded('i.f / j.f')} AS f FROM i JOIN j USING (event_type, ts)", source="both")
register("vector_atan2", "events_value atan2 ignoring () events_total", E1, f"{_B} SELECT i.event_type, i.ts, {_rounded('atan2(i.f, j.f)')} AS f FROM i JOIN j USING (event_type, ts)", source="both")
register("set_and", "events_value and on (event_type) (events_total > 100)", E1, f"{_B} SELECT {_f} FROM i SEMI JOIN (SELECT * FROM j WHERE f > 100) k USING (event_type, ts)", source="both")
register("set_unless", "events_value unless on (event_type) (events_total > 100)", E1, f"{_B} SELECT {_f} FROM i ANTI JOIN (SELECT * FROM j WHERE f > 100) k USING (event_type, ts)", source="both")
register("set_or", "(events_value > 60) or on (event_type) events_total", ("__name__", *E1), f"{_B}, a AS (SELECT * FROM i WHERE f > 60) SELECT 'events_value' AS name, {_f} FROM a UNION ALL SELECT 'events_total' AS name, {_f} FROM j ANTI JOIN a USING (event_type, ts)", source="both")
register("fill", "(events_value > 60) + on (event_type) fill (0) (events_total > 100)", E1, f"{_B}, a AS (SELECT * FROM i WHERE f > 60), b AS (SELECT * FROM j WHERE f > 100) SELECT event_type, ts, {_rounded('coalesce(a.f, 0) + coalesce(b.f, 0)')} AS f FROM a FULL JOIN b USING (event_type, ts)", source="both")
register("group_left", "events_value / on (event_type) group_left () sum by (event_type) (events_value)", E2, f"{_U}, a AS (SELECT event_type, ts, sum(f) AS s FROM i GROUP BY event_type, ts) SELECT event_type, user_id, ts, {_rounded('f / s')} AS f FROM i JOIN a USING (event_type, ts)", source="users", lookback=DAY)
register("group_right", "sum by (event_type) (events_value) - on (event_type) group_right () events_value", E2, f"{_U}, a AS (SELECT event_type, ts, sum(f) AS s FROM i GROUP BY event_type, ts) SELECT event_type, user_id, ts, {_rounded('s - f')} AS f FROM i JOIN a USING (event_type, ts)", source="users", lookback=DAY)

# Labels
register("label_replace", 'label_replace(events_value, "short", "$1-x", "event_type", "(..).*")', ("event_type", "short"), f"{_I} SELECT event_type, substr(event_type, 1, 2) || '-x' AS short, ts, {_rounded('f')} AS f FROM i")
register("label_join", 'label_join(events_value, "both", "/", "event_type", "nothing", "event_type")', ("event_type", "both"), f"{_I} SELECT event_type, event_type || '//' || event_type AS both, ts, {_rounded('f')} AS f FROM i")

# Classic histograms
_HQ = f"""{instants('buckets', DAY)}, b AS (SELECT event_type, ts, CASE WHEN le = '+Inf' THEN 'Infinity'::DOUBLE ELSE CAST(le AS DOUBLE) END AS le, f AS n FROM i),
 p AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS below, max(n) OVER (PARTITION BY event_type, ts) AS total FROM b WINDOW w AS (PARTITION BY event_type, ts ORDER BY le))"""
register("histogram_quantile", "histogram_quantile(0.9, events_value_bucket)", E1, f"""{_HQ}, q AS (SELECT *, row_number() OVER (PARTITION BY event_type, ts ORDER BY le) AS r FROM p WHERE n >= 0.9 * total)
 SELECT event_type, ts, {_rounded("CASE WHEN le = 'Infinity'::DOUBLE THEN low ELSE low + (le - low) * (0.9 * total - below) / (n - below) END")} AS f FROM q WHERE r = 1""", source="buckets", lookback=DAY)
register("histogram_fraction", "histogram_fraction(0, 50, events_value_bucket)", E1, f"{_HQ} SELECT event_type, ts, {_rounded('max(CASE WHEN le = 50 THEN n END) / max(total)')} AS f FROM p GROUP BY event_type, ts", source="buckets", lookback=DAY)
register("histogram_quantiles", 'histogram_quantiles(events_value_bucket, "q", 0.5, 0.9)', ("event_type", "q"), None, source="buckets", lookback=DAY)

# Daily sums of another table
_LS = 788_918_400_000  # 1995-01-01; the last day is in 2001
register("lineitem_by_flag", "sum by (returnflag) (sum_over_time(lineitem_quantity[30d]))", ("returnflag",), f"""WITH s AS ({_QUANTITY}), g AS (SELECT {_LS} + k * {10 * DAY} AS ts FROM range(0, 252) r(k))
 SELECT returnflag, g.ts, {_rounded('sum(v)')} AS f FROM s JOIN g ON s.t > g.ts - {30 * DAY} AND s.t <= g.ts GROUP BY returnflag, g.ts""", source="quantity", start=_LS, end=_LS + 2510 * DAY, step=10 * DAY)


# What isn't an expression: series and samples themselves

def _source_query(name: str, sql: str | None):
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


@_source_query("series_scan", f"SELECT event_type, t, v FROM ({_EVENTS}) WHERE t BETWEEN {START} AND {END} AND event_type <> 'error'")
def series_scan(spark: SparkSession, path: str) -> DataFrame:
    source = testdata.events_value(spark, path)
    series, samples = source.select((Matcher("event_type", "!=", "error"),), START, END)
    return samples.join(series, samples["key"] == series["series_id"]).select(L.value(F.col("labels"), "event_type").alias("event_type"), "t", F.col("f").alias("v"))


@_source_query("label_values", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS value FROM events WHERE event_type = 'click'")
def label_values(spark: SparkSession, path: str) -> DataFrame:
    return SOURCES["users"](spark, path).label_values("user_id", (Matcher("event_type", "=", "click"),))


@_source_query("label_names", "SELECT unnest(['__name__', 'event_type', 'user_id']) AS name")
def label_names(spark: SparkSession, path: str) -> DataFrame:
    return SOURCES["users"](spark, path).label_names()


@_source_query("delete_range", f"SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM ({_EVENTS}) WHERE NOT (event_type = 'click' AND t BETWEEN {START} AND {START + 5 * DAY} OR event_type = 'view' AND t BETWEEN {START + DAY} AND {START + 2 * DAY}) GROUP BY event_type")
def delete_range(spark: SparkSession, path: str) -> DataFrame:
    source = testdata.events_value(spark, path)
    click, view = ((Matcher("event_type", "=", x),) for x in ("click", "view"))
    stones = source.delete(click, START, START + 3 * DAY).unionByName(source.delete(click, START + 2 * DAY, START + 5 * DAY)).unionByName(source.delete(view, START + DAY, START + 2 * DAY))
    left = source.without(stones)
    counted = left.samples.groupBy("series_id").agg(F.count("*").alias("n"))
    return counted.join(left.series, "series_id").select(L.value(F.col("labels"), "event_type").alias("event_type"), "n")


def flagship(spark: SparkSession, path: str) -> DataFrame:
    """sum by (event_type) (rate(events_value[6h])), hourly over all days."""
    engine = Engine(spark, testdata.events_value(spark, path), lookback=HOUR)
    return flat(engine.range("sum by (event_type) (rate(events_value[6h]))", START, END, HOUR), E1)


QUERIES["flagship"] = flagship
SQL["flagship"] = rate_sql("events", E1, "rate", 6 * HOUR).replace(_GRID, f"SELECT {START} + k * {HOUR} AS ts FROM range(0, {(END - START) // HOUR + 1}) r(k)")
