"""Registered queries against SQL on another engine; the driver holds all of them at a larger scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

PATH = "/root/testdata/sf0.001"
SOME = "flagship instant_selector selector_offset selector_at subquery rate increase irate deriv predict_linear quantile_over_time ts_of_max_over_time changes absent_over_time topk quantile count_values one_to_one set_or fill group_left label_replace histogram_quantile lineitem_by_flag delete_range days_in_month".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="the tables are not here")


@pytest.fixture(scope="module")
def other():
    connection = duckdb.connect()
    for name in ("events", "lineitem", "orders"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{PATH}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", SOME)
def test_query(spark, other, name):
    mine = entry.queries()[name](spark, PATH)
    rows = other.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rows.description]
    assert sorted(mine.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[n] for n in sorted(names)) for r in mine.collect()))) == sorted(map(str, (tuple(dict(zip(names, r))[n] for n in sorted(names)) for r in rows.fetchall())))


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
