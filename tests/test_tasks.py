"""The memory of one task doesn't grow with the samples: they are dealt over more tasks."""

import os
import re

import pytest

import __spark_entry__ as entry
from tidegrid.sources import tables

PATH = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="the tables are not here")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def rows(frame):
    return sorted(map(str, frame.collect()))


@pytest.mark.parametrize("name", ["topk", "bottomk", "limitk"])
def test_ranked_series_are_dealt_by_size(spark, monkeypatch, name):
    run = entry.queries()[name]
    wanted = rows(run(spark, PATH))
    monkeypatch.setattr(tables, "TASK", 4 << 10)
    n = tables.tasks(spark.read.parquet(f"{PATH}/events.parquet"), 4)
    found = run(spark, PATH)
    assert n > 8 and any(4 < int(x) <= n for x in re.findall(r"Exchange hashpartitioning\((?:series_id|key)#\d+L, (\d+)\)", plan(found)))
    assert rows(found) == wanted and wanted


def test_no_samples_are_sorted_for_their_label_sets(spark):
    found = plan(entry.queries()["topk"](spark, PATH))
    assert "SortAggregate" not in found  # a first() of labels would sort each sample
    # Labels come before rows are dealt to their steps, whose order no join needs then.
    assert "Join" not in found[: found.index("Generate explode")]


def test_parts_keep_their_size(spark, monkeypatch, tmp_path):
    one = spark.range(40_000).selectExpr("id AS series_id", "id AS ts_ms", "double(id) AS f", "false AS is_stale")
    one.coalesce(1).write.parquet(f"{tmp_path}/1")
    for _ in range(8):
        one.coalesce(1).write.mode("append").parquet(f"{tmp_path}/8")
    monkeypatch.setattr(tables, "TASK", 16 << 10)
    small, large = (tables.tasks(spark.read.parquet(f"{tmp_path}/{k}"), 4) for k in (1, 8))
    assert 7 * small <= large <= 8 * small
    assert tables.tasks(spark.createDataFrame([(1, 1, 1.0, False)], "series_id long, ts_ms long, f double, is_stale boolean"), 4) is None


def test_windows_are_dealt_by_size(spark, monkeypatch):
    run = entry.queries()["rate_then_sum"]
    wanted = rows(run(spark, PATH))
    monkeypatch.setattr(tables, "TASK", 4 << 10)
    found = run(spark, PATH)
    assert any(int(x) > 8 for x in re.findall(r"Exchange hashpartitioning\((?:series_id|key)#\d+L, (\d+)\)", plan(found)))
    assert rows(found) == wanted and wanted
