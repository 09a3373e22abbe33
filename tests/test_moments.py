"""Several samples of one series at one moment: they stand in the order of their values, however they are stored."""

import pytest
from pyspark.sql import functions as F

from tidegrid.plans.engine import Engine
from tidegrid.sources import tables

TEXT = "labels array<struct<key:string,value:string>>, ts_ms long, f double"


@pytest.fixture(scope="module")
def engine(spark):
    name = [("__name__", "n_total")]
    found = [(name, 0, 2.0), (name, 0, 1.0), (name, 10_000, 5.0), (name, 10_000, 3.0), (name, 10_000, 4.0), (name, 20_000, 7.0), (name, 20_000, 6.0)]
    return Engine(spark, tables.from_rows(spark.createDataFrame(found, TEXT).coalesce(1)))


@pytest.mark.parametrize(("query", "wanted"), [
    ("resets(n_total[21s])", 0), ("changes(n_total[21s])", 6), ("increase(n_total[20s])", 4.5), ("rate(n_total[20s])", 0.225), ("first_over_time(n_total[21s])", 1),
    ("last_over_time(n_total[21s])", 7), ("idelta(n_total[21s])", 1), ("irate(n_total[21s])", float("inf")), ("increase(n_total[20s] anchored)", 5), ("n_total", 7),
])
def test_samples_of_one_moment(engine, query, wanted):
    (row,) = engine.instant(query, 20_000).collect()
    assert row["f"] == pytest.approx(wanted, rel=1e-6)


def test_counters_over_repeated_events_rise(spark, tmp_path):
    """rate_counter over rows that share their moments: the increase over all windows is that of the count."""
    import __spark_entry__ as entry

    rows = spark.range(400).select(F.col("id").alias("event_id"), F.timestamp_millis(F.lit(1_704_067_200_000) + F.floor(F.col("id") / 40) * 3_600_000).alias("ts"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit(1).cast("long").alias("user_id"))
    rows.orderBy(F.desc("event_id")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = {r["ts"]: r["f"] for r in entry.queries()["rate_counter"](spark, str(tmp_path)).collect()}
    # At 06:00 the window holds the counts 41 to 280 of 5 hours, without an hour's carrying on to its left edge.
    assert 239 / 21_600 <= found[1_704_088_800_000] <= 239 / 18_000
