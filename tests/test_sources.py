import pytest
from pyspark.sql import functions as F

from tidegrid.lang.nodes import Matcher
from tidegrid.lang.series import load
from tidegrid.plans.engine import Engine
from tidegrid.sources import tables
from tidegrid.streaming import ingest

#: A stream's first watermark is 1970, so that samples have to come later.
HOUR = 3_600_000
TEXT = 'm{a="1"} 0+1x9\nm{a="2"} 0+2x9\nn{b="3"} 5'


def test_labels(spark):
    source = load(spark, TEXT, 1000)
    assert [r[0] for r in source.label_names().collect()] == ["__name__", "a", "b"]
    assert [r[0] for r in source.label_names((Matcher("a", "=~", ".+"),), 1).collect()] == ["__name__"]
    assert [r[0] for r in source.label_values("a").collect()] == ["1", "2"]


def test_deletion(spark):
    source = load(spark, TEXT, 1000)
    stones = source.delete((Matcher("a", "=", "1"),), 2000, 4000).unionByName(source.delete((Matcher("a", "=", "1"),), 4001, 5000)).unionByName(source.delete((Matcher("b", "=", "3"),), 0, 0))
    assert sorted((r["mint"], r["maxt"]) for r in tables.merged_intervals(stones).collect()) == [(0, 0), (2000, 5000)]
    left = source.without(stones)
    assert left.samples.count() == 21 - 4 - 1 and left.between(0, 3000).samples.count() == 2 + 4


def test_repeated_and_contradicting_samples(spark):
    rows = spark.createDataFrame([(1, 10, 1.0, False), (1, 10, 1.0, False), (1, 20, 2.0, False)], "series_id long, ts_ms long, f double, is_stale boolean")
    assert tables.checked(rows).count() == 2
    with pytest.raises(Exception, match="duplicate sample"):
        tables.checked(rows.union(spark.createDataFrame([(1, 20, 3.0, False)], rows.schema))).collect()


def test_streamed_samples_are_queried_as_stored_ones(spark, tmp_path):
    rows = load(spark, TEXT, 1000)
    flat = rows.samples.join(rows.series, "series_id").select("labels", F.timestamp_millis(F.col("ts_ms") + HOUR).alias("ts"), "f", "is_stale")
    for k in range(2):
        flat.where(F.col("f") % 2 == k).write.mode("append").parquet(str(tmp_path / "in"))
    flat.limit(3).write.mode("append").parquet(str(tmp_path / "in"))  # some come again
    stream = spark.readStream.schema(flat.schema).parquet(str(tmp_path / "in"))
    ingest.append(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    source = ingest.read(spark, str(tmp_path / "out"))
    assert source.samples.count() == 21
    assert {r["f"] for r in Engine(spark, source).instant("sum by (a) (m)", HOUR + 9000).collect()} == {9.0, 18.0}


def test_windows_of_a_stream(spark, tmp_path):
    rows = load(spark, TEXT, 60_000)
    flat = rows.samples.join(rows.series, "series_id").select("labels", F.timestamp_millis("ts_ms").alias("ts"), "f")
    flat.write.parquet(str(tmp_path / "in"))
    out = ingest.rolled_up(spark.readStream.schema(flat.schema).parquet(str(tmp_path / "in")), "5 minutes", late="0 seconds")
    query = out.writeStream.format("memory").queryName("rolled").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM rolled").first()[0] == 11


def test_zero_samples_at_new_starts(spark):
    rows = spark.createDataFrame([(1, 10, 5), (1, 20, 5), (1, 30, 25), (1, 40, 0)], "series_id long, ts_ms long, st_ms long")
    assert sorted(r["ts_ms"] for r in ingest.zero_samples(rows).collect()) == [5, 25]
