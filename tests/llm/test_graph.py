import numpy as np

from tidegrid.llm import graph


def edges(spark):
    rng = np.random.default_rng(5)
    chain = [(k, k + 1) for k in range(1000, 1100)]
    star = [(5000, k) for k in range(-40, 40)]
    loose = [tuple(map(int, x)) for x in rng.integers(10_000, 10_400, (300, 2))]
    return spark.createDataFrame([*chain, *star, *loose, (7777, 7777)], "a long, b long")


def test_few_edges_take_few_jobs(spark):
    found = edges(spark)
    spark.sparkContext.setJobGroup("few edges", "")
    graph.components(found)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few edges")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 6


def test_one_task_and_rounds_agree(spark, monkeypatch):
    one = sorted(map(tuple, graph.components(edges(spark)).collect()))
    monkeypatch.setattr(graph, "TOGETHER", 0)
    assert one == sorted(map(tuple, graph.components(edges(spark)).collect()))
    least = dict(one)
    assert {least[k] for k in range(1000, 1101)} == {1000} and least[5000] == -40 and least[7777] == 7777
    assert graph.together(spark.createDataFrame([], "a long, b long")).count() == 0
