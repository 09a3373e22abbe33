import numpy as np
from pyspark.sql import functions as F

from tidegrid.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, cls long, q long, score double"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], 0, 1, 2, 3.0) for i, v in vectors], SCHEMA)


def brute(vectors, k=20):
    good = {i: np.array(v, np.float32).astype(float) for i, v in vectors if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in (i for i in good if i % 20 == 0):
        out[q] = sorted(((-float(np.cumsum(good[q] * good[c])[-1]), c) for c in good if c != q))[:k]
    return out


def test_recall_and_order(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16))
    vectors = [(i, list(v / np.linalg.norm(v) * (1 + i % 3))) for i, v in enumerate(x)]
    out = neighbours.search(frame(spark, vectors), F.col("vec_id") % 20 == 0).collect()
    wanted, got = brute(vectors), {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert got.keys() == wanted.keys()
    assert all(x == sorted(x) and len(x) == 20 for x in got.values())
    assert np.mean([len(set(got[q]) & set(wanted[q])) / 20 for q in wanted]) >= 0.9


def test_copies_and_unusable_vectors(spark):
    vectors = [(i, [1.0, 2.0]) for i in range(50)] + [(60, [2.0, 1.0]), (61, None), (62, [0.0, 0.0]), (63, [None, 1.0]), (64, [float("nan"), 1.0]), (65, [float("inf"), 1.0]), (66, [1.0, 2.0, 3.0]), (67, []), (80, [-1.0, 0.5])]
    usable = [(i, v) for i, v in vectors if v is not None and len(v) == 2]
    out = neighbours.search(frame(spark, vectors), F.col("vec_id") % 20 == 0).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert got == brute(usable)


def test_few_rows_and_none(spark):
    vectors = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [-1.0, 0.0])]
    out = neighbours.search(frame(spark, vectors), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in out) == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert neighbours.search(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_ties_and_doubles(spark):
    rng = np.random.default_rng(8)
    x = [[float(v) for v in rng.integers(0, 2, 6)] for _ in range(600)]
    x = [v if any(v) else [1.0, 0.0, 0.0, 0.0, 0.0, 0.0] for v in x]
    x = [[*v, k / 1e12 + 0.5] for k, v in enumerate(x)]  # different vectors, most ties broken far behind float's digits
    x[:300] = [[*v[:6], 0.0] for v in x[:300]]
    ids = list(range(600))
    docs = spark.createDataFrame(list(zip(ids, x)), "vec_id long, embedding array<double>").repartition(5)
    out = neighbours.search(docs, F.col("vec_id") == 7, how=neighbours.Hashing(probes=9, tables=12, width=50.0, block=64))
    score = lambda k: float(np.cumsum(np.array(x[7]) * np.array(x[k]))[-1])
    wanted = sorted((-score(k), k) for k in ids if k != 7)[:20]
    assert [(r["rank"], r["vec_id"], r["score"]) for r in out.orderBy("rank").collect()] == [(n, k, -v) for n, (v, k) in enumerate(wanted, 1)]
    large = spark.createDataFrame([(0, [1e200, 1.0]), (1, [1e-50, 0.0]), (2, [0.1, 0.2]), (3, [0.3, 0.7])], "vec_id long, embedding array<double>")
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in neighbours.search(large, F.lit(True)).collect()}
    assert len(found) == 12 and found[2, 3] == 0.1 * 0.3 + 0.2 * 0.7
