import re

import pytest

from tidegrid.llm import mixing


def by_hand(rows):
    """Shares by weight, the excess over three times a source's size dealt again until none is above."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), set(order)
    while free:
        whole = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / whole > 3 * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / whole for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        free -= full
    return sizes, target


def test_targets_and_copies(messy):
    docs = messy.collect()
    sizes, target = by_hand(docs)
    out = mixing.plan_mix(messy).collect()
    assert len(out) == len(docs)
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert int(rate) <= r["copies"] <= int(rate) + 1 and r["copies"] <= 3
        assert r["taken"] == r["copies"] * r["size"]


def test_taken_words_come_near_their_target(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 9 AS int)) AS text", "concat('s', id % 4) AS source")
    out = mixing.plan_mix(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for r in out:
        assert r["sum(taken)"] == pytest.approx(r["max(target)"], rel=0.06)


def test_emitted_rows_follow_the_plan_and_reruns_agree(messy):
    plan = mixing.plan_mix(messy)
    mixed = mixing.mix(messy)
    assert mixed.columns == messy.columns
    assert mixed.count() == plan.agg({"copies": "sum"}).first()[0]
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(messy.repartition(5)).collect()))


def test_empty(nothing):
    assert mixing.plan_mix(nothing).count() == 0 and mixing.mix(nothing).count() == 0
