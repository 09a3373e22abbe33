import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidegrid.llm import fingerprints


def shared(a, b):
    x, y = (Counter(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in (a, b))
    most = sum(max(x[w], y[w]) for w in x.keys() | y.keys())
    return sum(min(x[w], y[w]) for w in x.keys() | y.keys()) / most if most else 1.0


def test_edited_texts_and_likeness(messy):
    rows = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in messy.collect()))
    out = fingerprints.compare_edited(messy).collect()
    assert len(out) == len(rows)
    unique = [(i, k) for k, (none, i, _) in enumerate(rows) if not none and sum(x[1] == i for x in rows) == 1 and sum(x[1] == rows[(k + 1) % len(rows)][1] for x in rows) == 1]
    by = {r["doc_id"]: r for r in out}
    for i, k in unique:
        text, after = rows[k][2], rows[(k + 1) % len(rows)][2]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert by[i]["n_chars"] == len(text) and by[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(by[i]["near_edited"] - shared(text, edited)) < 0.4
    prints = {}
    for r, text in ((by[i], rows[k][2]) for i, k in unique):
        prints.setdefault(text, set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in prints.values())


def test_agreement_estimates_the_generalised_jaccard_similarity(spark):
    # Each pair has words of its own, so that pairs don't share their random numbers.
    rng = np.random.default_rng(1)
    texts = [" ".join(f"p{pair}w{x}" for x in rng.zipf(1.5, 80) % 50) for pair in range(200) for _ in range(2)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(rows).collect()}
    same = lambda a, b: np.mean([a[6 * j : 6 * j + 6] == b[6 * j : 6 * j + 6] for j in range(fingerprints.SAMPLES)])
    errors = [same(made[i], made[i + 1]) - shared(texts[i], texts[i + 1]) for i in range(0, 400, 2)]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.12


def test_both_ways_give_one_fingerprint(messy):
    alone = {(r["doc_id"], r["fingerprint"]) for r in fingerprints.fingerprint(messy).collect()}
    assert alone == {(r["doc_id"], r["fingerprint"]) for r in fingerprints.compare_edited(messy.withColumn("row", F.lit(1)).withColumn("range", F.lit(1))).collect()}


def test_one_row_and_none(spark, nothing):
    one = fingerprints.compare_edited(spark.createDataFrame([(5, "only one text here")], "doc_id long, text string")).collect()
    assert one[0]["near_next"] == 1.0
    assert fingerprints.compare_edited(nothing).count() == 0
