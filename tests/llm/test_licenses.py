import re

from tidegrid.llm import licenses

TEXTS = [
    (1, "Released under the MIT License. Licensed under CC BY-NC 4.0; all rights, reserved: All Rights Reserved."),
    (2, "cc by cc by CC-BY gnu General\nPublic  License, version 3 or not, GPL"),
    (3, "SPDX-License-Identifier: Apache-2.0 and Licensed under the Apache License, Version 2.0"),
    (4, None), (5, ""), (6, "nothing to see, acc by itself, all rights éreserved"), (None, "public domain"), (6, "All rights reserved"), (6, "All rights reserved"),
    (8, "cc by " * 3000 + "the end"),
]


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in licenses.BASE:
        want = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(want)] == want]
        starts += found
        labels |= {label} if found else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_against_brute_force(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("t", docs_extra()).withColumn("label", docs_extra())
    out = licenses.scan(docs)[1].collect()
    assert sorted(map(str, [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out])) == sorted(map(str, [(i, *base(t)) for i, t in TEXTS]))
    for r in out:
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_surer_detections_cover_others(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    found = {(r["id"], r["label"], r["priority"]) for r in licenses.scan(docs)[0].collect()}
    assert (1, "cc-by-nc-4.0", 2) in found and (1, "mit", 2) in found
    assert not any(i == 1 and label in ("cc-by-nc", "mit") and p == 3 for i, label, p in found)
    assert (3, "apache-2.0", 1) in found and (3, "apache-2.0", 2) in found and (2, "gpl-3.0", 3) in found


def test_rules():
    rules = licenses.rules()
    assert len(rules) >= 300
    for r in rules:
        re.compile(r.pattern)
        assert 1 <= r.priority <= len(licenses.CONFIDENCE)


def test_empty(nothing):
    findings, summary = licenses.scan(nothing)
    assert findings.count() == 0 and summary.count() == 0
