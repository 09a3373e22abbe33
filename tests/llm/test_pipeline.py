import corpus_pipeline
from tidegrid.llm import registry


def test_stages(spark, tmp_path):
    rows = []
    for i in range(60):
        good = " ".join(f"wort{(i * 31 + k * 7) % 997} satz{(i * 17 + k) % 89}" for k in range(30))
        rows.append((i, good if i % 4 else " ".join(f"{w}$$$" for w in good.split()), "de", f"s{i % 3}", 9))
    rows += [(100 + i, rows[1][1], "de", "s1", 9) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near copies", "mix", "pack"]
    for _, stage in corpus_pipeline.STAGES[:2]:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        assert docs.columns == before.columns
    kept = sorted(r["doc_id"] for r in docs.collect())
    assert kept == [i for i in range(60) if i % 4]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_every_operator_is_registered():
    assert [sum(n.startswith(f"op{k}_") for n in registry.QUERIES) for k in range(1, 11)] == [1] * 10 and "pipeline" in registry.QUERIES
