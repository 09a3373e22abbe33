import zlib

import numpy as np
import pytest

from tidegrid.llm import quality


def corpus(n):
    rng = np.random.default_rng(0)
    good, out = [f"{a}{b}" for a in "lo ma ter in sol".split() for b in "ren dan vis".split()], []
    for i in range(n):
        words = [str(w) for w in rng.choice(good, 40)]
        out.append((" ".join(words), 1) if i % 3 else (" ".join(w + "$$$" for w in words), 0) if i % 2 else (" ".join([words[0]] * 40), 0))
    return out


def trained(rows, shape=quality.Shape()):
    words = quality.Lexicon(shape)
    return quality.train(((*quality.features(text, words), label) for text, label in rows), shape)


def by_hand(text, shape):
    """All buckets of a text, by the rule."""
    words = text.split()
    h = np.array([zlib.crc32(w.encode()) for w in words], dtype=np.uint64)
    return [quality.END, *[g for w in words for g in quality.subwords(w, shape)], *quality.pairs(h[:-1], h[1:], shape).tolist() * shape.pair]


@pytest.fixture(scope="module")
def model():
    return trained(corpus(400), quality.Shape(epochs=4))


def test_held_out_accuracy(model):
    rows = corpus(600)[400:]
    scores = model.scores([t for t, _ in rows], quality.Lexicon(model.shape, model.value))
    assert np.mean((scores >= 0.5) == np.array([y for _, y in rows])) > 0.97


def test_a_score_is_the_softmax_of_averaged_vectors(model):
    for text in ("loren loren madan", "日本 a\u00e9 x", "one"):
        raw = np.mean(model.value[by_hand(text, model.shape)], dtype=np.float64) + model.bias
        assert model.scores([text], quality.Lexicon(model.shape, model.value))[0] == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-6)


def test_features_are_counts_of_the_buckets():
    shape = quality.Shape()
    for text in ("loren loren madan", "", " ".join(f"w{k % 700}é" for k in range(3000)), "y" * 200 + " z"):
        ids, count = quality.features(text, quality.Lexicon(shape))
        assert np.repeat(ids, count).tolist() == sorted(by_hand(text, shape))


def test_training_against_plain_steps():
    rng, shape = np.random.default_rng(1), quality.Shape(buckets=50, dim=3, epochs=3)
    rows = [(np.sort(rng.choice(50, 6, replace=False)), rng.integers(1, 4, 6), k % 2) for k in range(20)]
    made = quality.train(rows, shape)
    rng = np.random.default_rng(shape.seed)
    vectors, output, bias, step = rng.uniform(-1 / 3, 1 / 3, (50, 3)), np.zeros((3, 2)), np.zeros(2), 0
    for _ in range(3):
        for i in rng.permutation(20):
            ids, count, label = rows[i]
            rate = shape.rate * (1 - step / 60)
            step += 1
            share = count / count.sum()
            hidden = sum(s * vectors[k] for s, k in zip(share, ids))
            p = np.exp(hidden @ output + bias)
            p = p / p.sum() - np.eye(2)[label]
            back = output @ p
            for c in range(2):
                output[:, c] -= rate * p[c] * hidden
            bias -= 0.1 * rate * p
            for s, k in zip(share, ids):
                vectors[k] -= rate * 6**0.5 * s * back
    assert made.value == pytest.approx(vectors @ (output[:, 1] - output[:, 0]), abs=1e-4) and made.bias == pytest.approx(bias[1] - bias[0], abs=1e-4)


def test_the_order_of_words_counts():
    rows = [(" ".join(["ab cd"] * 20 + ["ef gh"] * 20) if k % 2 else " ".join(["ab gh"] * 20 + ["ef cd"] * 20), k % 2) for k in range(300)]
    model = trained(rows)
    scores = model.scores([t for t, _ in rows], quality.Lexicon(model.shape, model.value))
    assert np.mean((scores >= 0.5) == np.array([y for _, y in rows])) == 1.0


def test_long_texts_without_spaces_count_whole(model):
    good = "".join(t.replace(" ", "") for t, y in corpus(60) if y)
    lexicon = quality.Lexicon(model.shape, model.value)
    best, spoilt, late = model.scores([good, good[:80] + "$$$" * 2000, "$$$" * 40 + good], lexicon)
    assert best > 0.9 and best - spoilt > 0.3 and late > spoilt
    assert len(lexicon) < 1
    raw = np.mean(model.value[[*quality.subwords(good, model.shape), quality.END]], dtype=np.float64) + model.bias
    assert best == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-6)


def test_training_reads_long_words_whole():
    rows = [("x" * 70 + ("ab" if k % 2 else "cd") * (20 + k), k % 2) for k in range(200)]
    model = trained(rows)
    scores = model.scores([t for t, _ in rows], quality.Lexicon(model.shape, model.value))
    assert np.mean((scores >= 0.5) == np.array([y for _, y in rows])) > 0.97


@pytest.mark.parametrize("word", ["x", "日本語" * 90, "a\u00e9\U0001f600\ud800z" * 40, "plain" * 100])
def test_streamed_subwords_are_the_subwords(word):
    for most in (1, 7, 64, 1 << 18):
        found = np.concatenate(list(quality.streamed_subwords(word, quality.Shape(), most)))
        assert sorted(found.tolist()) == sorted(quality.subwords(word, quality.Shape()))


def test_every_row_is_scored(messy, model):
    out = quality.with_score(messy, model)
    assert out.columns == [*messy.columns, "score"] and out.count() == messy.count()
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    with pytest.raises(ValueError):
        quality.with_score(out, model)


def test_training_leaves_held_out_rows_out(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (3, None)], "doc_id long, quality int")
    used = {r["doc_id"] for r in quality.labelled_sample(docs, labels, most=100).collect()}
    assert used == {i for i in range(50) if zlib.crc32(str(i).encode()) % 5}


def test_one_text_and_one_label_of_an_id(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (2, "c")] * 3, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0)], "doc_id long, quality int")
    runs = [sorted((r["doc_id"], str(r["text"]), r["__label"]) for r in quality.labelled_sample(d, labels, most=100).collect()) for d in (docs, docs.repartition(2))]
    assert runs[0] == runs[1] and [(i, y) for i, _, y in runs[0]] == [(1, 1), (2, 0)]


def test_empty(nothing, model, spark):
    assert quality.with_score(nothing, model).count() == 0
    none = quality.fit(nothing, spark.createDataFrame([], "doc_id long, quality int"))
    assert none.scores(["x"], quality.Lexicon(none.shape, none.value))[0] == pytest.approx(0.5, abs=0.2)
