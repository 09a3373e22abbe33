import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import scoring
from tidegrid.llm.trie import EliasFano, Trie, quantised, restored


def by_hand(rows, weight):
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    words = [[*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), ""] for _, t, _ in rows]
    one, two = Counter(), Counter()
    for w, (_, _, learn) in zip(words, rows):
        if learn:
            one.update(w)
            two.update(zip([" ", *w[:-1]], w))
    n, v = sum(one.values()), len(one)
    small = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))
    context = lambda c: one[""] if c == " " else one[c]
    for w, (i, _, _) in zip(words, rows):
        base = sum(math.log10(small(x)) for x in w)
        whole = sum(math.log10((two[c, x] + weight * small(x)) / (context(c) + weight)) for c, x in zip([" ", *w[:-1]], w))
        yield i, len(w), sum(one[x] > 0 for x in w), n, base, whole


def test_against_brute_force(messy):
    rows = [(r["doc_id"], r["text"], r["doc_id"] != 3) for r in messy.collect()]
    wanted = sorted(by_hand(rows, 50.0), key=lambda r: (str(r[0]), r[1], r[4]))
    out = sorted(scoring.score(messy, F.col("doc_id") != 3).collect(), key=lambda r: (str(r["doc_id"]), r["n_tokens"], r["base_score"]))
    assert len(out) == len(wanted)
    for r, (i, n, known, total, base, whole) in zip(out, wanted):
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert abs(r["score"] - whole) <= n * 3e-4


def test_counts_over_a_hundred_million(messy):
    rows = [(r["doc_id"], r["text"], r["doc_id"] != 3) for r in messy.collect()]
    wanted = sorted(by_hand(rows, 1e10), key=lambda r: (str(r[0]), r[1], r[4]))
    out = sorted(scoring.score(messy, F.col("doc_id") != 3, weight=1e10).collect(), key=lambda r: (str(r["doc_id"]), r["n_tokens"], r["base_score"]))
    for r, (_, n, _, _, _, whole) in zip(out, wanted, strict=True):
        assert abs(r["score"] - whole) <= n * 3e-4


def test_shares_come_back():
    x = np.log10(np.array([1.0, 0.3, 1e-8, 3e-9, 1e-15]))
    assert np.abs(restored(quantised(x)) - x).max() <= 1.01 / 8192


def test_nothing_to_learn_from(messy, nothing):
    out = scoring.score(messy, F.lit(False)).collect()
    assert len(out) == messy.count() and all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in out)
    assert scoring.score(nothing, F.lit(True)).count() == 0


def test_rising_sequences_come_back():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1), (1000, 50), (5000, 1 << 63), (300, 1 << 20)):
        x = np.sort(rng.integers(0, top, n).astype(np.uint64))
        assert EliasFano.of(x).values().tolist() == x.tolist()


def test_numbers_are_found_in_the_packed_bits():
    rng = np.random.default_rng(3)
    for n, top in ((1, 1), (1, 1 << 62), (700, 60), (5000, 1 << 63), (3000, 1 << 20), (4000, 4500)):
        x = np.unique(rng.integers(0, top, n).astype(np.uint64))
        for rising in (EliasFano.of(x), EliasFano.of(np.concatenate([x[: len(x) // 2], x[-1:] + np.uint64(1 << 40)]))):
            values = rising.values()
            asked = np.unique(np.concatenate([values, values + np.uint64(1), rng.integers(0, min(top + 9, (1 << 63) - 1), 500).astype(np.uint64)]))
            rng.shuffle(asked)
            places = {int(v): k for k, v in enumerate(values.tolist())}
            assert rising.find(asked).tolist() == [places.get(v, -1) for v in asked.tolist()]
            at = rng.integers(0, rising.n, 300)
            assert rising.get(at).tolist() == values[at].tolist()
            low = np.maximum(at - 2, 0)
            assert rising.find(values[at], low, at).tolist() == [-1] * 300 and rising.find(values[at], low, at + 1).tolist() == at.tolist()


def test_an_opened_trie_holds_views_of_the_map_only(tmp_path):
    word, context = np.arange(200, dtype=np.uint64) // np.uint64(3), np.arange(200, dtype=np.uint64) * np.uint64(7)
    built = Trie.build(word, context, np.ones(200, np.int64), lambda w, s: s, lambda c, of: np.log10(c / of), lambda c: np.log10(c / 200))
    path = tmp_path / "x.trie"
    path.write_bytes(built.tobytes())
    trie = Trie.open(str(path))
    for x in (trie.counts, trie.value, trie.as_context, *(y for r in (trie.words, trie.pointers, trie.level, trie.contexts) for y in (r.low, r.high))):
        assert not x.flags.owndata and not x.flags.writeable
    assert trie.pairs(trie.find(word), context).tolist() == list(range(200))
    assert trie.pairs(trie.find(word), context[::-1].copy()).tolist() == [k if k == 199 - k or word[k] == word[199 - k] and context[k] == context[199 - k] else -1 if word[k] != word[199 - k] else 199 - k for k in range(200)]


def test_answers_come_back():
    rng = np.random.default_rng(4)
    times = rng.integers(1, 9, 40)
    n = int(times.sum())
    counts, doc, value = rng.integers(0, 1 << 40, 40), rng.integers(0, 3000, n), rng.integers(0, 65_536, n)
    back = scoring._answered(scoring._answer(times, counts, doc, value))
    assert back[0].tolist() == np.repeat(counts, times).tolist() and back[1].tolist() == doc.tolist() and back[2].tolist() == restored(value).tolist()


def test_a_mapped_trie_answers_as_it_was_built(tmp_path):
    rng = np.random.default_rng(5)
    pairs = np.unique(rng.integers(0, 1 << 60, (500, 2)).astype(np.uint64) % np.uint64(97), axis=0)
    count = rng.integers(1, 9, len(pairs))
    built = Trie.build(pairs[:, 0], pairs[:, 1], count, lambda w, s: s, lambda c, of: np.log10(c), lambda c: np.log10(c))
    path = tmp_path / "x.trie"
    path.write_bytes(built.tobytes())
    trie = Trie.open(str(path))
    at = trie.find(pairs[:, 0])
    assert trie.counts[at].tolist() == [int(count[pairs[:, 0] == w].sum()) for w in pairs[:, 0]]
    assert trie.pairs(at, pairs[:, 1]).tolist() == list(range(len(pairs)))
    assert trie.find(np.array([98], np.uint64)).tolist() == [-1] and trie.pairs(at[:1], np.array([99], np.uint64)).tolist() == [-1]
