import re

import numpy as np
from pyspark.sql import functions as F

from tidegrid.llm import jaccard


def brute(rows):
    """(shingles, smallest reachable id) of each row of (id, text)."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    out = []
    for i, (own, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((own, len(sets[i]), min(ids) if ids and sets[i] else own))
    return sorted(out, key=str)


def mutated(n, seed):
    """Groups of edited copies, and a passage that many rows share."""
    rng = np.random.default_rng(seed)
    word = lambda: "w" + str(rng.integers(5000))
    passage, rows = [word() for _ in range(60)], []
    for group in range(n):
        text = [word() for _ in range(int(rng.integers(3, 120)))]
        for _ in range(int(rng.choice([1, 1, 2, 5, 30]))):
            mine = list(text)
            for _ in range(int(rng.integers(0, 1 + len(text) // 25))):
                mine[int(rng.integers(len(mine)))] = word()
            rows.append((" ".join(mine + passage * (group % 3 == 0))))
    return [(int(i), rows[k]) for k, i in enumerate(rng.permutation(len(rows)))]


def test_components_against_brute_force(spark):
    rows = mutated(60, 4)
    out = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str) == brute(rows)


def links_by_hand(rows):
    """How many other sets each row's set links to."""
    sets = {i: frozenset(jaccard.shingles(t.encode()).tolist()) for i, t in rows}
    different = set(sets.values())
    count = {x: sum(100 * len(x & y) >= 75 * len(x | y) for y in different) - 1 for x in different}
    return {i: count[x] for i, x in sets.items()}


def test_every_link_counts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    text = [f"w{k}" for k in range(200)]
    edited = lambda k: " ".join([*text[:k], f"x{k}", *text[k + 1 : 200 - int(rng.integers(0, 40))]])
    rows = mutated(20, 4)
    rows += [(1000 + k, edited(k)) for k in range(90)] + [(2000 + k, rows[k][1]) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    wanted = links_by_hand(rows)
    assert max(wanted.values()) > 60
    assert {r["doc_id"]: r["n_links"] for r in jaccard.join(docs).collect()} == wanted
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    assert {r["doc_id"]: r["n_links"] for r in jaccard.join(docs).collect()} == wanted


def test_overlaps_of_sets():
    rng = np.random.default_rng(1)
    xs, ys = ([np.unique(rng.integers(0, 300, k).astype(np.uint64)) for k in sizes] for sizes in ((1, 40, 200, 7), (90, 5, 150)))
    assert jaccard._overlaps(xs, ys).tolist() == [[len(np.intersect1d(x, y)) for y in ys] for x in xs]
    names, back = jaccard._unblock(jaccard._block([3, -4, 5, 6], xs))
    assert names.tolist() == [3, -4, 5, 6] and all((a == b).all() for a, b in zip(back, xs, strict=True))


def test_messy(messy):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    out = jaccard.join(messy).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str) == brute(rows)


def test_keeping_one_of_each_group(spark, messy):
    kept = jaccard.keep_one(messy)
    assert kept.columns == messy.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 1, 4, 5, 6, 7, 9, 10, 12, 14] and ids.count(None) == 1
    rows = mutated(40, 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in jaccard.keep_one(docs).collect()) == sorted({c for _, _, c in brute(rows)})


def test_all_pairs_of_lists_are_made():
    rng = np.random.default_rng(0)
    sh, comp, n, cls = np.sort(rng.integers(0, 30, 900)), rng.integers(0, 4, 900), rng.integers(4, 30, 900), np.arange(900)
    pos = rng.integers(0, 1 + n // 4)
    by = np.lexsort((cls, n, sh))
    rows = [x[by] for x in (sh, comp, cls, n, pos)]
    made = {tuple(sorted((int(rows[2][a]), int(rows[2][b])))) for xs, ys in jaccard._crossed(rows) for a, b in zip(xs, ys)}
    near = lambda i, j: bool(jaccard._near(*(np.array([x]) for x in (n[i], pos[i], n[j], pos[j])))[0])
    wanted = {(i, j) for i in range(900) for j in range(i + 1, 900) if sh[i] == sh[j] and comp[i] != comp[j] and near(i, j)}
    assert made == wanted and made
    assert set(zip(*(x.tolist() for x in jaccard._whole(rows, False)))) == wanted


def test_counts_of_lists_rule_out_no_link():
    rng = np.random.default_rng(5)
    base, sets = rng.integers(0, 1 << 60, 200).astype(np.uint64), []
    for _ in range(200):
        mine = base[: int(rng.integers(60, 200))].copy()
        k = int(rng.integers(0, len(mine) // 4))
        mine[rng.choice(len(mine), k, replace=False)] = rng.integers(0, 1 << 60, k)
        sets.append(np.unique(mine))
    shingle, times = np.unique(np.concatenate(sets), return_counts=True)
    often = dict(zip(shingle.tolist(), times.tolist(), strict=True))
    rows = [(x, cls, len(s), pos) for cls, s in enumerate(sets) for pos, x in enumerate(sorted(s.tolist(), key=lambda x: (often[x], x))[: jaccard.prefix_size(len(s))])]
    sh, cls, n, pos = (np.array(x) for x in zip(*sorted(rows, key=lambda r: (r[0], r[2], r[1]))))
    made = jaccard._counted_pairs([sh.astype(np.uint64), cls, cls, n, pos])
    where = {}
    for x, own, *_ in rows:
        where.setdefault(own, set()).add(x)
    kept = set()
    for a, b, count, need in made.tolist():
        assert count & 0xFFFFFFFF == len(where[a] & where[b])
        if count & 0xFFFFFFFF >= need and count >> 32:
            kept.add((a, b))
    linked = {(a, b) for a in range(200) for b in range(a + 1, 200) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert linked <= kept and linked and len(kept) < len(made) / 2


def test_more_turns_find_the_same(spark, monkeypatch):
    rows = mutated(40, 7)
    monkeypatch.setattr(jaccard, "TRIED", 0)
    out = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str) == brute(rows)


def test_parts_never_say_less_than_is_shared():
    rng = np.random.default_rng(6)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 400, int(k)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in rng.integers(1, 300, 2))
        assert jaccard._may_share(jaccard._parts(x), jaccard._parts(y)) >= len(np.intersect1d(x, y))
    x = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    assert jaccard._may_share(jaccard._parts(x[:250]), jaccard._parts(x[250:])) < 200


def test_packs_come_back():
    rng = np.random.default_rng(2)
    sh = np.sort(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    of, pos, sign = rng.integers(0, 20, 500), rng.integers(0, 99, 500), rng.integers(0, 65_536, 500).astype(np.uint16)
    cls, n = rng.integers(-(1 << 60), 1 << 60, 20), rng.integers(1, 1000, 20).astype(np.int32)
    back = jaccard._unpacked(jaccard._packed(sh, of, pos, sign, cls, n))
    assert [x.tolist() for x in back] == [sh.tolist(), cls[of].tolist(), n[of].tolist(), pos.tolist(), sign.tolist()]


def test_empty(nothing):
    assert jaccard.join(nothing).count() == 0 and jaccard.keep_one(nothing).count() == 0
    assert jaccard.join(nothing.withColumn("x", F.lit(1))).count() == 0
