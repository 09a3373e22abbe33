import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidegrid.llm import store
from tidegrid.llm.tokens import _WORKERS, Encoder

FILES = {"word_bpe_49k.json": False, "byte_bpe_50k.json": True}


@pytest.mark.parametrize("name", FILES)
def test_pieces_encode_as_whole_texts_do(name):
    whole, mine = Tokenizer.from_file(public_tokenizers.path(name)), Encoder(public_tokenizers.path(name), spaces=FILES[name], most=50)

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from(list("aZé1'!. s\n\t 　\x1c<|ÀßǄ")), st.characters(exclude_categories=["Cs"])), max_size=30))
    def same(text):
        assert mine.ids([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids

    same()


def test_crcs_of_parts_join():
    rng = np.random.default_rng(3)
    parts = [rng.bytes(int(n)) for n in rng.integers(0, 5000, 40)]
    starts = np.array([0, 1, 9, 30])
    runs = [parts[a:b] for a, b in zip(starts, [*starts[1:], 40])]
    got = store.joined_crc(np.array([zlib.crc32(p) for p in parts], np.uint32), np.array([len(p) for p in parts]), starts)
    assert got.tolist() == [zlib.crc32(b"".join(r)) for r in runs]


def test_an_insertion_changes_few_chunks():
    ids = np.random.default_rng(1).integers(0, 40_000, 20_000).astype("<u2")
    other = np.insert(ids, 777, 5)

    def chunks(x):
        ends = store.cuts(x)
        assert ends[-1] == len(x) and max(np.diff([0, *ends])) <= store.MOST
        return {x[a:b].tobytes() for a, b in zip([0, *ends], ends)}

    a, b = chunks(ids), chunks(other)
    assert len(a - b) <= 3


@pytest.fixture(scope="module")
def stored(spark, messy):
    return store.write(messy, public_tokenizers.path("word_bpe_49k.json"), end=2)


def test_round_trip(spark, messy, stored):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    wanted = sorted((r["doc_id"] is None, r["doc_id"] or 0, len(x := ids(r["text"])), zlib.crc32(x.tobytes())) for r in messy.collect())
    got = store.read(spark, stored).collect()
    assert all(r["sound"] for r in got)
    assert sorted((r["id"] is None, r["id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == wanted
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [(r["id"] is None, r["id"] or 0) for r in sorted(got, key=lambda r: r["start"])]
    assert keys == sorted(keys)


def test_chunks_are_stored_once(spark, stored):
    names = [bytes(d) for r in spark.read.parquet(stored.chunks).collect() for d in r["digests"]]
    assert len(names) == len(set(names))


def test_damage_is_found(spark, stored):
    from dataclasses import replace

    from pyspark.sql import functions as F

    from tidegrid.llm.common import shared_path

    path = shared_path(spark, "damaged")
    spark.read.parquet(stored.recipes).withColumn("digests", F.when(F.col("id") == 7, F.reverse("digests")).otherwise(F.col("digests"))).write.parquet(path)
    broken = {r["id"]: r["sound"] for r in store.read(spark, replace(stored, recipes=path)).collect()}
    assert broken[7] is False and broken[3] is True


def test_empty(spark, nothing):
    made = store.write(nothing, public_tokenizers.path("word_bpe_49k.json"), end=2)
    assert store.read(spark, made).count() == 0


def test_cuts_of_many_documents_are_those_of_each():
    rng = np.random.default_rng(3)
    sizes = [1, 5, 64, 65, 700, 0, 9000, 15, 130, 2049, 3]
    docs = [rng.integers(0, 49_000, n).astype(np.uint16) for n in sizes]
    docs[6][2000:8000] = 7  # a run without marks
    assert store.cuts_of(np.concatenate(docs), sizes) == [store.cuts(x) for x in docs]


def test_worker_keeps_one_encoder():
    odd = ["Straße, it's ªb µx º!", "Ã© é", "a\xa0b", "x<|y", "  x  y\r\n", "ÀÉ×÷ !!!", "Ābc 日本", "'", "a1b2 3,4"]
    for name, spaces in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        encoder = Encoder.of(public_tokenizers.path(name), spaces=spaces)
        assert [x.tolist() for x in encoder.ids(odd)] == [encoder.tokenizer.encode(x, add_special_tokens=False).ids for x in odd]
    assert list(_WORKERS) == [public_tokenizers.path("byte_bpe_50k.json")]
