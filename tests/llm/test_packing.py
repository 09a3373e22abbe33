import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidegrid.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200))
def test_plans_place_every_piece_once(lengths):
    lengths = np.array(sorted(lengths), dtype=np.int64)
    plan = packing.plan(np.bincount(lengths, minlength=41))
    ranks = np.arange(len(lengths)) - np.searchsorted(lengths, lengths)
    sequence, offset = plan.place(lengths, ranks)
    for k in range(plan.sequences):
        mine = sequence == k
        at = 0
        for o, n in sorted(zip(offset[mine], lengths[mine])):
            assert o == at
            at += n
        assert 0 < at <= 40
    assert len(set(sequence.tolist())) == plan.sequences


def test_nearly_full_sequences():
    lengths = np.clip(np.exp(np.random.default_rng(0).normal(6, 1, 20_000)).astype(int), 1, 2048)
    assert packing.plan(np.bincount(lengths, minlength=2049)).sequences <= 1.002 * np.ceil(lengths.sum() / 2048)


def test_pieces(messy):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.pack(messy, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["piece"]):
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 2048 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        got.setdefault(r["doc_id"], []).append((r["piece"], ids))
    for r in messy.collect():
        whole = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        if len([x for x in messy.collect() if x["doc_id"] == r["doc_id"]]) == 1:
            assert np.concatenate([x for _, x in got[r["doc_id"]]]).tolist() == whole.tolist()
            assert [k for k, _ in got[r["doc_id"]]] == list(range(-(-len(whole) // 2048)))
    filled = {}
    for r in out:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048


def test_empty(nothing):
    assert packing.pack(nothing, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
