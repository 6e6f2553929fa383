"""Tokens, the plan and the round trip of packing."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wattline.llm import packing
from wattline.llm.base import tuned

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "Hello, World!", "it's 'S 'LL don't", "ÉÀ é́ é ΣΑΣ ΌΔΟΣ Σ", "a\x1cb \x85c d e​f", "<|endoftext|> x<|startoftext|>y", "ﬁ İstanbul ǅ ẞ", "１２3 ½ ² x²", "word. " * 30,
         "日本語 テキスト です", "́a ́", "<|ENDOFTEXT|>", "tab\tnew\nline\r\n", "emoji 👩‍👩‍👧 ok"]


def test_ids_equal_the_tokenizer():
    tokenizer, encode = Tokenizer.from_file(VOCABULARY), packing.ChunkEncoder(VOCABULARY)
    assert encode.by_chunk
    for text in TEXTS + [" ".join(TEXTS)]:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    assert not packing.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json")).by_chunk


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=40))
@settings(max_examples=60, deadline=None)
def test_plan_uses_every_piece_once(histogram):
    used, total = {}, 0
    for n, inside in packing.plan(histogram, 64):
        assert n > 0 and sum(length * each for length, each in inside) <= 64
        total += n
        for length, each in inside:
            used[length] = used.get(length, 0) + n * each
    assert used == histogram
    assert total >= -(-sum(k * v for k, v in histogram.items()) // 64)


def test_exact_complements_are_found():
    rows = packing.plan({60: 5, 4: 3, 2: 4, 30: 2, 29: 1, 5: 1}, 64)
    assert sum(n for n, _ in rows) == -(-(300 + 12 + 8 + 60 + 29 + 5) // 64)
    assert (3, [(60, 1), (4, 1)]) in rows


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    length, n = np.unique(np.clip(rng.lognormal(6.8, 1, 40_000).astype(int), 1, 4096), return_counts=True)
    rows = packing.plan(dict(zip(length.tolist(), n.tolist(), strict=True)))
    assert sum(n for n, _ in rows) <= 1.002 * -(-int(length @ n) // 4096) and len(rows) < 10_000


@pytest.mark.parametrize("capacity", [4096, 50])
def test_round_trip(spark, capacity):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(100, None, "x", 1), (100, None, "x", 1), (None, "null id", "x", 1), (101, "long text " * 9000, "x", 1)]
    docs = tuned(spark).createDataFrame(rows, "doc_id bigint, text string, piece string, length int")
    got = packing.pack(docs, VOCABULARY, capacity).collect()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = []
    for i, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(-1 if i is None else i, k, a, len(ids[a:a + capacity]), zlib.crc32(ids[a:a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    sequences = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert sequences.get(r.sequence_id, 0) == r.offset
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= capacity and len(sequences) <= 1.1 * sum(r.length for r in got) / capacity + 1
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0
