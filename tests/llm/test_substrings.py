"""Substring operators against brute force, and the exchange with tiny limits."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from wattline.llm import repeats, substring, suffixes
from wattline.llm.base import tuned

SCHEMA = "doc_id bigint, text string, start int, n string, source string"     # start, n: names that clash with inner ones


def corpus():
    rng = np.random.default_rng(5)
    words = ["ab", "cde", "é", "fgh", "i", "jklm,", "N.", "ünd"]
    text = lambda n: " ".join(rng.choice(words, n))                                              # noqa: E731
    shared, line = text(60), text(45)
    rows = [(i, text(int(rng.integers(0, 120)))) for i in range(20)]
    rows += [(20 + i, f"{text(20)}\t{shared}\n{text(20)}") for i in range(6)]
    rows += [(30 + i, f"{line} {text(i)} {line}") for i in range(5)]
    rows += [(40, None), (41, ""), (42, " \n\t "), (43, "x"), (44, "ab " * 400), (45, rows[22][1]), (46, rows[22][1]), (None, rows[3][1] + " tail")]
    return [(i, t, 1, "z", "s") for i, t in rows]


def brute_words(rows, window=35):
    toks = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for i, t, *_ in rows}
    seen = defaultdict(int)
    for w in toks.values():
        for k in range(len(w) - window + 1):
            seen[tuple(w[k:k + window])] += 1
    out = {}
    for i, w in toks.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def brute_bytes(rows, window=100):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - window + 1):
            s = b[k:k + window]
            if s in seen:
                gone[k:k + window] = True
            seen.add(s)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("limit", [8192, 2])
def test_against_brute_force(spark, monkeypatch, limit):
    """A limit of 2 sends every anchor with two different runs through the split into single windows."""
    monkeypatch.setattr(repeats, "LIMIT", limit)
    rows = corpus()
    docs = tuned(spark).createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digest(docs).collect()}
    assert got == brute_words(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest(docs).collect()}
    assert got == brute_bytes(rows)


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = tuned(spark).createDataFrame([(1, text), (1, text)], "doc_id bigint, text string")
    assert [r.n_removed for r in substring.digest(docs).collect()] == [0, 0]
    assert [r.n_removed for r in suffixes.digest(docs).collect()] == [0, 0]


def test_strip_keeps_clean_documents_and_columns(spark):
    line, own = " ".join(f"w{i}" for i in range(40)), " own\twords  stay "
    rows = [(1, own, "a", 5, 7), (2, f"{line} x", "b", 5, 7), (3, f"y {line}", "c", 5, 7), (4, line, "d", 5, 7)]
    docs = tuned(spark).createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars bigint, start int")
    got = {r.doc_id: r for r in substring.strip(docs).collect()}
    assert set(got) == {1, 2, 3} and (got[1].text, got[2].text, got[3].text) == (own, "x", "y")
    assert (got[1].n_chars, got[2].n_chars, got[1].start, got[2].lang) == (5, 1, 7, "b")


def test_empty_tables(spark):
    docs = tuned(spark).createDataFrame([], "doc_id bigint, text string")
    assert substring.digest(docs).count() == 0 and suffixes.digest(docs).count() == 0


def test_suffix_order_is_the_sorted_one():
    """The transform's suffix order and common prefixes against sorting."""
    rng = np.random.default_rng(1)
    seqs = [rng.integers(0, 3, rng.integers(1, 25)).astype(np.int32) for _ in range(40)]
    starts = np.cumsum([0] + [len(s) for s in seqs[:-1]])
    lengths = np.array([len(s) for s in seqs])
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        who, place, lcp = suffixes.transform(np.concatenate(seqs), starts, lengths, folder)
    rows = [tuple(seqs[w][p:].tolist()) for w, p in zip(who, place, strict=True)]
    assert rows == sorted(rows) and sorted(zip(who.tolist(), place.tolist(), strict=True)) == [(i, k) for i, s in enumerate(seqs) for k in range(len(s))]
    for a, b, n in zip(rows, rows[1:], lcp[1:], strict=False):
        assert n == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_null_and_repeated_ids(spark):
    """Rows are told apart by id and text: several null ids, one id with two texts, whole rows repeated."""
    rng = np.random.default_rng(9)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))                        # noqa: E731
    shared, clean = text(60), text(60)
    rows = [(None, f"{shared} {text(5)}"), (None, clean), (None, f"{shared} {text(7)}"), (None, clean), (1, f"{text(3)} {shared}"), (1, text(70)), (2, text(50)), (2, text(50)), (2, None), (None, None)]
    docs = tuned(spark).createDataFrame([(*r, 3, "r") for r in rows], "doc_id bigint, text string, row int, gone_id string").repartition(4)
    n = {t: len(re.findall(r"\S+", t or "")) for _, t in rows}
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring.digest(docs).collect())
    assert got == sorted((str(i), n[t], 60 if shared in (t or "") else 0) for i, t in rows)
    # bytes: of the documents with the passage all but the first lose it; null ids come first, in the order of their texts' hashes
    out = [(r.doc_id, r.n_bytes, r.n_removed) for r in suffixes.digest(docs).collect()]
    size, cut = {t: len((t or "").encode()) for _, t in rows}, len(shared.encode())
    assert sorted((str(i), b) for i, b, _ in out) == sorted((str(i), size[t]) for i, t in rows)
    lost = [(i, m) for i, _, m in out if m]
    assert len(lost) == 2 and all(m >= cut for _, m in lost) and sum(i == 1 for i, _ in lost) == 1
    kept = substring.strip(docs).collect()
    assert sorted(str(r.text) for r in kept if r.text and shared not in r.text and len(r.text.split()) > 9) == sorted(t for _, t in rows if t and shared not in t)
    assert all(r.row == 3 and r.gone_id == "r" for r in kept) and len(kept) == len(rows)
