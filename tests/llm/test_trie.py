"""Conversation tries against a dictionary of prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from wattline.llm import trie
from wattline.llm.base import tuned
from wattline.llm.double_array import pack, walk

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    """{conv_id: [(role, text)]}; ties by role and the turn's hash."""
    def sha(role, text):
        return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()

    out = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            out.setdefault(conv, []).append(((turn is not None, turn or 0, role, sha(role, text)), (role, text)))
    return {c: [x for _, x in sorted(v)] for c, v in out.items()}


def rebuilt(seqs):
    out = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = seqs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(seqs):
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    out = set()
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[:len(q)] == q for x in below)]
        saved = sum((len(members[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in below)
        ends = ",".join(str(c) for c in sorted(c for c in m if len(seqs[c]) == len(p)))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def made(seed=1, n=60):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(400), n):
        start = rng.choice(["a", "b"])
        for i in range(rng.randint(1, 12)):
            rows.append((c, i, rng.choice(["user", "assistant"]) if i > 3 else "user", (start if i < 3 else rng.choice(["é", "zz", ""])) * (i + 1), "clash", 5))
    rows += [(500 + i, t, "user", "same", "x", 0) for i in range(9) for t in range(4)]                   # copies of one conversation
    rows += [(1000, None, None, None, None, None), (1000, None, "r", "tied", None, None), (1000, None, "r", "ties", None, None), (1000, 7, "r", "x", None, None), (1000, 7, "r", "x", None, None)]
    rows += [(None, 1, "user", "nobody", None, None), (1003, 0, None, "", None, None)]
    rows += [(2000, i, "user", "long " * (i % 3), None, None) for i in range(60)] + [(2001, i, "user", "long " * (i % 3), None, None) for i in range(50)]
    rows += [(3000, 0, "user", "word " * 60_000, None, None)]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string, place string, n int"


@pytest.mark.parametrize("limit", [4096, 3, 1])
def test_nodes_against_prefixes(spark, monkeypatch, limit):
    monkeypatch.setattr(trie, "LIMIT", limit)
    monkeypatch.setattr(trie, "CHUNK", 16)
    monkeypatch.setattr(trie, "IDS", 4)
    monkeypatch.setattr(trie, "ROWS", 8)
    rows = made()
    df = tuned(spark).createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r[c] for c in COLUMNS) for r in trie.digest(df).collect()]
    want = brute(rebuilt(ordered(rows)))
    assert len(got) == len(want) and set(got) == want


def test_whole_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "LIMIT", 2)
    rows = made(4, 20)
    got = [tuple(r[c] for c in COLUMNS) for r in trie.nodes(trie.whole(trie.turns(tuned(spark).createDataFrame(rows, SCHEMA)))).collect()]
    want = brute(ordered(rows))
    assert len(got) == len(want) and set(got) == want


def test_no_turns(spark):
    df = tuned(spark).createDataFrame([], SCHEMA)
    assert trie.digest(df).collect() == []
    # 3 borrows turns of the absent conversation 0 and has none of its own beyond them
    assert zlib.crc32(b"3") % 9 > 0
    only = trie.digest(tuned(spark).createDataFrame([(3, 0, "user", "hi", None, None)], SCHEMA)).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in only] == [(3, 0, None, 1, 0, 1, 0, hashlib.sha256(b"3").hexdigest())]


def test_double_array():
    rng = np.random.default_rng(5)
    seqs = [tuple(rng.integers(0, 40, rng.integers(0, 9)) % (1 + rng.integers(0, 40))) for _ in range(3000)]
    lengths = np.array([len(s) for s in seqs])
    labels = np.array([x for s in seqs for x in s], np.int64)
    starts = np.cumsum(lengths) - lengths
    t = pack(labels, starts, lengths)
    state = walk(t, labels, starts, lengths)
    seen = {}
    for s, a in zip(seqs, starts, strict=True):
        for d in range(len(s)):
            assert seen.setdefault(s[:d + 1], state[a + d]) == state[a + d] > 0
            assert t.check[state[a + d]] == (seen[s[:d]] if d else 0)
    assert len(set(seen.values())) == len(seen) and t.used[:t.top].sum() == len(seen) + 1
    missing = [s + (39,) for s in seqs if s and s + (39,) not in seen][:50]
    for s in missing:
        out = walk(t, np.array(s), np.array([0]), np.array([len(s)]))
        assert out[-1] == -1 and (out[:-1] > 0).all()
