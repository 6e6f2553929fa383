"""Near duplicates: SimHash and embeddings against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from wattline.llm import neighbours, simhash
from wattline.llm.base import tuned
from wattline.llm.components import components


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 200 + i) for i in range(30)] + [(5, 5), (300, 299), (299, 300)]
    df = tuned(spark).createDataFrame([*links, (None, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(df).collect()}
    nodes = {n for a, b in links for n in (a, b) if a != b}
    assert got == groups(nodes, [x for x in links if x[0] != x[1]])


@pytest.mark.parametrize("limit", [512, 4])
def test_trie_join_against_all_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "LIMIT", limit)
    rng, fps = random.Random(2), set()
    for _ in range(8):
        c = rng.getrandbits(64)
        for _ in range(20):
            x = c
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randint(0, 63)
            fps.add(x)
            c = x if rng.random() < 0.3 else c
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = tuned(spark).createDataFrame([(x,) for x in signed], "fp bigint")
    got = {r.node: r.component for r in components(simhash.fingerprint_links(df)).collect()}
    want = groups(signed, [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2])
    assert {x: got.get(x, x) for x in signed} == want


def test_simhash_digest(spark):
    rng = np.random.default_rng(3)
    base = " ".join(rng.choice(["alpha", "Beta", "gämma", "delta."], 300))
    rows = [(5, base), (3, base.upper().replace("Ä", "ä")), (9, base + " End"), (1, None), (2, ""), (7, "one"), (8, "two words"), (4, " \n"), (None, "one"), (5, base), (6, "x " * 700)]
    docs = tuned(spark).createDataFrame([(*r, 0, "q") for r in rows], "doc_id bigint, text string, fp int, component string")
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

    def fingerprint(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(low))
        h = [xxhash.xxh64_intdigest(s, 42) for s in ([b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else []))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = [fingerprint(t) for _, t in rows]
    key = [i if i is not None else -1 for i, _ in rows]
    want = groups(sorted(set(key)), [(key[i], key[j]) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2])
    got = simhash.digest(docs).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id if r.component_id is not None else -1) for r in got) == sorted((k, f"{f:016x}", want[k]) for k, f in zip(key, fp, strict=True))
    kept = simhash.keep_first(docs.where("doc_id IS NOT NULL"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3, 6, 7, 8} - ({3} if want[3] != 3 else set())
    assert simhash.digest(docs.limit(0)).count() == 0


def test_embeddings_against_all_pairs(spark, monkeypatch):
    """A short list is saturated by the large group and has to be enlarged; small blocks split the group."""
    monkeypatch.setattr(neighbours, "LIST", 4)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(4)
    x = [rng.normal(size=16) for _ in range(120)]
    c = rng.normal(size=16)
    x += [c + 0.1 * rng.normal(size=16) for _ in range(60)]
    x += [x[0] + 0.05 * rng.normal(size=16), x[1] * 3, x[2].copy(), x[2].copy()]
    rows = [(1000 - i, v.tolist(), i % 3) for i, v in enumerate(x)]
    odd = [(2001, None, 0), (2002, [0.0] * 16, 0), (2003, [1.0, None] + [0.0] * 14, 0), (2004, [float("nan")] + [1.0] * 15, 0), (2005, [float("inf")] * 16, 0), (2006, [], 0), (None, x[0].tolist(), 0)]
    df = tuned(spark).createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, label int")
    ids, m = [r[0] for r in rows], np.stack(x)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    want = groups(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near), strict=True)])
    got = neighbours.digest(df).collect()
    assert len(got) == len(rows) + len(odd)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert {i: got[i] for i in ids} == {i: (int(near[k].sum()), want[i], want[i] == i) for k, i in enumerate(ids)}
    assert all(got[r[0]] == (0, r[0], True) for r in odd)
    assert neighbours.digest(df.limit(0)).count() == 0


def test_keep_first_with_null_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    a, b, c = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, 200)) for _ in range(3))
    rows = [(None, a), (None, a), (None, a), (5, a), (1, b), (1, c), (2, b), (7, c), (7, c), (None, None), (8, "")]
    docs = tuned(spark).createDataFrame([(*r, i, "g") for i, r in enumerate(rows)], "doc_id bigint, text string, gone_row int, _gone string").repartition(3)
    out = simhash.keep_first(docs)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text), r.gone_row) for r in out.collect()) == sorted([("None", a, 0), ("1", b, 4), ("1", c, 5), ("None", "None", 9)])
