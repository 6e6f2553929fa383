"""The pipeline against a brute-force version, stage by stage on what the stage before kept."""

import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from wattline.llm import decontaminate
from wattline.llm.base import staged

SF = "/root/testdata/sf0.001"
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", text.encode())


def simhash_kept(docs):
    fps = {}
    for i, r in docs.items():
        w = words(r["text"])
        w = [x.translate(ASCII_LOWER) for x in w]
        h = np.array([xxhash.xxh64_intdigest(s, 42) for s in ([b" ".join(w[k:k + 3]) for k in range(len(w) - 2)] or [b" ".join(w)])], np.uint64)
        fps[i] = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
    ids, root = sorted(fps), {}
    for i in ids:
        near = {root[j] for j in root if (fps[i] ^ fps[j]).bit_count() <= 2}
        root[i] = min([i, *near])
        for j in root:
            if root[j] in near:
                root[j] = root[i]
    return [i for i in ids if root[i] == i]


def stripped(docs, window=35):
    toks, seen = {i: words(r["text"]) for i, r in docs.items()}, defaultdict(int)
    for w in toks.values():
        for k in range(len(w) - window + 1):
            seen[tuple(w[k:k + window])] += 1
    out = {}
    for i, w in toks.items():
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = True
        if not gone.any():
            out[i] = docs[i]["text"]
        elif not gone.all():
            out[i] = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
    return out


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    extra = spark.createDataFrame([(90_001, None, "en", "s", 0), (90_002, "... 12 ?", "en", "s", 8)], docs.schema)
    docs = docs.unionByName(extra)
    for _, fn in corpus_pipeline.STAGES:
        docs = staged(fn(spark, docs, SF))
        out.append(docs)
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "benchmark_leaks", "packed"]
    for df in stages[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_against_brute_force(spark, stages):
    source = rows(spark.read.parquet(f"{SF}/documents.parquet"))
    first, second, third, fourth = (rows(df) for df in stages[:4])
    assert first == {i: r for i, r in source.items() if any(map(str.isalpha, r["text"] or ""))}
    assert sorted(second) == simhash_kept(first) and all(second[i] == first[i] for i in second)
    assert {i: r["text"] for i, r in third.items()} == stripped(second)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, r["text"]) for i, r in third.items()])
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    leaked = {r[0] for r in con.sql(f"SELECT doc_id FROM ({decontaminate.SQL}) WHERE contaminated").fetchall()}
    assert fourth == {i: r for i, r in third.items() if i not in leaked}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, r in fourth.items():
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        want |= {(i, k, a, len(ids[a:a + 4096]), zlib.crc32(ids[a:a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in stages[4].collect()} == want


def test_stages_with_null_and_repeated_ids_and_clashing_names(spark):
    """Every stage on rows with null ids, one id with two texts, repeated rows and columns named as inner ones; and on no rows."""
    rng = np.random.default_rng(12)
    text = lambda n: " ".join(f"wort{x}" for x in rng.integers(0, 10**6, n))                       # noqa: E731
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 80").orderBy("item_id").first()["text"]
    shared, clean = text(50), [text(90) for _ in range(4)]
    given = [(None, clean[0]), (None, clean[0]), (None, f"{text(40)} {item}"), (None, clean[1]), (1, f"{text(9)} {shared}"), (1, clean[2]), (2, f"{shared} {text(9)}"), (3, None), (None, None), (4, "12 34"), (5, clean[3]), (5, clean[3])]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, _gone string, gone_id int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "g", 8) for i, t in given], schema).repartition(3)
    for name, fn in corpus_pipeline.STAGES:
        empty = fn(spark, docs.limit(0), SF)
        assert empty.count() == 0
        out = fn(spark, docs, SF)
        if name == "packed":
            break
        assert out.columns == docs.columns
        docs = staged(out)
        assert all((r["row"], r["_gone"], r["gone_id"]) == (7, "g", 8) for r in docs.collect())
    kept = sorted(str((r["doc_id"], r["text"])) for r in docs.collect())
    own = [str((i, t)) for i, t in ((None, clean[0]), (None, clean[1]), (1, clean[2]), (5, clean[3]))]
    assert [k for k in kept if k in own] == sorted(own) and len(kept) == 6                          # and the two texts that lost the shared passage
    assert sum("wort" in k and item not in k and shared not in k for k in kept) == 6
    assert {r["doc_id"] for r in out.collect()} == {None, 1, 2, 5}
