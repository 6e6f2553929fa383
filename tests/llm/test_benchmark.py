"""Decontamination and chat rendering against their SQL and by hand."""

import duckdb
import pytest

from wattline.llm import decontaminate, rotation
from wattline.llm.base import tuned

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def docs_and_items():
    docs = [(1, f"Start {ITEM.upper()}! end"), (2, "x, ALPHA beta-gamma; É 5"), (3, None), (4, ""), (5, "?? .."), (6, "é É"), (7, "alpha beta gamma " * 30), (8, "clean words only here"),
            (9, ITEM.rsplit(" ", 3)[0]), (10, ITEM.replace("eta ", "eta\n")), (11, "Ünder é")]
    items = [(70, ITEM), (7, ITEM), (8, "Alpha BETA gamma"), (100, "É"), (9, None), (10, "..."), (11, "no such thing at all in any of these texts here"), (12, "beta")]
    return docs, items


@pytest.mark.parametrize("most", [500_000, 0])
def test_decontamination_equals_sql(spark, most):
    docs, items = docs_and_items()
    spark = tuned(spark)
    d = spark.createDataFrame([(*r, 1, "a") for r in docs], "doc_id bigint, text string, start int, window string")
    b = spark.createDataFrame([(*r, "w") for r in items], "item_id bigint, text string, words string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    want = {r[0]: r[1:4] for r in con.sql(decontaminate.SQL).fetchall()}
    got = {r.doc_id: (r.n_words, r.n_hit, len(r.items)) for r in decontaminate.hits(d, b, most).collect()}
    assert got == want and got[1] == (14, 12, 4) and got[8][1] == 0 and got[6] == (2, 1, 1)
    assert {r.doc_id for r in decontaminate.clean(d, b).collect()} == {i for i, v in want.items() if not v[1]}


def test_decontamination_edges(spark):
    docs, items = docs_and_items()
    spark = tuned(spark)
    d = spark.createDataFrame(docs + [docs[0], (None, "beta")], "doc_id bigint, text string")
    b = spark.createDataFrame(items + [(None, "start")], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.hits(d, b).collect()}
    assert len(got) == len(docs) + 1 and got[1].n_hit == 13 and got[1].items == ["12", "7", "70", "8"] and got[None].items == ["12"]
    assert all(r.n_hit == 0 and r.n_words is not None for r in decontaminate.digest(d, b.limit(0)).collect())
    assert decontaminate.digest(d.limit(0), b).count() == 0


def test_perspectives(spark):
    rows = [(1, 0, "system", "Be kind"), (1, 1, "ann", "Hi"), (1, 2, "bob", None), (1, 3, "ann", "a <|im_end|> b"), (1, 3, "ann", "a <|im_end|> b"), (1, None, None, "late"), (1, 70, "cyd", "é"),
            (2, 0, "system", "alone"), (None, 0, "ann", "lost")]
    df = tuned(spark).createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, speaker string")
    out = rotation.perspectives(df).collect()
    assert {(r.conv_id, r.speaker, r.chunk) for r in out} == {(1, s, c) for s in ("ann", "bob", "cyd") for c in (-1, 0, 1)}
    ann = next(r for r in out if (r.speaker, r.chunk) == ("ann", 0))
    assert [ann.text[s.start:s.end] for s in ann.mask] == ["Hi<|im_end|>", "a < |im_end|> b<|im_end|>", "a < |im_end|> b<|im_end|>"]
    assert "<|im_start|>user name=bob\n<|im_end|>\n" in ann.text and ann.text.startswith("<|im_start|>system\nBe kind<|im_end|>\n")
    assert next(r for r in out if (r.speaker, r.chunk) == ("bob", -1)).text == "<|im_start|>user name=unknown\nlate<|im_end|>\n"
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cols = ["conv_id", "speaker", "chunk", "n_messages", "text", "mask"]
    assert sorted(map(tuple, rotation.digest(df).select(cols).collect())) == sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({rotation.SQL})").fetchall())
    assert rotation.digest(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [500_000, 0])
def test_decontamination_of_null_and_repeated_ids(spark, most, monkeypatch):
    monkeypatch.setattr(decontaminate.hits, "__defaults__", (most,))
    rows = [(None, ITEM), (None, "clean one"), (None, None), (1, ITEM), (1, "clean two"), (2, "clean three"), (2, "clean three")]
    d = tuned(spark).createDataFrame([(*r, "x", 5) for r in rows], "doc_id bigint, text string, _gone string, gone_id int")
    b = tuned(spark).createDataFrame([(7, ITEM)], "item_id bigint, text string")
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, (r for r in rows if r[1] != ITEM)))
    out = decontaminate.digest(d, b).collect()
    assert len(out) == 6 and sorted(str(r.doc_id) for r in out if r.contaminated) == ["1", "None"]
