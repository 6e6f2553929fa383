"""Classifiers: held-out accuracy on made texts, exactness of the formulas, edge cases."""

import zlib

import numpy as np
import pytest

from wattline.llm import langid, quality, toxicity
from wattline.llm.base import tuned

STEMS = {"en": ["the", "ing", "wh", "tion", "er"], "de": ["sch", "ung", "ß", "ein", "ü"], "fr": ["eau", "é", "que", "ou", "è"]}


def made(n=360):
    rng, docs, labels = np.random.default_rng(6), [], []
    for i in range(n):
        lang = ["en", "de", "fr"][i % 3]
        word = lambda: "".join(rng.choice(STEMS[lang], rng.integers(1, 4)))                      # noqa: E731
        words = [word() for _ in range(int(rng.integers(10, 120)))]
        toxic, good = i % 4 == 1, i % 5 != 2
        if toxic:
            words[int(rng.integers(0, len(words)))] = str(rng.choice(["scumbag", "moronic"]))
        text = " ".join(words) if good else "!! ".join(words).upper()
        docs.append((i, text, lang, "s", len(text)))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


EXTRA = [(9001, None, "en", "s", 0), (9002, "", "en", "s", None), (9003, "123 -- !", None, "s", 8), (None, "the whing", "en", "s", 9), (9004, "the tion " * 5000, "en", "s", 1), (9004, "the tion " * 5000, "en", "s", 1)]
DOCS, LABELS = "doc_id bigint, text string, lang string, source string, n_chars bigint", "doc_id bigint, quality int, toxic int"


def tables(spark):
    docs, labels = made()
    spark = tuned(spark)
    return spark.createDataFrame(docs + EXTRA, DOCS), spark.createDataFrame(labels + [(None, 1, 1), (9001, None, None), (3, 0, None)], LABELS), {r[0]: r for r in docs}, {r[0]: r for r in labels}


def crc(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def test_language(spark):
    docs, _, truth, _ = tables(spark)
    got = langid.digest(docs).collect()
    assert len(got) == len(truth) + len(EXTRA)
    own = [r for r in got if r.doc_id in truth]
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in own)
    held = [r.lang_pred == truth[r.doc_id][2] for r in own if r.held_out]
    assert np.mean(held) > 0.97
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (9001, 9002, 9003)} == dict.fromkeys((9001, 9002, 9003), "und")
    kept = langid.known_language(docs)
    assert kept.columns == docs.columns and kept.schema["text"].dataType == docs.schema["text"].dataType
    rows = kept.collect()
    assert len(rows) == len(truth) + 3 and {tuple(r) for r in rows if r.doc_id in truth} == set(truth.values())


def test_language_without_labels_or_rows(spark):
    docs = tables(spark)[0]
    from pyspark.sql import functions as F

    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.digest(blank).collect()} == {"und"}
    assert langid.digest(docs.limit(0)).count() == 0


def test_convolution_by_hand():
    """Pooled responses through pair tables equal the direct sums."""
    rng = np.random.default_rng(7)
    net = langid.ByteConvNet.start(3, rng)
    x = rng.integers(0, 256, (2, langid.WINDOW + langid._TAIL)).astype(np.uint8)
    want = [[max(0, max(sum(t[o, x[n, i + o], f] for o in range(len(t))) for i in range(langid.WINDOW))) for t in net.tables for f in range(langid.FILTERS)] for n in range(2)]
    np.testing.assert_allclose(net.features(x, net.pairs()), want, rtol=1e-4, atol=1e-6)


@pytest.mark.parametrize("module, column, modulus, rest", [(toxicity, 2, 4, 2), (quality, 1, 5, 0)])
def test_scores(spark, module, column, modulus, rest):
    docs, labels, truth, known = tables(spark)
    got = module.digest(docs, labels).collect()
    assert len(got) == len(truth) + len(EXTRA)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    own = [r for r in got if r.doc_id in truth]
    assert all(r.held_out == (crc(r.doc_id, modulus) == rest) for r in own)
    assert np.mean([r.predicted == known[r.doc_id][column] for r in own if r.held_out]) > 0.93
    assert len({r.score for r in got if r.doc_id == 9004}) == 1
    assert module.digest(docs.limit(0), labels).count() == 0
    none = module.digest(docs, labels.limit(0)).collect()
    assert len(none) == len(got) and len({r.score for r in none}) == 1


def test_machine_equals_pairwise_sum():
    rng = np.random.default_rng(8)
    size = (1 << quality.BITS) + quality.STATISTICS
    m = quality.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, quality.RANK)), np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))
    idx, val = np.array([5, 9, 70, 5000]), rng.normal(size=4)
    z, _ = m.raw(np.array([0]), idx, val)
    want = 0.3 + m.w[idx] @ val + sum(m.v[idx[i]] @ m.v[idx[j]] * val[i] * val[j] for i in range(4) for j in range(i))
    assert abs(z[0] - want) < 1e-9
