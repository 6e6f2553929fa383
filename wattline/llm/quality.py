"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

x holds the text's words (hashed into 2 ** `BITS` places, log counts, unit length), statistics of its structure (shares of kinds of bytes,
repetition, lengths of words and lines) and the recorded n_chars, standardised on the sample.  The score is the logistic of
    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ],
the pairwise interactions of all features in time linear in their number.  Trained in numpy on a bounded sample of about `SAMPLE` labelled
documents that are not held out (reweighted to their true shares); every whole text is scored.

Null or empty text has no words and zero statistics; it gets a score like any other.  A null or missing n_chars counts as the mean.  Labels other than
0 and 1, null labels and null doc_ids are not learned from; a null doc_id counts as held out.  Without labels every score is 0.5.
Repeated rows each get a row.  labels, lang, source and doc_id are never inputs of a score.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm import words
from wattline.llm.base import buffer_of
from wattline.llm.labelled import bounded, learnable
from wattline.llm.langid import held_out

BITS, RANK, SAMPLE = 16, 8, 6_000
HELD_OUT, CUT = (5, 0), 0.3          # crc32 of doc_id modulo 5 is 0; label 1 from this score on
EPOCHS, BATCH, RATE, RIDGE = 20, 128, 0.01, 1e-4
_KINDS = [[c for c in range(256) if test(c)] for test in (
    lambda c: 65 <= c < 91, lambda c: 97 <= c < 123, lambda c: 48 <= c < 58, lambda c: c in (32, 9), lambda c: c in (10, 13), lambda c: c >= 128,
    lambda c: chr(c) in ".,;:?'\"-()", lambda c: chr(c) in "!", lambda c: chr(c) in "|", lambda c: c < 128 and chr(c) in "#$%&*+/<=>@[\\]^_`{}~")]
STATISTICS = len(_KINDS) + 9         # kinds of bytes, words, repetition, lines, metadata


def statistics(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray, end: np.ndarray, text: np.ndarray, h: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    """(texts, STATISTICS) of texts with words data[first:end] of hash h; nan stands for unknown."""
    m = len(starts)
    out = np.zeros((m, STATISTICS))
    full = np.flatnonzero(lengths > 0)
    for k, kind in enumerate(_KINDS):
        is_kind = np.zeros(256, np.int64)
        is_kind[kind] = 1
        if len(full):
            out[full, k] = np.add.reduceat(is_kind[data], starts[full]) / lengths[full]
    k = len(_KINDS)
    n = np.bincount(text, minlength=m)
    size = end - first
    some = np.maximum(n, 1)
    mean = np.bincount(text, size, m) / some
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    order = np.lexsort((h, text))
    new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])))[:len(h)]
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(h)))
    most = np.zeros(m)
    np.maximum.at(most, text[order][at], run)
    lines = out[:, 4] * lengths + 1
    out[:, k:] = np.stack([np.log1p(n), mean, np.sqrt(np.maximum(np.bincount(text, size.astype(float)**2, m) / some - mean**2, 0)), np.bincount(text, again, m) / some,
                           np.bincount(text[order][at], minlength=m) / some, most / some, np.log1p(lengths / lines), np.log1p(n / lines), n_chars], 1)
    return out


@dataclass
class Machine:
    """w0, w (features), v (features, RANK); words first, then statistics; mean and spread standardise the statistics."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def standard(self, stats: np.ndarray) -> np.ndarray:
        x = (stats - self.mean) / self.spread
        return np.clip(np.where(np.isfinite(x), x, 0), -5, 5)

    def raw(self, at: np.ndarray, idx: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score before the logistic, and the sums over x of each row; rows begin at `at` and none is empty."""
        vx = self.v[idx] * val[:, None]
        sums = np.add.reduceat(vx, at, axis=0)
        return self.w0 + np.add.reduceat(self.w[idx] * val, at) + 0.5 * (sums**2 - np.add.reduceat(vx**2, at, axis=0)).sum(1), sums


def word_features(h: np.ndarray, text: np.ndarray, m: int):
    """Sorted (text, place, value) of the hashed words: log counts of unit length."""
    key, n = np.unique(text * (1 << BITS) + (h >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    doc, idx, val = key >> BITS, key & ((1 << BITS) - 1), np.log1p(n)
    return doc, idx, val / np.sqrt(np.bincount(doc, val**2, m))[doc]


def _joined(doc, idx, val, stats):
    """Rows of words and statistics together: row starts, places, values."""
    m = len(stats)
    n = np.bincount(doc, minlength=m)
    at = np.cumsum(n + STATISTICS) - (n + STATISTICS)
    total = len(doc) + m * STATISTICS
    i, x = np.empty(total, np.int64), np.empty(total)
    own = at[:, None] + n[:, None] + np.arange(STATISTICS)
    i[own], x[own] = (1 << BITS) + np.arange(STATISTICS), stats
    place = at[doc] + np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
    i[place], x[place] = idx, val
    return at, i, x


def _parts(b: pa.RecordBatch):
    data, starts, lengths = buffer_of(b.column("text"))
    first, end, text = words.spans(data, starts, lengths)
    h = words.hashes(data, first, end)
    n_chars = np.log1p(np.maximum(b.column("n_chars").cast(pa.float64()).to_numpy(zero_copy_only=False), 0))
    return word_features(h, text, len(starts)), statistics(data, starts, lengths, first, end, text, h, n_chars)


def _inputs(docs: DataFrame, *more):
    n_chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select("doc_id", n_chars.alias("n_chars"), F.col("text").cast("binary").alias("text"), *more)


def fit(docs: DataFrame, labels: DataFrame, seed: int = 9) -> Machine:
    """Learned from a bounded sample of the labelled documents that are not held out."""
    rng = np.random.default_rng(seed)
    size = (1 << BITS) + STATISTICS
    blank = Machine(0.0, np.zeros(size), np.zeros((size, RANK)), np.zeros(STATISTICS), np.ones(STATISTICS))
    sample = bounded(learnable(labels, "quality", *HELD_OUT), SAMPLE, "quality")

    def features(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            (doc, idx, val), stats = _parts(b)
            cut = np.searchsorted(doc, np.arange(len(stats) + 1)).tolist()
            i, x = idx.astype("<i4"), val.astype("<f4")
            out = [[i[a:z].tobytes() for a, z in zip(cut, cut[1:], strict=False)], [x[a:z].tobytes() for a, z in zip(cut, cut[1:], strict=False)], [s.tobytes() for s in stats]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("weight"), *[pa.array(o, pa.binary()) for o in out]], ["doc_id", "y", "weight", "i", "x", "s"])

    rows = _inputs(docs).join(F.broadcast(sample), "doc_id")                # the sample's size is bounded
    got = rows.mapInArrow(features, "doc_id bigint, y int, weight double, i binary, x binary, s binary").toPandas()
    if not len(got):
        return blank
    got = got.sort_values(["doc_id", "s", "x"], kind="stable")
    stats = np.stack([np.frombuffer(s, np.float64) for s in got["s"]])
    known = np.isfinite(stats)
    mean = np.where(known, stats, 0).sum(0) / np.maximum(known.sum(0), 1)
    spread = np.sqrt(np.where(known, (stats - mean)**2, 0).sum(0) / np.maximum(known.sum(0), 1))
    y, weight = got["y"].to_numpy(float), got["weight"].to_numpy(float)
    base = np.log((weight @ y + 1) / (weight @ (1 - y) + 1))
    model = Machine(float(base), np.zeros(size), rng.normal(0, 0.02, (size, RANK)), mean, np.where(spread > 1e-9, spread, 1))
    stats = model.standard(stats)
    lists = [(np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(float)) for i, x in zip(got["i"], got["x"], strict=True)]
    sums = {"w": np.zeros(size), "v": np.zeros((size, RANK)), "w0": 0.0}
    weight = weight / weight.mean()
    for epoch in range(EPOCHS):
        rate = RATE * 5 / (1 + epoch / 5)
        order = rng.permutation(len(lists))
        for k in range(0, len(order), BATCH):
            rows_ = order[k:k + BATCH]
            doc = np.repeat(np.arange(len(rows_)), [len(lists[r][0]) for r in rows_])
            at, idx, val = _joined(doc, np.concatenate([lists[r][0] for r in rows_]), np.concatenate([lists[r][1] for r in rows_]), stats[rows_])
            z, s = model.raw(at, idx, val)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows_]) * weight[rows_] / len(rows_)
            own = np.repeat(np.arange(len(rows_)), np.diff(np.append(at, len(idx))))
            used, back = np.unique(idx, return_inverse=True)
            gw = np.bincount(back, d[own] * val) + RIDGE * model.w[used]
            each = (d[own] * val)[:, None] * (s[own] - model.v[idx] * val[:, None])
            gv = np.stack([np.bincount(back, each[:, f]) for f in range(RANK)], 1) + RIDGE * model.v[used]
            sums["w"][used] += gw**2
            sums["v"][used] += gv**2
            sums["w0"] += d.sum()**2
            model.w[used] -= rate * gw / (np.sqrt(sums["w"][used]) + 1e-8)
            model.v[used] -= rate * gv / (np.sqrt(sums["v"][used]) + 1e-8)
            model.w0 -= rate * d.sum() / (np.sqrt(sums["w0"]) + 1e-8)
    return model


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    model = docs.sparkSession.sparkContext.broadcast(machine)               # its size is set by BITS and RANK

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.value
        for b in rows:
            if not b.num_rows:
                continue
            (doc, idx, val), stats = _parts(b)
            z, _ = machine.raw(*_joined(doc, idx, val, machine.standard(stats)))
            s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return _inputs(docs, held_out(*HELD_OUT).alias("held_out")).mapInArrow(task, "doc_id bigint, held_out boolean, score double, predicted int")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    return score(docs, fit(docs, labels))
