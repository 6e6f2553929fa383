"""Toxicity by a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

Text is taken as bytes, A-Z lower-cased, ASCII other than letters and digits as a blank; runs of `SIZES` bytes are hashed into 2 ** `BITS` cells.
A document's features are the cells it holds.  From all labelled documents that are not held out come the numbers of documents of each
class that hold a cell, summed in Spark; their smoothed log ratio scales the cell.  The `FEATURES` cells that tell the classes apart most
enter a logistic regression with a ridge penalty, fitted in numpy on a bounded sample of about `SAMPLE` labelled documents (reweighted to
their true shares).  Every whole text is scored.

Null or empty text has no features: its score is the intercept's.  Labels other than 0 and 1, null labels and null doc_ids are not learned
from; a null doc_id counts as held out.  Without labels of both classes every score is the share of label 1 (0 without labels).
Repeated rows each get a row.  labels, lang, source and doc_id are never inputs of a score.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.anchors import gram_hashes
from wattline.llm.base import buffer_of
from wattline.llm.labelled import bounded, learnable
from wattline.llm.langid import held_out

SIZES, BITS, FEATURES, SAMPLE = (4, 5, 6, 7, 8), 20, 1 << 12, 12_000
HELD_OUT, CUT = (4, 2), 0.3          # crc32 of doc_id modulo 4 is 2; label 1 from this score on
RIDGE, STEPS, RATE = 5e-4, 400, 0.05
_BLOCK = 1 << 14                     # cells of a summed block
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not chr(c).isalnum()]] = 32
_SLICE = 1 << 16


def cells(text: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed n-grams of one text's bytes, piece by piece."""
    text = _FOLD[text]
    for at in range(0, len(text), _SLICE):
        piece = text[at:at + _SLICE + max(SIZES) - 1].astype(np.uint64)
        for n in SIZES:
            h = gram_hashes(piece, n)[:_SLICE]
            if len(h):
                yield (h >> np.uint64(64 - BITS)).astype(np.int64)


def _present(text: np.ndarray, stamp: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """The different cells of a text, or those of them that are wanted."""
    found = []
    for h in cells(text):
        if wanted is not None:
            h = h[wanted[h]]
        if len(h):
            stamp[h] = np.arange(len(h))
            found.append(h[stamp[h] == np.arange(len(h))])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _texts(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    data, starts, lengths = buffer_of(b.column("text"))
    for s, n in zip(starts.tolist(), lengths.tolist(), strict=True):
        yield data[s:s + n]


def class_counts(docs: DataFrame, known: DataFrame) -> np.ndarray:
    """(2, cells): labelled documents of each class that hold each cell; the last cell more is the number of documents."""
    size = 1 << BITS

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, stamp = np.zeros((2, size), np.int64), np.zeros(size, np.int64)
        for b in rows:
            for text, y in zip(_texts(b), b.column("y").to_numpy().tolist(), strict=True):
                total[y, _present(text, stamp)] += 1
        for y in (0, 1):
            for at in range(0, size, _BLOCK):
                if (part := total[y, at:at + _BLOCK]).any():
                    yield pa.RecordBatch.from_pydict({"block": pa.array([y * size + at], pa.int64()), "n": pa.array([part.astype("<i4").tobytes()], pa.binary())})

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for b in rows:
            for block, n in zip(b.column("block").to_pylist(), b.column("n").to_pylist(), strict=True):
                if block != now:
                    if now is not None:
                        yield pa.RecordBatch.from_pydict({"block": pa.array([now]), "n": pa.array([total.tobytes()], pa.binary())})
                    now, total = block, np.zeros(_BLOCK, np.int64)
                total += np.frombuffer(n, "<i4")
        if now is not None:
            yield pa.RecordBatch.from_pydict({"block": pa.array([now]), "n": pa.array([total.tobytes()], pa.binary())})

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(known.hint("merge"), "doc_id").select("text", "y")         # labels grow with the documents: shuffled at every size
    parts = rows.mapInArrow(count, "block bigint, n binary")
    out = np.zeros(2 * size, np.int64)
    for r in parts.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block bigint, n binary").collect():         # 2 ** BITS cells, whatever the input
        out[r["block"]:r["block"] + _BLOCK] = np.frombuffer(r["n"], np.int64)
    return out.reshape(2, size)


def ridge_logistic(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of a weighted logistic regression on lists of (already scaled) features: rows[i] = (index, value)."""
    idx = np.concatenate([r[0] for r in rows])
    val = np.concatenate([r[1] for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    w, b = np.zeros(size), float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
    weight = weight / weight.sum()
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, STEPS + 1):
        z = np.bincount(doc, w[idx] * val, len(rows)) + b
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g, gb = np.bincount(idx, d[doc] * val, size) + RIDGE * w, d.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        b -= RATE * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    return w, b


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """(weight of each cell, intercept): the scaled regression folded into one weight a cell."""
    known = learnable(labels, "toxic", *HELD_OUT)
    sizes = {r["y"]: r["n"] for r in known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("y").agg(F.count("*").alias("n")).collect()}
    weights = np.zeros(1 << BITS, np.float32)
    if len(sizes) < 2:
        share = float(min(max(sizes.get(1, 0) / max(1, sum(sizes.values())), 1e-9), 1 - 1e-9))
        return weights, float(np.log(share / (1 - share)))
    counts = class_counts(docs, known)
    p0, p1 = (counts[0] + 1) / (sizes[0] + 2), (counts[1] + 1) / (sizes[1] + 2)
    ratio = np.log(p1 / p0)
    chosen = np.sort(np.argsort(-np.abs((p1 - p0) * ratio), kind="stable")[:FEATURES])
    chosen = chosen[counts[:, chosen].sum(0) > 0]
    wanted = np.zeros(1 << BITS, bool)
    wanted[chosen] = True
    model = docs.sparkSession.sparkContext.broadcast(wanted)

    def features(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, stamp = model.value, np.zeros(1 << BITS, np.int64)
        for b in rows:
            x = [_present(text, stamp, wanted).astype("<i4").tobytes() for text in _texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("weight"), pa.array(x, pa.binary())], ["doc_id", "y", "weight", "x"])

    sample = bounded(known, SAMPLE, "toxicity")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(sample), "doc_id")               # the sample's size is bounded
    got = rows.select("doc_id", "y", "weight", "text").mapInArrow(features, "doc_id bigint, y int, weight double, x binary").toPandas().sort_values(["doc_id", "x"], kind="stable")
    place = np.zeros(1 << BITS, np.int64)
    place[chosen] = np.arange(len(chosen))
    scale = ratio[chosen]
    lists = []
    for x in got["x"]:
        i = place[np.frombuffer(x, "<i4")]
        lists.append((i, scale[i]))
    if not len(lists):
        return weights, float(np.log(sizes[1] / sizes[0]))
    w, b = ridge_logistic(lists, got["y"].to_numpy(float), got["weight"].to_numpy(float), len(chosen))
    weights[chosen] = w * scale
    return weights, b


def score(docs: DataFrame, weights: np.ndarray, intercept: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    model = docs.sparkSession.sparkContext.broadcast(weights)               # 2 ** BITS numbers

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, stamp = model.value, np.zeros(1 << BITS, np.int64)
        wanted = w != 0
        for b in rows:
            z = np.array([w[_present(text, stamp, wanted)].sum(dtype=np.float64) + intercept for text in _texts(b)])
            s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return (docs.select("doc_id", held_out(*HELD_OUT).alias("held_out"), F.col("text").cast("binary").alias("text"))
            .mapInArrow(task, "doc_id bigint, held_out boolean, score double, predicted int"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    return score(docs, *fit(docs, labels))
