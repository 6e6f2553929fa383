"""Language identification by a byte convolutional network, trained in numpy.

Text is cut into windows of `WINDOW` bytes.  Filters of several widths slide over a window's bytes (a filter is one weight for each byte value at
each place), each filter's largest response in the window, cut at zero, is a feature, and a softmax over the features gives the languages.
A document's probabilities are the mean over all windows of its whole text, weighted by their bytes.

Learned from text and lang of documents that are not held out: about `PER_LANGUAGE` documents of each language at most, chosen by a hash
of doc_id, `PER_DOCUMENT` windows of each, spread over its whole length; these bounds keep the driver's sample small at any input size.

Null text or text without a letter: `und`, score 0.  Rows with a null lang or null doc_id are never learned from; a null doc_id counts as held out.
No labelled row at all: everything is `und`.  Repeated rows each get a row.  lang, source and doc_id are never inputs of a prediction; other
columns are not looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.base import buffer_of

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 8
PER_LANGUAGE, PER_DOCUMENT = 1200, 4
EPOCHS, BATCH, RATE = 6, 128, 0.01
FLOOR = 1.1                         # of an even share of probability, below which a document's language counts as unknown
HELD_OUT = (5, 0)                    # crc32 of doc_id modulo 5 is 0
_TAIL = max(WIDTHS) - 1              # a filter at a window's last byte reads on
_ROWS = 96                           # windows handled at once, so that responses stay in cache


def held_out(modulus: int, rest: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest, F.lit(True))


@dataclass
class ByteConvNet:
    """tables: of each width, (width, 256, filters); softmax weights over the pooled features."""

    tables: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, classes: int, rng: np.random.Generator) -> ByteConvNet:
        return cls([rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
                   rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes)).astype(np.float32), np.zeros(classes, np.float32))

    def pairs(self) -> list[list[np.ndarray]]:
        """The tables as lookups by two bytes at once (and one, for an odd width)."""
        return [[(t[o][:, None] + t[o + 1][None, :]).reshape(65536, FILTERS) if o + 1 < len(t) else t[o] for o in range(0, len(t), 2)] for t in self.tables]

    @staticmethod
    def responses(x: np.ndarray, pairs: list[list[np.ndarray]]) -> list[np.ndarray]:
        """Filter responses (windows, places, filters) of windows x (windows, WINDOW + _TAIL) bytes."""
        two = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
        return [sum(t[(two if len(t) > 256 else x)[:, 2 * k:2 * k + WINDOW]] for k, t in enumerate(p)) for p in pairs]

    def features(self, x: np.ndarray, pairs) -> np.ndarray:
        out = []
        for r in self.responses(x, pairs):
            half = WINDOW
            while half > 1:                              # pooling by halves: long contiguous maxima
                half //= 2
                r = np.maximum(r[:, :half], r[:, half:2 * half])
            out.append(np.maximum(r[:, 0], 0))
        return np.concatenate(out, axis=1)

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.weights + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        params = [*self.tables, self.weights, self.bias]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                rows = order[at:at + BATCH]
                xb, n = x[rows], len(rows)
                raw = self.responses(xb, self.pairs())
                best = [r.argmax(1) for r in raw]
                top = [np.take_along_axis(r, b[:, None], 1)[:, 0] for r, b in zip(raw, best, strict=True)]
                f = np.maximum(np.concatenate(top, 1), 0)
                d = self.probabilities(f)
                d[np.arange(n), y[rows]] -= 1
                d /= n
                back = (d @ self.weights.T) * (f > 0)
                grads = []
                for k, table in enumerate(self.tables):
                    g = np.zeros_like(table)
                    own = back[:, k * FILTERS:(k + 1) * FILTERS]
                    for o in range(len(table)):
                        np.add.at(g[o], (xb[np.arange(n)[:, None], best[k] + o], np.arange(FILTERS)[None, :]), own)
                    grads.append(g)
                grads += [f.T @ d, d.sum(0)]
                t += 1
                for p, g, a, b in zip(params, grads, first, second, strict=True):
                    a *= 0.9
                    a += 0.1 * g
                    b *= 0.999
                    b += 0.001 * g * g
                    p -= (RATE / (1 - 0.9**t)) * a / (np.sqrt(b / (1 - 0.999**t)) + 1e-6)


def _cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Windows of bytes from `start` on, zero beyond `end`."""
    at = start[:, None] + np.arange(WINDOW + _TAIL)
    return np.where(at < end[:, None], data[np.minimum(at, len(data) - 1)], np.uint8(0))


def _sample(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, and the windows with their language numbers that training sees."""
    learn = docs.where(~held_out(*HELD_OUT) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.octet_length("text") > 0))
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(counts)
    if not names:
        return [], np.zeros((0, WINDOW + _TAIL), np.uint8), np.zeros(0, np.int64)
    share = F.element_at(F.create_map(*[F.lit(v) for n in names for v in (n, min(1.0, PER_LANGUAGE / counts[n]))]), F.col("lang"))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) < share * (1 << 30)

    def windows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            data, starts, lengths = buffer_of(b.column("text"))
            i = np.repeat(np.arange(len(starts)), PER_DOCUMENT)
            k = np.tile(np.arange(PER_DOCUMENT), len(starts))
            at = starts[i] + (np.maximum(lengths[i] - WINDOW, 0) * k) // max(1, PER_DOCUMENT - 1)
            keep = (k == 0) | (lengths[i] > WINDOW)
            x = _cut(data, at[keep], (starts + lengths)[i[keep]])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(i[keep])), b.column("lang").take(pa.array(i[keep])), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "lang", "x"])

    got = learn.where(chosen).select("doc_id", "lang", F.col("text").cast("binary").alias("text")).mapInArrow(windows, "doc_id bigint, lang string, x binary").toPandas()
    got = got.sort_values(["doc_id", "x"], kind="stable")
    return names, np.frombuffer(b"".join(got["x"]), np.uint8).reshape(-1, WINDOW + _TAIL), got["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(np.int64)


def fit(docs: DataFrame, seed: int = 8) -> tuple[list[str], ByteConvNet]:
    """(languages, network) learned from the documents that are not held out."""
    names, x, y = _sample(docs)
    rng = np.random.default_rng(seed)
    net = ByteConvNet.start(len(names), rng)
    if names:
        net.train(x, y, rng)
    return names, net


def _letters(text: bytes | None) -> bool:
    return text is not None and any(map(str.isalpha, text.decode("utf-8", "replace")))


def predict(docs: DataFrame, names: list[str], net: ByteConvNet, *more: Column, with_text: bool = False) -> DataFrame:
    """(doc_id, held_out, [text binary,] more..., lang_pred, score) of the whole text of each row."""
    model = docs.sparkSession.sparkContext.broadcast((names, net))             # its size is set by the constants above

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, net = model.value
        pairs = net.pairs()
        for b in rows:
            column = b.column("text")
            data, starts, lengths = buffer_of(column)
            total = np.zeros((len(starts), len(names)))
            if names and len(data):
                n = (lengths + WINDOW - 1) // WINDOW
                doc = np.repeat(np.arange(len(starts)), n)
                at = starts[doc] + WINDOW * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
                end = (starts + lengths)[doc]
                for i in range(0, len(doc), _ROWS):
                    s = slice(i, i + _ROWS)
                    p = net.probabilities(net.features(_cut(data, at[s], end[s]), pairs))
                    np.add.at(total, doc[s], p * np.minimum(end[s] - at[s], WINDOW)[:, None])
            known = np.array([_letters(t.as_py()) for t in column]) if names else np.zeros(len(starts), bool)
            p = total / np.maximum(lengths, 1)[:, None]
            best = p.argmax(1) if names else np.zeros(len(starts), np.int64)
            lang = [names[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
            score = np.where(known, p[np.arange(len(p)), best], 0.0) if names else np.zeros(len(starts))
            kept = [(n, c) for n, c in zip(b.schema.names, b.columns, strict=True) if with_text or n != "text"]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))], [n for n, _ in kept] + ["lang_pred", "score"])

    rows = docs.select("doc_id", held_out(*HELD_OUT).alias("held_out"), F.col("text").cast("binary").alias("text"), *more)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if with_text or f.name != "text")
    return rows.mapInArrow(task, f"{schema}, lang_pred string, score double")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return predict(docs, *fit(docs))


def known_language(docs: DataFrame) -> DataFrame:
    """docs without those whose language can't be told: null text, no letter in it, or one that the network gives every learned language less than
    `FLOOR` times an even share.  Where no language could be learned only the first two go.  Rows are judged one by one, so repeated rows, repeated or null
    ids and extra columns change nothing."""
    names, net = fit(docs)
    others = [c for c in docs.columns if c != "text"]
    out = predict(docs, names, net, *[F.col(c).alias(f"_{i}") for i, c in enumerate(others)], with_text=True)
    if names:
        known = out.where((F.col("lang_pred") != "und") & (F.col("score") >= (FLOOR / len(names) if len(names) > 1 else 0.0)))
    else:
        known = out.where(F.col("text").cast("string").rlike(r"\p{L}"))
    return known.select(*[F.col("text").cast("string").alias(c) if c == "text" else F.col(f"_{others.index(c)}").alias(c) for c in docs.columns])
