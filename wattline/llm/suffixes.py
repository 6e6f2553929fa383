"""Suffix-array dedup by column-wise construction of a collection's Burrows-Wheeler transform and common prefixes.

Texts are UTF-8 bytes.  A byte is removed if a string of `window` bytes covers it that also starts earlier (smaller doc_id, or earlier in the
same document).  Spark brings together the pieces of text that may hold equal strings (`repeats`: pieces with one anchor, a bounded number a
task).  For the pieces of a task, the transform is built column by column, from the last symbol of every piece to the first: each round puts
one symbol of every piece that still has one into the transform, at the place that the transform so far gives for it, and updates the common
prefixes of the neighbours.  Each round reads the files of the last round from start to end and writes new ones.  Neighbouring suffixes that
share a window's length are equal strings.

A symbol is a block of `BLOCK` bytes, so a window is exactly window / BLOCK symbols, and each piece enters as BLOCK sequences, one for each
shift; all byte positions are suffixes.  Blocks are named by a 64-bit hash and ranked within the task; equal neighbours are then compared
byte by byte, so names that clash can't remove anything.

Null or empty text, or one shorter than a window: nothing removed.  Rows with equal doc_id and equal text are one document, no copies of each other;
rows with one doc_id and different texts are different documents, in the order of their texts' hashes.  So are rows with a null doc_id, which come
before all others and stay null.  Columns other than doc_id and text are not looked at.
An empty table gives an empty result.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.anchors import gram_hashes, mix64
from wattline.llm.base import buffer_of, shown_id, text_input
from wattline.llm.repeats import Plan, covered

WINDOW, ANCHOR, BLOCK = 100, 32, 10
_END = np.int32(2**31 - 1)           # before the first symbol of a sequence
_LOW = np.uint64(2**32 - 1)


class Generation:
    """Transform and common prefixes after a round, as two sequential files."""

    def __init__(self, folder: str):
        self.at = [Path(folder, "bwt"), Path(folder, "lcp")]

    def write(self, bwt: np.ndarray, lcp: np.ndarray) -> None:
        bwt.tofile(self.at[0])
        lcp.tofile(self.at[1])

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        return np.fromfile(self.at[0], np.int32), np.fromfile(self.at[1], np.uint8)


class _Minimum:
    """Minimum of values[a + 1 .. b] for many (a, b) at once, from minima of runs of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray, longest: int):
        self.levels = [values]
        width = 1
        while width * 2 <= longest:
            cur = self.levels[-1].copy()
            np.minimum(cur[:-width], cur[width:], out=cur[:-width])
            self.levels.append(cur)
            width *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.uint8)
        for k in np.unique(level).tolist():
            at = level == k
            t = self.levels[k]
            out[at] = np.minimum(t[a[at] + 1], t[b[at] - (1 << k) + 1])
        return out


def transform(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order of a collection of sequences symbols[starts + 0 .. lengths - 1] (ranks, int32), all of at most 254 symbols.

    Returns (sequence, place, lcp) row by row without the empty suffixes: lcp is the common prefix with the row above, 0 for the first."""
    m, shift = len(starts), np.uint64(32)
    file = Generation(folder)
    file.write(symbols[starts + lengths - 1], np.zeros(m, np.uint8))
    row, seq = np.arange(m), np.arange(m)                       # rows of the longest suffixes so far, ascending, and their sequences
    for j in range(1, int(lengths.max()) + 1):
        bwt, lcp = file.read()
        more = lengths[seq] >= j
        row, seq = row[more], seq[more]
        order = _steps(bwt)
        mine = (bwt[row].astype(np.uint64) << shift) | row.astype(np.uint64)
        by = np.argsort(mine)
        row, seq, mine = row[by], seq[by], mine[by]
        rank = np.searchsorted(order, mine)
        c = mine >> shift
        before, after = order[np.maximum(rank - 1, 0)], order[np.minimum(rank + 1, len(order) - 1)]
        up, down = (rank > 0) & (before >> shift == c), (rank < len(order) - 1) & (after >> shift == c)
        a, b = (before & _LOW).astype(np.int64), (after & _LOW).astype(np.int64)
        least = _Minimum(lcp, int(max((row - a)[up].max(initial=1), (b - row)[down].max(initial=1))))
        above, below = np.zeros(len(row), np.uint8), np.zeros(len(row), np.uint8)
        above[up] = least(a[up], row[up]) + 1
        below[down] = least(row[down], b[down]) + 1
        # the new rows and the old ones in one order; the empty suffixes stay on top
        at, n = rank + m, len(bwt) + len(row)
        old = np.ones(n, bool)
        old[at] = False
        t = lengths[seq] - j - 1
        new_bwt, new_lcp = np.empty(n, np.int32), np.empty(n, np.uint8)
        new_bwt[old], new_lcp[old] = bwt, lcp
        new_bwt[at] = np.where(t >= 0, symbols[starts[seq] + np.maximum(t, 0)], _END)
        inside = at + 1 < n
        new_lcp[at[inside] + 1] = below[inside]
        new_lcp[at] = above
        file.write(new_bwt, new_lcp)
        row = at
    # walk each sequence from its empty suffix to learn which suffix stands in which row
    bwt, lcp = file.read()
    step = np.empty(len(bwt), np.int64)
    order = (_steps(bwt) & _LOW).astype(np.int64)
    step[order] = np.arange(m, m + len(order))
    who, place = np.empty(len(bwt), np.int32), np.empty(len(bwt), np.int32)
    row, seq = np.arange(m), np.arange(m)
    for j in range(1, int(lengths.max()) + 1):
        more = lengths[seq] >= j
        row, seq = step[row[more]], seq[more]
        who[row], place[row] = seq, lengths[seq] - j
    return who[m:], place[m:], lcp[m:]


def _steps(bwt: np.ndarray) -> np.ndarray:
    """(symbol, row) of all rows that go on, sorted: the order of the suffixes that are one symbol longer."""
    order = bwt.astype(np.uint64)
    order <<= np.uint64(32)
    order |= np.arange(len(bwt), dtype=np.uint64)
    order.sort()
    return order[:np.searchsorted(order, np.uint64(int(_END) << 32))]


def equal_windows(pieces: list[bytes], counts: np.ndarray, window: int, block: int) -> np.ndarray:
    """For each of the counts[i] windows of piece i, piece by piece: a number that exactly the equal windows share."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(p) for p in pieces])
    begin = np.cumsum(size) - size
    names = gram_hashes(data.astype(np.uint64), block)
    names = np.unique(names, return_inverse=True)[1].astype(np.int32)
    shift = np.arange(block)
    piece, p = np.nonzero(counts[:, None] > shift[None, :])
    windows = (counts[piece] - p + block - 1) // block
    lengths = windows + window // block - 1
    # a sequence takes every block-th name of its piece
    total = np.cumsum(lengths) - lengths
    seq = np.repeat(np.arange(len(lengths)), lengths)
    symbols = names[(begin[piece] + p)[seq] + block * (np.arange(len(seq)) - total[seq])]
    with tempfile.TemporaryDirectory() as folder:
        who, place, lcp = transform(symbols, total, lengths, folder)
    full = place < windows[who]
    same = lcp >= window // block                            # rows between full suffixes are full too where this holds
    at = begin[piece[who]] + p[who] + block * place          # first byte of the row's suffix
    check = np.flatnonzero(same)
    for i in range(0, len(check), 1 << 14):                  # compare with the row above, byte by byte
        x = check[i:i + (1 << 14)]
        same[x] = (np.lib.stride_tricks.sliding_window_view(data, window)[at[x]] == np.lib.stride_tricks.sliding_window_view(data, window)[at[x - 1]]).all(1)
    cls = np.cumsum(~same)
    out = np.empty(int(counts.sum()), np.int64)
    base = np.cumsum(counts) - counts
    out[(base[piece[who]] + p[who] + block * place)[full]] = cls[full]
    return out


def _plan(window: int, anchor: int, block: int) -> Plan:
    def units(b: pa.RecordBatch):
        return (b.column("doc_id").to_numpy(), *buffer_of(b.column("text")))

    def payload(symbols: np.ndarray, first: int, count: int) -> bytes:
        return symbols[first:first + count + window - 1].tobytes()

    def hashes(piece: bytes, count: int):
        x = np.frombuffer(piece, np.uint8).astype(np.uint64)
        return gram_hashes(x, window), mix64(gram_hashes(x, window, np.uint64(0xC2B2AE3D27D4EB4F)))

    return Plan(window, anchor, units, payload, lambda pieces, counts: equal_windows(pieces, counts, window, block), hashes, False)


def byte_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, block: int = BLOCK) -> DataFrame:
    """(doc_id, row, start, n): the byte strings of `window` bytes at start .. start + n - 1 of a document also start earlier."""
    if window % block or window < block:
        raise ValueError("the window must be a whole number of blocks")
    texts = text_input(docs)
    size = texts.select(F.sum(F.octet_length("text"))).first()[0] or 0
    return covered(texts, _plan(window, anchor, block), size)


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary): one row for each row of docs."""
    spans = (byte_windows(docs, window, anchor, block).groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
             .select("doc_id", "row", "spans.start", "spans.n"))

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            data, starts, lengths = buffer_of(b.column("text"))
            removed, runs, kept = [], [], []
            for i, (s, m) in enumerate(zip(b.column("start").to_pylist(), b.column("n").to_pylist(), strict=True)):
                text = data[starts[i]:starts[i] + lengths[i]]
                if not s:
                    removed.append(0)
                    runs.append(0)
                    kept.append(text.tobytes())
                    continue
                edge = np.zeros(len(text) + 1, np.int32)
                np.add.at(edge, np.minimum(s, len(text)), 1)
                np.add.at(edge, np.minimum(np.add(s, m) + window - 1, len(text)), -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(text[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = text_input(docs).join(spans, ["doc_id", "row"], "left").select("doc_id", "text", "start", "n")
    out = joined.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.withColumn("doc_id", shown_id("doc_id"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of `remove_repeats`."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The same question for DuckDB: all byte strings of a window's length, as hexadecimal text, ranked by place.
SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (
    SELECT doc_id, unnest(range(1, len(h) // 2 - 98)) AS i, unnest(list_transform(range(1, len(h) // 2 - 98), lambda i: md5(substring(h, 2 * i - 1, 200)))) AS g
    FROM d WHERE len(h) >= 200),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM s),
e AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM f WHERE k > 1),
c AS (SELECT doc_id, i, CASE WHEN step IS NULL OR step > 100 THEN 1 ELSE 0 END AS fresh, sum(CASE WHEN step IS NULL OR step > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
z AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM c GROUP BY doc_id, run),
p AS (
    SELECT doc_id, string_agg(substring(h, 2 * lo - 1, 2 * (a - lo)), '' ORDER BY a) || substring(any_value(h), 2 * max(b) - 1) AS kept, sum(b - a) AS n_removed, count(*) AS n_spans
    FROM (SELECT z.doc_id, h, a, b, coalesce(lag(b) OVER (PARTITION BY z.doc_id ORDER BY a), 1) AS lo FROM z JOIN d ON d.doc_id = z.doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN p USING (doc_id)
"""
