"""Count-min sketch over 64-bit keys, built per partition, merged by Spark in blocks of cells.

Counts saturate at two: the question is only whether a key may occur again.  An estimate is never below the true count, so a filter on
"estimated twice" loses no repeated key.  The merged answer is one bit per cell; its size is set by `bits`, never by the data, and is the
only thing that is broadcast.  With more keys than cells the filter lets more single keys pass, and the exact pass after it does more work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.anchors import mix64

ROWS = 2
LEAST_BITS, MOST_BITS = 20, 27       # of cells in a row of the sketch: 128 KB to 16 MB as merged bits
_BLOCK = 16                          # cells per merged block, as bits
_FLUSH = 1 << 20                     # keys gathered before a partition's sketch is written out


def bits_for(keys: float) -> int:
    """Eight cells a key, within the fixed bounds of the broadcast."""
    return int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(max(keys, 1) * 8)))))


def _cells(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    shift = np.uint64(64 - bits)
    return [keys >> shift, mix64(keys + np.uint64(0xA0761D6478BD642F)) >> shift]


def _partial(keys: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    out: dict[str, list] = {"block": [], "once": [], "more": []}
    blocks = 1 << max(0, bits - _BLOCK)
    for row, cells in enumerate(_cells(np.concatenate(keys), bits)):
        cell, n = np.unique(cells.astype(np.uint32), return_counts=True)
        block = (cell >> np.uint32(_BLOCK)).astype(np.int64)
        low = (cell & np.uint32((1 << _BLOCK) - 1)).astype("<u2")
        at = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        for a, b in zip(at.tolist(), np.append(at[1:], len(cell)).tolist(), strict=True):
            part, many = low[a:b], n[a:b] > 1
            out["block"].append(row * blocks + int(block[a]))
            out["once"].append(part[~many].tobytes())
            out["more"].append(part[many].tobytes())
    yield pa.RecordBatch.from_pydict(out, pa.schema([("block", pa.int32()), ("once", pa.binary()), ("more", pa.binary())]))


def _merge(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: add the partial counts of a block and keep the cells that reach two."""
    now, count = None, None

    def done():
        return pa.RecordBatch.from_pydict({"block": [now], "bits": [np.packbits(count >= 2).tobytes()]}, pa.schema([("block", pa.int32()), ("bits", pa.binary())]))

    for b in groups:
        for block, once, more in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if block != now:
                if now is not None:
                    yield done()
                now, count = block, np.zeros(1 << _BLOCK, np.uint8)
            x = np.frombuffer(once, "<u2")
            count[x] = np.minimum(count[x] + 1, 2)
            count[np.frombuffer(more, "<u2")] = 2
    if now is not None:
        yield done()


class Repeated:
    """Which keys may occur twice; made by `build`, used inside tasks."""

    def __init__(self, bits: int, broadcast):
        self.bits, self.broadcast = bits, broadcast

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        table = self.broadcast.value
        ok = np.ones(len(keys), bool)
        for row, cells in enumerate(_cells(keys, self.bits)):
            c = cells.astype(np.int64)
            ok &= (table[row, c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
        return ok


def build(df: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> Repeated:
    """Sketch the keys that keys_of takes from each Arrow batch of df."""
    def partial(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in rows:
            held.append(keys_of(b))
            n += len(held[-1])
            if n >= _FLUSH:
                yield from _partial(held, bits)
                held, n = [], 0
        if n:
            yield from _partial(held, bits)

    parts = df.mapInArrow(partial, "block int, once binary, more binary")
    merged = (parts.repartition(F.col("block")).sortWithinPartitions("block").mapInArrow(_merge, "block int, bits binary"))
    blocks, size = 1 << max(0, bits - _BLOCK), 1 << (_BLOCK - 3)
    table = np.zeros((ROWS, blocks, size), np.uint8)
    for r in merged.collect():          # at most 2 ** bits cells, set by `bits` alone
        table[r["block"] // blocks, r["block"] % blocks] = np.frombuffer(r["bits"], np.uint8)
    return Repeated(bits, df.sparkSession.sparkContext.broadcast(table.reshape(ROWS, blocks * size)))
