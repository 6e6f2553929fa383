"""Windows of symbols that occur more than once, over all documents: the exchange that the two substring operators share.

Windows are handled as runs that share an anchor (`anchors.runs`); equal windows have equal anchors.

1. A count-min sketch of the anchors (`sketch`): a window's estimate is its anchor's, never below its true count.
2. A second pass over the texts sends only runs whose anchor is estimated repeated.  Each task first folds runs of equal content and keeps the
   earliest, so a boilerplate line costs one row a task; every later copy is known to be covered already there.
3. Spark gathers the runs of an anchor, sorted; each task streams through them with a bounded buffer, drops copies of equal content (payloads are compared), and
   hands the different runs of an anchor to the operator's kernel, which finds equal windows.
4. An anchor with more than `LIMIT` different runs is taken apart into windows, which Spark groups by their hash with partial aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm import sketch
from wattline.llm.anchors import mix64, runs
from wattline.llm.base import staged

LIMIT = 8192                         # different runs of one anchor that a task takes together
CHUNK = 1 << 20                      # payload bytes that a task gathers before it calls the kernel
_HELD = 50_000                       # different runs that a map task holds before it lets go
COPY, WINDOW, RUN = 0, 1, 2          # kinds of rows: known covered span, single window of a hot anchor, run to compare

_FIELDS = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("c1", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()),
                     ("n", pa.int32()), ("payload", pa.binary())])
_DDL = "kind tinyint, key bigint, c1 bigint, doc_id bigint, row bigint, start bigint, n int, payload binary"


@dataclass
class Plan:
    """window, k: symbols of a window and of its anchor.  units(batch) -> (doc ids, symbols, starts, lengths).
    payload(symbols, first, count) -> bytes that the kernel needs of a run.
    classes(payloads, counts) -> for each window of the runs, run by run, a number that only equal windows share.
    hashes(payload, count) -> two 64-bit hashes of each window of a run.
    every: report all copies of a repeated window; otherwise all but the earliest."""

    window: int
    k: int
    units: Callable
    payload: Callable
    classes: Callable
    hashes: Callable
    every: bool


def _spans(doc: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray):
    """Merge window-start intervals [start, start + n) of equal documents that touch."""
    order = np.lexsort((start, row, doc))
    doc, row, start, end = doc[order], row[order], start[order], (start + n)[order]
    if not len(doc):
        return doc, row, start, end
    fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])))
    base = np.cumsum(fresh) * (1 << 40)                      # running maximum of ends, document by document
    reach = np.maximum.accumulate(end + base) - base
    fresh[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return doc[at], row[at], start[at], np.maximum.reduceat(end, at) - start[at]


def _rows(kind, key, c1, doc, row, start, n, payload=None) -> pa.RecordBatch:
    m = len(doc)
    key, c1 = (np.asarray(x).view(np.int64) if np.asarray(x).dtype == np.uint64 else np.asarray(x, np.int64) for x in (key, c1))
    return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int8)), pa.array(key), pa.array(c1), *(pa.array(np.asarray(x, np.int64)) for x in (doc, row, start)),
                                       pa.array(np.asarray(n, np.int32)), pa.array(payload, pa.binary()) if payload is not None else pa.nulls(m, pa.binary())], schema=_FIELDS)


def _copies(doc, row, start, n) -> pa.RecordBatch:
    doc, row, start, n = _spans(*(np.asarray(x, np.int64) for x in (doc, row, start, n)))
    spread = mix64((doc ^ row).view(np.uint64) * np.uint64(31) + start.astype(np.uint64))       # deals them out evenly
    return _rows(COPY, spread, np.zeros(len(doc)), doc, row, start, n)


def _unfold(n: np.ndarray):
    """Row and place within the row of each of n[row] windows."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - (np.cumsum(n) - n)[row]


def _copied(cls: np.ndarray, doc: np.ndarray, docrow: np.ndarray, start: np.ndarray, every: bool) -> np.ndarray:
    """Which windows share their class with a window at another place: all of them, or those that are not the earliest."""
    order = np.lexsort((start, docrow, doc, cls))
    cls, doc, docrow, start = cls[order], doc[order], docrow[order], start[order]
    fresh = np.concatenate(([True], cls[1:] != cls[:-1]))
    at = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    elsewhere = (doc != doc[at][group]) | (docrow != docrow[at][group]) | (start != start[at][group])
    if every:
        elsewhere = np.logical_or.reduceat(elsewhere, at)[group] if len(at) else elsewhere
    return order[elsewhere]


def _send(plan: Plan, repeated: sketch.Repeated):
    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}

        def release():
            if not held:
                return
            digest = np.frombuffer(b"".join(held), "<u8").reshape(-1, 2)
            doc, row, start, n, key, payload = zip(*held.values(), strict=True)
            held.clear()
            size = 1 + len(doc) // 10_000
            for i in range(size):
                part = slice(i * len(doc) // size, (i + 1) * len(doc) // size)
                yield _rows(RUN, np.array(key[part], np.uint64), digest[part, 0], doc[part], row[part], start[part], n[part], list(payload[part]))

        for b in rows:
            ids, symbols, starts, lengths = plan.units(b)
            rowkeys = b.column("row").to_numpy()
            text, first, count, _, key = runs(symbols, plan.window, plan.k, starts, lengths)
            ok = repeated(key)
            text, first, count, key = text[ok], first[ok], count[ok], key[ok]
            raw, width = memoryview(np.ascontiguousarray(symbols)).cast("B"), symbols.itemsize
            late: list[tuple] = []
            clash: list[tuple] = []
            more = plan.window - 1
            for d, r, s, f, c, q in zip(ids[text].tolist(), rowkeys[text].tolist(), (first - starts[text]).tolist(), first.tolist(), count.tolist(), key.tolist(), strict=True):
                digest = xxhash.xxh3_128_digest(raw[f * width:(f + c + more) * width])
                got = held.get(digest)
                if got is None:
                    held[digest] = (d, r, s, c, q, plan.payload(symbols, f, c))
                elif (d, r, s) != got[:3]:
                    payload = plan.payload(symbols, f, c)
                    if payload != got[5]:                    # another content under one digest: sent as it is
                        clash.append((d, r, s, c, q, digest, payload))
                        continue
                    early, other = sorted(((d, r, s, c), got[:4]))
                    late.extend((early, other) if plan.every else (other,))
                    held[digest] = (*early, q, got[5])
            if late:
                yield _copies(*zip(*late, strict=True))
            for d, r, s, c, q, digest, payload in clash:
                yield _rows(RUN, np.array([q], np.uint64), np.frombuffer(digest, "<u8")[:1], [d], [r], [s], [c], [payload])
            if len(held) >= _HELD:
                yield from release()
        yield from release()

    return task


def _compare(plan: Plan):
    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list] = []          # complete groups waiting for the kernel: lists of (payload, n, doc, row, start)
        size = 0
        key, content, first, group, hot = None, None, None, [], False

        def windows(members):
            for i in range(0, len(members), 256):
                payload, n, doc, docrow, start = zip(*members[i:i + 256], strict=True)
                h1, h2 = (np.concatenate(x) for x in zip(*map(plan.hashes, payload, n), strict=True))
                row, place = _unfold(np.array(n))
                yield _rows(WINDOW, h2, h1, np.array(doc)[row], np.array(docrow)[row], np.array(start)[row] + place, np.ones(len(row)))

        def call():
            nonlocal groups, size
            if groups:
                payload, n, doc, docrow, start = zip(*(m for g in groups for m in g), strict=True)
                row, place = _unfold(np.array(n))
                doc, docrow, start = np.array(doc)[row], np.array(docrow)[row], np.array(start)[row] + place
                hit = _copied(plan.classes(payload, np.array(n)), doc, docrow, start, plan.every)
                if len(hit):
                    yield _copies(doc[hit], docrow[hit], start[hit], np.ones(len(hit)))
            groups, size = [], 0

        for b in rows:
            kind = b.column(0).to_numpy()
            copy = kind == COPY
            if copy.any():
                yield b.filter(pa.array(copy))
                b = b.filter(pa.array(~copy))
            late = []
            for q, c1, doc, row, start, n, payload in zip(*(b.column(i).to_pylist() for i in range(1, 8)), strict=True):
                if q != key:
                    if len(group) > 1 and not hot:
                        groups.append(group)
                        size += sum(len(m[0]) for m in group)
                        if size >= CHUNK:
                            yield from call()
                    elif hot:
                        yield from windows(group)
                    key, content, group, hot = q, None, [], False
                if (c1, payload) == content:
                    if (doc, row, start) != first:
                        late.append((doc, row, start, n))
                        if plan.every:
                            late.append((*first, n))
                    continue
                content, first = (c1, payload), (doc, row, start)
                group.append((payload, n, doc, row, start))
                if len(group) >= LIMIT:
                    hot = True
                    yield from windows(group)
                    group = []
            if late:
                yield _copies(*zip(*late, strict=True))
        if hot:
            yield from windows(group)
        elif len(group) > 1:
            groups.append(group)
        yield from call()

    return task


def covered(texts: DataFrame, plan: Plan, symbols: int) -> DataFrame:
    """(doc_id, row, start, n): the windows starting at start .. start + n - 1 of a document have another copy (every), or an earlier one.
    symbols: about how many there are; it only sets the size of the sketch.

    Rows may overlap.  Order is by (doc_id, row, start); rows with equal doc_id and row are one document."""
    anchors = 2 * symbols / (plan.window - plan.k + 2)

    def keys(b: pa.RecordBatch) -> np.ndarray:
        _, s, starts, lengths = plan.units(b)
        return runs(s, plan.window, plan.k, starts, lengths)[4]

    repeated = sketch.build(texts, keys, sketch.bits_for(anchors))
    sent = texts.mapInArrow(_send(plan, repeated), _DDL)
    order = ["key", "c1", "doc_id", "row", "start"]
    compared = staged(sent.repartition(F.col("key")).sortWithinPartitions(*order).mapInArrow(_compare(plan), _DDL).drop("payload"))
    spans = compared.where(F.col("kind") == COPY).select("doc_id", "row", "start", F.col("n").cast("long").alias("n"))
    window = compared.where(F.col("kind") == WINDOW)
    if window.isEmpty():
        return spans
    place = F.struct("doc_id", "row", "start")
    firsts = window.groupBy("key", "c1").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").drop("last")
    again = window.join(firsts, ["key", "c1"])
    again = again if plan.every else again.where(place > F.col("first"))
    return spans.unionByName(again.select("doc_id", "row", "start", F.lit(1).cast("long").alias("n")))
