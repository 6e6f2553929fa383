"""SimHash near-dedup by a binary trie self-join.

Fingerprint: lower-cased A-Z, words are runs of bytes other than ASCII white space, shingles of three words joined by a space (fewer words: the
whole sequence; none: fingerprint zero), repeats included; a bit is set if it is set in over half of the shingles' XXH64 (seed 42).
Fingerprints link at two or fewer differing bits.

Join: two fingerprints with at most `errors` differing bits agree in one of errors + 1 blocks of bits.  Rotated so that this block comes first,
both lie below one trie node of that depth.  Spark gathers the distinct fingerprints of each such node; a task walks pairs of nodes below it
together, adds up differing bits and drops a pair of nodes when the budget is spent.  A node that holds more than `LIMIT` fingerprints is opened
by Spark first, `OPEN` bits at a time, into the pairs of its descendants within the budget, until every pair is small; nothing is capped, and a
fingerprint takes part in a bounded number of pairs.  Tasks return a spanning forest of the links they find, not all pairs.

Null or empty text: fingerprint zero, linked like any other.  Copies of a text share a fingerprint and so a component.  Repeated rows
each get a row.  A null doc_id comes before all others in a component (its component_id is then null).  Extra columns are not looked
at.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm import words
from wattline.llm.base import buffer_of, id_of, row_key, shown_id, staged, text_input, without
from wattline.llm.components import components

SEED, SHINGLE, ERRORS = 42, 3, 2
LIMIT = 512                          # fingerprints below a pair of trie nodes that one task walks
OPEN = 8                             # bits by which Spark opens a larger pair
_CHUNK = 1 << 15                     # fingerprints that a task walks at once
_LOWER = words.lower_ascii()
_SPREAD = np.array([sum(((i >> b) & 1) << (8 * b) for b in range(8)) for i in range(256)], np.uint64)


def _majority(h: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Majority bits of h[first : first + count], text by text (count over 0)."""
    out = np.zeros(len(count), np.uint64)
    parts = (count + 254) // 255                         # byte lanes hold sums of up to 255
    seg = np.repeat(np.arange(len(count)), parts)
    at = first[seg] + 255 * (np.arange(len(seg)) - (np.cumsum(parts) - parts)[seg])
    head = np.cumsum(parts) - parts
    lanes = h.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        sums = np.add.reduceat(_SPREAD[lanes[:, byte]], at).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(sums.astype(np.int64), head, axis=0)
        bits = (2 * ones > count[:, None]).astype(np.uint64) << np.arange(8, dtype=np.uint64)
        out |= bits.sum(1, dtype=np.uint64) << np.uint64(8 * byte)
    return out


def fingerprint_buffer(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprint of each text of a byte buffer."""
    first, end, text = words.spans(data, starts, lengths)
    out = np.zeros(len(starts), np.uint64)
    if not len(first):
        return out
    n = np.bincount(text, minlength=len(starts))
    # words laid out with one space after each
    size = end - first
    place = np.cumsum(size + 1) - (size + 1)
    flat = np.full(int(place[-1] + size[-1] + 1), 0x20, np.uint8)
    ink = np.repeat(place - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    flat[ink] = _LOWER[data[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(ink))]]
    raw = flat.tobytes()
    shingles = np.where(n == 0, 0, np.maximum(n - shingle + 1, 1))
    base = np.repeat(np.cumsum(n) - n, shingles) + np.arange(int(shingles.sum())) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = np.minimum(base + shingle - 1, np.repeat(np.cumsum(n) - 1, shingles))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b], seed) for a, b in zip(place[base].tolist(), (place[last] + size[last]).tolist(), strict=True)), np.uint64, len(base))
    full = np.flatnonzero(n)
    out[full] = _majority(h, (np.cumsum(shingles) - shingles)[full], shingles[full])
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row, fp): the 64 bits as a long; doc_id null is base.NO_ID."""
    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(fingerprint_buffer(*buffer_of(b.column("text"))).view(np.int64))], ["doc_id", "row", "fp"])

    return text_input(docs).mapInArrow(task, "doc_id bigint, row bigint, fp bigint")


def _blocks(errors: int) -> list[tuple[int, int]]:
    """(first bit from the top, bits) of errors + 1 blocks of 64 bits."""
    edge = [round(64 * i / (errors + 1)) for i in range(errors + 2)]
    return [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


def walk(bits: np.ndarray, lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray, budget: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Trie self-join: pairs (i, j) of the sorted `bits` within the budget, below the node pairs [lo, hi) x [lo2, hi2) of the given depth."""
    err = np.zeros(len(lo), np.int64)
    left, right = [], []
    for level in range(depth, 65):
        own = lo == lo2
        leaf = (hi - lo == 1) & (hi2 - lo2 == 1)
        if leaf.any():                                   # one fingerprint on each side: the rest of the bits at once
            i, j = lo[leaf & ~own], lo2[leaf & ~own]
            ok = np.bitwise_count(bits[i] ^ bits[j]) <= budget
            left.append(i[ok])
            right.append(j[ok])
            lo, hi, lo2, hi2, err, own = (x[~leaf] for x in (lo, hi, lo2, hi2, err, own))
        if not len(lo) or level == 64:
            break
        zero = np.concatenate(([0], np.cumsum((bits >> np.uint64(63 - level)) & np.uint64(1) == 0)))
        mid, mid2 = lo + zero[hi] - zero[lo], lo2 + zero[hi2] - zero[lo2]
        kids = [(lo, mid, lo2, mid2, err), (mid, hi, mid2, hi2, err), (lo, mid, mid2, hi2, err + 1), tuple(x[~own] for x in (mid, hi, lo2, mid2, err + 1))]
        lo, hi, lo2, hi2, err = (np.concatenate(x) for x in zip(*kids, strict=True))
        ok = (hi > lo) & (hi2 > lo2) & (err <= budget)
        lo, hi, lo2, hi2, err = (x[ok] for x in (lo, hi, lo2, hi2, err))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of 0 .. n - 1 over links (i, j)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while (nxt := root[root]).tolist() != root.tolist():
            root = nxt
        more = root[i] != root[j]
        i, j = i[more], j[more]
    return root


def _walk_nodes(errors: int):
    """Rows (block, depth, u, v, side, fp) sorted by the first four: walk each pair of nodes and return links of a spanning forest."""
    def links(block, depth, u, v, side, fp) -> pa.RecordBatch | None:
        group = np.concatenate(([True], (block[1:] != block[:-1]) | (depth[1:] != depth[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1])))
        at = np.flatnonzero(group)
        n = np.diff(np.append(at, len(fp)))
        keep = (n > 1)[np.cumsum(group) - 1]
        if not keep.any():
            return None
        block, u, v, depth, side, fp, gid = (x[keep] for x in (block, u, v, depth, side, fp, np.cumsum(group)))
        start = np.array([a for a, _ in _blocks(errors)], np.uint64)[block]
        turned = (fp << start) | np.where(start > 0, fp >> ((np.uint64(64) - start) & np.uint64(63)), np.uint64(0))
        order = np.lexsort((turned, side, gid))
        gid, side, turned, fp, block, depth, u, v = (x[order] for x in (gid, side, turned, fp, block, depth, u, v))
        # sides of a group: [lo, mid) and [mid, hi); an unopened node pairs with itself
        at = np.flatnonzero(np.concatenate(([True], gid[1:] != gid[:-1])))
        end = np.append(at[1:], len(gid))
        mid = at + np.add.reduceat(side == 0, at)
        same = u[at] == v[at]
        lo2, hi2 = np.where(same, at, mid), end
        hi = np.where(same, end, mid)
        found = []
        for d in np.unique(depth[at]).tolist():
            g = (depth[at] == d) & (hi > at) & (hi2 > lo2)
            found.append(walk(turned, at[g], hi[g], lo2[g], hi2[g], errors, d if same[g].all() else 0))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        ok = np.bitwise_count(fp[i] ^ fp[j]) <= errors
        i, j = i[ok], j[ok]
        root = forest(len(fp), i, j)
        more = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[more].view(np.int64)), pa.array(fp[root[more]].view(np.int64))], ["a", "b"]) if len(more) else None

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def cut(last: bool):
            nonlocal held, size
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            if last:
                end = len(cols[0])
            else:                                        # the last group may go on in the next batch
                same = np.logical_and.reduce([c == c[-1] for c in cols[:4]])
                end = len(same) - int(same.sum())
            out = links(*(c[:end] for c in cols)) if end else None
            held, size = [[c[end:] for c in cols]], len(cols[0]) - end
            return out

        for b in rows:
            c = [b.column(i).to_numpy() for i in range(6)]
            c[5] = c[5].view(np.uint64)
            held.append(c)
            size += len(c[0])
            if size >= _CHUNK and (out := cut(False)) is not None:
                yield out
        if held and (out := cut(True)) is not None:
            yield out

    return task


def fingerprint_links(fps: DataFrame, errors: int = ERRORS) -> DataFrame:
    """(a, b): links whose components are those of all pairs of the distinct longs `fp` within `errors` differing bits."""
    fp, blocks = F.col("fp"), _blocks(errors)

    def bits(block: int, first: int, n: int):
        """n bits of the fingerprint turned so that the block comes first, from the given bit on."""
        start = blocks[block][0]
        turned = fp if start == 0 else F.shiftleft(fp, start).bitwiseOR(F.shiftrightunsigned(fp, 64 - start))
        return F.shiftrightunsigned(F.shiftleft(turned, first), 64 - n) if n else F.lit(0).cast("long")

    rows = None
    for k, (_, n) in enumerate(blocks):
        r = fps.select(F.lit(k).alias("block"), bits(k, 0, n).alias("u"), bits(k, 0, n).alias("v"), F.lit(n).alias("depth"), F.lit(0).alias("side"), F.lit(errors).alias("spare"), "fp")
        rows = r if rows is None else rows.unionByName(r)
    pair, ready = ["block", "depth", "u", "v"], None
    while True:
        sizes = rows.groupBy(*pair).agg(F.count("*").alias("n")).where(F.col("n") > LIMIT)
        large = staged(sizes.drop("n"))
        if large.isEmpty():
            ready = rows if ready is None else ready.unionByName(rows)
            break
        small = rows.join(large, pair, "left_anti")
        ready = small if ready is None else ready.unionByName(small)
        hot = rows.join(large, pair, "left_semi")
        opened = None
        for k in range(len(blocks)):
            for depth in range(blocks[k][1], 64, OPEN):
                n = min(OPEN, 64 - depth)
                masks = F.array(*[F.lit(m).cast("long") for m in range(1 << n) if m.bit_count() <= errors])
                own = bits(k, depth, n)
                p = (hot.where((F.col("block") == k) & (F.col("depth") == depth)).withColumn("mask", F.explode(masks)).withColumn("spare", F.col("spare") - F.bit_count("mask").cast("int"))
                     .where("spare >= 0").withColumn("own", own).withColumn("other", own.bitwiseXOR(F.col("mask"))))
                same, zero = F.col("u") == F.col("v"), F.col("side") == 0
                first = F.when(same, F.least("own", "other")).when(zero, F.col("own")).otherwise(F.col("other"))
                second = F.when(same, F.greatest("own", "other")).when(zero, F.col("other")).otherwise(F.col("own"))
                p = p.select("block", F.shiftleft("u", n).bitwiseOR(first).alias("u"), F.shiftleft("v", n).bitwiseOR(second).alias("v"), F.lit(depth + n).alias("depth"),
                             F.when(same & (F.col("own") > F.col("other")), 1).when(same, 0).otherwise(F.col("side")).alias("side"), "spare", "fp")
                opened = p if opened is None else opened.unionByName(p)
        rows = staged(opened)
    sent = ready.select(*pair, "side", "fp").repartition(*pair).sortWithinPartitions(*pair)
    return sent.mapInArrow(_walk_nodes(errors), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, errors: int = ERRORS) -> DataFrame:
    """(doc_id, row, fp, component_id, component_row): one row for each row of docs, with the first document of its component; ids may be base.NO_ID."""
    marked = staged(fingerprints(docs))
    distinct = marked.groupBy("fp").agg(F.min(F.struct("doc_id", "row")).alias("least"))
    group = components(fingerprint_links(distinct.select("fp"), errors)).withColumnRenamed("node", "fp")
    grouped = distinct.join(group, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("least").alias("first"))
    ids = grouped.join(least, "component").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("component_row"))
    return marked.join(ids, "fp").select("doc_id", "row", "fp", "component_id", "component_row")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return near_duplicates(docs).select(shown_id("doc_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), shown_id("component_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the smallest doc_id (null before all), of one doc_id the text with the smallest hash, and of rows that
    repeat doc_id and text the least by all columns.  Documents without words are near each other like any others."""
    documents = staged(near_duplicates(docs).groupBy("doc_id", "row").agg(F.count("*").alias("n"), F.first("component_id").alias("component_id"), F.first("component_row").alias("component_row")))
    first = (F.col("doc_id") == F.col("component_id")) & (F.col("row") == F.col("component_row"))
    rest = without(docs, documents.where(~first))
    repeated = documents.where(first & (F.col("n") > 1))
    if repeated.isEmpty():
        return rest
    one = without(rest, repeated, "left_semi").groupBy(id_of("doc_id"), row_key()).agg(F.min(F.struct(*docs.columns)).alias("kept"))
    return without(rest, repeated).unionByName(one.select("kept.*"))
