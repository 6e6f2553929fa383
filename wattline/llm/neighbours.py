"""Embedding near-dedup by NN-descent.

Vectors link at a cosine of `THRESHOLD` or more, in double precision.  Equal vectors are one node with a count.
1. Start: `TABLES` orders of the nodes by the signs of random projections, cut into blocks of `BLOCK` neighbours in that order (so a crowded
   code is many blocks); a block gives each node its nearest few.
2. Descent: each node is a pivot for its neighbours and those that list it; those are compared with each other, unless both were compared there
   before, and offered to each other if they are nearer than the farthest in the list.  A pivot with many such nodes is dealt over several
   groups, differently in each round.  Rounds go on until few lists change.
3. Audit: for `PROBES` nodes the links are counted against all nodes, in blocks.  If too few of them have been found, another round with new
   orders follows.
4. Lists whose farthest neighbour still links are saturated.  They are enlarged to all of their component: the members of a component
   are compared block by block, spread over tasks, and only counts of links leave a task.  Small components are one block.

Vectors that are null or zero or hold null or non-finite components link with nothing, and so do those with a null vec_id.  Shorter vectors count as
ending in zeros.  Rows that repeat a vec_id are one vector (the least in byte order).  Extra columns, labels too, are not looked at.  An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.base import staged
from wattline.llm.components import components

THRESHOLD = 0.9
LIST, TABLES, BLOCK, OFFER = 8, 8, 128, 4
PIVOT = 64                           # nodes that a group of a pivot compares
ROUNDS, ENOUGH = 4, 0.02             # of the descent at most; share of changed list entries at which it ends
PROBES, RECALL, TRIES = 256, 0.98, 3


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_group(keys: int, fn: Callable, schema: pa.Schema):
    """Task over rows sorted by their first `keys` columns: fn(key, rows of the key as a RecordBatch) -> tuple of arrays."""
    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(t: pa.RecordBatch):
            k = [t.column(i).to_numpy() for i in range(keys)]
            at = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in k]))))
            out = [r for a, b in zip(at.tolist(), [*at[1:].tolist(), t.num_rows], strict=True) if (r := fn(t.slice(a, b - a))) is not None]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

        held: list[pa.RecordBatch] = []
        for b in rows:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0]
            k = [t.column(i).to_numpy() for i in range(keys)]
            same = np.logical_and.reduce([c == c[-1] for c in k])
            end = t.num_rows - int(same.sum())
            if end:
                yield from run(t.slice(0, end))
            held = [t.slice(end)]
        if held:
            yield from run(held[0])

    return task


def _nodes(embeddings: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(vec_id, v) of all vectors, v null where it links with nothing; (id, v, n) of the different ones; dimension."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    dim = embeddings.agg(F.max(F.size("embedding"))).first()[0] or 0

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            out = []
            for v in b.column("x"):
                v = None if v.as_py() is None else np.array([np.nan if e is None else e for e in v.as_py()], np.float64)
                if v is None or not len(v) or not np.isfinite(v).all() or not 0 < float(np.linalg.norm(v)) < np.inf:
                    out.append(None)
                else:
                    out.append(np.concatenate((v + 0.0, np.zeros(dim - len(v)))).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "v"])

    every = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).mapInArrow(pack, "vec_id bigint, v binary")
    one = every.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v"))
    every = staged(one.unionByName(every.where("vec_id IS NULL").select("vec_id", F.lit(None).cast("binary").alias("v"))))
    nodes = staged(every.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).select("id", "v", "n"))
    return every, nodes, dim


_OFFERS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float64())])
_OFFER_DDL = "u bigint, v bigint, sim double"
_LINK = 2.0                          # sim of a row that only says that two nodes are in one component


def _chains(ids: np.ndarray, sim: np.ndarray, threshold: float):
    """Links that join what a block's links join: each node to the first one it links with."""
    first = (sim >= threshold).argmax(1)
    rows = np.flatnonzero((sim >= threshold).any(1))
    return ids[rows], ids[first[rows]], np.full(len(rows), _LINK)


def _start(nodes: DataFrame, dim: int, count: int, threshold: float, seed: int) -> DataFrame:
    bits = int(max(1, min(40, np.ceil(np.log2(max(2, count / 48))))))

    def turn(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        planes = rng.normal(size=(TABLES, bits + 1, dim))
        for b in rows:
            x = _matrix(b.column("v"), dim)
            for t in range(TABLES):
                p = x @ planes[t].T
                code = ((p[:, :bits] > 0) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code), pa.array(p[:, bits]), b.column("id"), b.column("v")], ["t", "code", "p", "id", "v"])

    def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(rows):
            x, ids, t = _matrix(b.column("v"), dim), b.column("id").to_numpy(), b.column("t").to_numpy()
            sim = np.where(t[:, None] == t[None, :], x @ x.T, -2)
            np.fill_diagonal(sim, -2)
            m = min(OFFER, len(ids) - 1)
            if m > 0:
                near = np.argpartition(-sim, m - 1, axis=1)[:, :m]
                u, v, s = np.repeat(ids, m), ids[near].ravel(), np.take_along_axis(sim, near, 1).ravel()
                ok = s > -2
                c = _chains(ids, sim, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip((u[ok], v[ok], s[ok]), c, strict=True)], schema=_OFFERS)

    turned = nodes.select("id", "v").mapInArrow(turn, "t int, code bigint, p double, id bigint, v binary")
    return turned.repartitionByRange("t", "code", "p").sortWithinPartitions("t", "code", "p", "id").mapInArrow(compare, _OFFER_DDL)


def _blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for b in rows:
        t = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0] if held.num_rows + b.num_rows else b
        end = t.num_rows // BLOCK * BLOCK
        for at in range(0, end, BLOCK):
            yield t.slice(at, BLOCK)
        held = t.slice(end)
    if held is not None and held.num_rows:
        yield held


def _shorten(offers: DataFrame, before: DataFrame | None) -> DataFrame:
    """(u, v, sim, fresh) of the nearest LIST of each node, from offers and the lists before."""
    rows = offers.where(F.col("sim") < _LINK).select("u", "v", "sim", F.lit(1).alias("fresh"))
    if before is not None:
        rows = rows.unionByName(before.select("u", "v", "sim", F.lit(0).alias("fresh")))
    one = rows.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    kept = one.groupBy("u").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "v", "fresh")), asc=False), 1, LIST).alias("list"))
    return kept.select("u", F.explode("list").alias("e")).select("u", "e.v", "e.sim", "e.fresh")


def _descend(lists: DataFrame, nodes: DataFrame, dim: int, turn: int) -> DataFrame:
    """Offers from comparing the neighbours of each node."""
    reach = lists.groupBy("u").agg(F.when(F.count("*") >= LIST, F.min("sim")).otherwise(F.lit(-2.0)).alias("far"))
    both = lists.select(F.col("u").alias("pivot"), F.col("v").alias("id"), "fresh").unionByName(lists.select(F.col("v").alias("pivot"), F.col("u").alias("id"), "fresh"))
    both = both.groupBy("pivot", "id").agg(F.max("fresh").alias("fresh"))
    groups = both.groupBy("pivot").agg(F.ceil(F.count("*") / PIVOT).alias("groups")).where("groups > 1")
    both = both.join(groups, "pivot", "left").withColumn("part", F.pmod(F.xxhash64("id", "pivot", F.lit(turn)), F.coalesce("groups", F.lit(1))))
    sent = both.join(nodes.select("id", "v"), "id").join(reach.withColumnRenamed("u", "id"), "id", "left").select("pivot", "part", "id", "fresh", F.coalesce("far", F.lit(-2.0)).alias("far"), "v")

    def compare(b: pa.RecordBatch):
        if b.num_rows < 2:
            return None
        ids, fresh, far, x = b.column("id").to_numpy(), b.column("fresh").to_numpy() == 1, b.column("far").to_numpy(), _matrix(b.column("v"), dim)
        sim = x @ x.T
        ok = (sim > far[:, None]) & (fresh[:, None] | fresh[None, :])
        np.fill_diagonal(ok, False)
        i, j = np.nonzero(ok)
        return (ids[i], ids[j], sim[i, j]) if len(i) else None

    return sent.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "id").mapInArrow(_by_group(2, compare, _OFFERS), _OFFER_DDL)


def _within(nodes: DataFrame, group: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(id, links): vectors linked with each node of a component, its own copies not counted."""
    member = nodes.join(group.withColumnRenamed("node", "id"), "id")
    size = group.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    member = member.join(size, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sent = member.select("component", "block", other.alias("other"), "id", "n", "v")
    sent = sent.select("component", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "n", "v")

    def compare(b: pa.RecordBatch):
        p, q, own = b.column("p").to_numpy(), b.column("q").to_numpy(), b.column("block").to_numpy()
        ids, n, x = b.column("id").to_numpy(), b.column("n").to_numpy(), _matrix(b.column("v"), dim)
        left, right = np.flatnonzero(own == p[0]), np.flatnonzero(own == q[0])
        hit = x[left] @ x[right].T >= threshold
        if p[0] == q[0]:
            np.fill_diagonal(hit, False)
            return ids[left], hit @ n[right]
        return np.concatenate((ids[left], ids[right])), np.concatenate((hit @ n[right], n[left] @ hit))

    keys = ["component", "p", "q"]
    parts = sent.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(_by_group(3, compare, pa.schema([("id", pa.int64()), ("links", pa.int64())])), "id bigint, links bigint")
    return parts.groupBy("id").agg(F.sum("links").alias("links"))


def audit(nodes: DataFrame, found: DataFrame, dim: int, count: int, threshold: float = THRESHOLD, probes: int = PROBES) -> float:
    """Share of the links of about `probes` nodes, counted against all nodes, that `found` (id, links) has.

    Half of the probes are taken among nodes with links; nodes are chosen by a hash of their id."""
    def pick(df: DataFrame, salt: str) -> DataFrame:
        return df.orderBy(F.xxhash64("id", F.lit(salt))).limit(probes // 2)

    linked = found.where("links > 0").select("id")
    asked = pick(nodes.select("id"), "all").unionByName(pick(linked, "linked")).distinct()
    rows = nodes.join(asked, "id", "left_semi").join(found, "id", "left").select("id", "v", F.coalesce("links", F.lit(0)).alias("links")).collect()    # at most `probes` rows
    if not rows:
        return 1.0
    ids = np.array([r["id"] for r in rows])
    x = np.stack([np.frombuffer(r["v"], np.float64) for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = nodes.sparkSession.sparkContext.broadcast((ids, x))

    def count_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = model.value
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            hit = (x @ _matrix(b.column("v"), dim).T >= threshold) & (ids[:, None] != b.column("id").to_numpy()[None, :])
            total += hit @ b.column("n").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["id", "links"])

    truth = {r["id"]: r["links"] for r in nodes.mapInArrow(count_links, "id bigint, links bigint").groupBy("id").agg(F.sum("links").alias("links")).collect()}
    return sum(min(r["links"], truth[r["id"]]) for r in rows) / max(1, sum(truth.values())) if sum(truth.values()) else 1.0


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id): one row for each vec_id."""
    every, nodes, dim = _nodes(embeddings)
    count = nodes.count()
    lists, links = None, None
    for attempt in range(TRIES):
        start = staged(_start(nodes, dim, count, threshold, seed=3 + attempt)) if count > 1 else nodes.sparkSession.createDataFrame([], _OFFER_DDL)
        more = start.where(F.col("sim") == _LINK).select(F.col("u").alias("a"), F.col("v").alias("b"))
        links = more if links is None else links.unionByName(more)
        lists = staged(_shorten(start, lists))
        for turn in range(ROUNDS if count > 1 else 0):
            lists = staged(_shorten(_descend(lists, nodes, dim, turn), lists))
            if lists.where("fresh = 1").count() < ENOUGH * LIST * count:
                break
        near = lists.where(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))
        group = components(links.unionByName(near))
        found = staged(_within(nodes, group, dim, threshold))
        if audit(nodes, found, dim, count, threshold) >= RECALL:
            break
    known = nodes.join(found, "id", "left").join(group.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = every.join(known, "v", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def digest(embeddings: DataFrame) -> DataFrame:
    """The contract's columns: vec_id, n_links, component_id, kept."""
    return near_duplicates(embeddings).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
