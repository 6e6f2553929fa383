"""Prefix trie of conversations: double-array tries per prefix shard, upper nodes merged globally.

A conversation is a sequence of turns, a node a distinct sequence of first turns, and `nodes` gives each node's members and the sums over its
subtree.  A turn is known by the SHA-256 of its role and text (120 bits kept), a prefix by the lane-wise sum (mod 2^32, four lanes) of hashes of
(place, turn): sums of rows, so that even one conversation with a third of all turns is cut into chunks of `CHUNK` turns and never gathered.

1. Equal conversations become one sequence with a count, their smallest id and the digest of their ids.
2. Prefixes that more than `LIMIT` sequences share are upper nodes.  Below them each prefix is a shard of at most `LIMIT` sequences, and a task
   packs whole shards into one double-array trie (BASE and CHECK over turn ids made dense in the task), walks every sequence through it, and folds
   the sums from children to parents along CHECK.  What only one sequence holds beyond its first own turn is its tail, and not in the arrays.
3. Shards hand their sums to the upper node above them; upper nodes hand theirs on by pointer doubling, in as many joins as their depth has bits.

A task holds the shared turns of the sequences of whole shards: bounded by LIMIT times the longest prefix that *different* conversations share.

Turns are ordered by (turn, nulls first, role, the turn's hash); null role or text is empty; repeated rows are turns of their own.  Rows with a
null conv_id belong to no conversation and are left out.  A turn may be of any length; only its hash and its length in bytes are moved.  Extra
columns are not looked at.  An empty table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.base import batches, staged
from wattline.llm.double_array import pack, walk

CHUNK, LIMIT = 1024, 4096
FAMILY, MOST = 5, 9                 # the digest's rebuilding: family of a conversation, modulus of the number of borrowed turns
IDS = 4096                          # conversation ids digested together
ROWS = 1 << 16                      # sequences packed together at least, in whole shards
NOTHING = hashlib.sha256(b"").hexdigest()
_LANE = 1 << 32


# ------------------------------------------------------------------------------------------ turns and their places

def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, t1, t2, bytes): hashed turns in order.

    Rows are sorted by ranges over the whole table, so a long conversation is spread over many ranges; places are counted inside a range and
    moved on by the sizes of the conversation's earlier ranges.  Equal rows are told apart by a seeded draw, for balance only."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sha = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    number = lambda i: F.conv(F.substring(sha, i, 15), 16, 10).cast("long")                  # noqa: E731
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), number(1).alias("t1"), number(16).alias("t2"),
                                                                    F.octet_length(text).cast("long").alias("bytes"))
    order = [F.asc_nulls_first("turn"), "role", "t1", "t2"]
    ranged = rows.withColumn("u", F.rand(13)).repartitionByRange("conv_id", *order, "u").withColumn("part", F.spark_partition_id())
    inside = staged(ranged.withColumn("i", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))).select("conv_id", "part", "i", "t1", "t2", "bytes"))
    sizes = inside.groupBy("conv_id", "part").agg(F.max("i").cast("long").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = sizes.withColumn("before", before).where("before is not null").select("conv_id", "part", "before")      # first ranges need no offset
    return inside.join(later, ["conv_id", "part"], "left").select("conv_id", (F.col("i") + F.coalesce("before", F.lit(0))).alias("place"), "t1", "t2", "bytes")


def whole(numbered: DataFrame) -> DataFrame:
    """(conv_id, place, t1, t2, bytes, length): every conversation as it stands."""
    return numbered.join(numbered.groupBy("conv_id").agg(F.count("*").alias("length")), "conv_id")


def rebuilt(numbered: DataFrame) -> DataFrame:
    """As `whole`, each conversation c opening with the first h turns of c - c % 5 in place of its own, h = crc32(c) % 9; one row without a
    place for a conversation that is left with no turn."""
    sizes = numbered.groupBy("conv_id").agg(F.count("*").alias("n"))
    plan = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST).alias("h"))
    plan = plan.join(sizes.select(F.col("conv_id").alias("first"), F.col("n").alias("there")), "first", "left").withColumn("m", F.least("h", F.coalesce("there", F.lit(0))))
    plan = plan.withColumn("length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    plan = staged(plan)
    own = numbered.join(plan.select("conv_id", "h", "m", "length"), "conv_id").where("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("m"))
    heads = numbered.where(F.col("place") < MOST).withColumnRenamed("conv_id", "first")
    lent = heads.join(plan.where("m > 0").select("first", "conv_id", "m", "length"), "first").where("place <= m")
    none = plan.where("length = 0").select("conv_id", *[F.lit(None).cast("long").alias(c) for c in ("place", "t1", "t2", "bytes")], "length")
    columns = ["conv_id", "place", "t1", "t2", "bytes", "length"]
    return own.select(columns).unionByName(lent.select(columns)).unionByName(none)


def _lanes() -> list[Column]:
    """Four 32-bit hashes of a turn at its place."""
    x, y = (F.xxhash64(F.lit(seed), "place", "t1", "t2") for seed in (1, 2))
    return [x.bitwiseAND(F.lit(_LANE - 1)), F.shiftrightunsigned(x, 32), y.bitwiseAND(F.lit(_LANE - 1)), F.shiftrightunsigned(y, 32)]


def keyed(rows: DataFrame) -> DataFrame:
    """Adds each prefix's key (k1, k2), its parent's (p1, p2) and `upto`, the bytes of turns so far.  Root: zeros."""
    laid = rows.where("place is not null").withColumn("chunk", F.floor(F.col("place") / CHUNK))
    names = ["l0", "l1", "l2", "l3", "upto"]
    laid = laid.select("*", *[c.alias(f"_{n}") for n, c in zip(names, [*_lanes(), F.col("bytes")], strict=True)])
    inside = Window.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    totals = laid.where(F.col("length") >= CHUNK).groupBy("conv_id", "chunk").agg(*[F.sum(f"_{n}").alias(n) for n in names])
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offset = totals.select("conv_id", "chunk", *[F.sum(n).over(earlier).alias(f"o_{n}") for n in names]).where("o_l0 is not null")
    sums = laid.select("*", *[F.sum(f"_{n}").over(inside).alias(n) for n in names]).join(offset, ["conv_id", "chunk"], "left")
    full = {n: F.col(n) + F.coalesce(f"o_{n}", F.lit(0)) for n in names}

    def key(a: str, b: str, less: bool) -> Column:
        x, y = (F.pmod(full[n] - F.col(f"_{n}") if less else full[n], F.lit(_LANE)) for n in (a, b))
        return F.shiftleft(x, 32).bitwiseOR(y)

    return sums.select("conv_id", "place", "length", "t1", "t2", "bytes", full["upto"].alias("upto"), key("l0", "l1", False).alias("k1"), key("l2", "l3", False).alias("k2"),
                       key("l0", "l1", True).alias("p1"), key("l2", "l3", True).alias("p2"))


# ------------------------------------------------------------------------------------------ distinct sequences

def _streamed_sha(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces in order, joined by commas; one piece in memory at a time."""
    key, state = None, None
    out: list[tuple] = []
    for batch in it:
        for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
            if (k1, k2) != key:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if len(out) > 10_000:
            yield _shas(out)
            out = []
    if key:
        out.append((*key, state.hexdigest()))
    if out:
        yield _shas(out)


def _shas(out: list[tuple]) -> pa.RecordBatch:
    k1, k2, sha = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sha)], ["k1", "k2", "sha"])


def sequences(ends: DataFrame) -> DataFrame:
    """(k1, k2, rep, n, sha) of each distinct sequence, from (conv_id, k1, k2): how many conversations are it, the smallest, and their ids' digest.

    Ids are gathered in blocks of `IDS` neighbouring ids; a sequence with several blocks is digested from a sorted stream of them."""
    block = F.floor(F.col("conv_id") / IDS)
    parts = ends.groupBy("k1", "k2", block.alias("block")).agg(F.count("*").alias("n"), F.min("conv_id").alias("rep"), F.sort_array(F.collect_list("conv_id")).alias("ids"))
    parts = staged(parts.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ",")))
    one = parts.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.min("rep").alias("rep"), F.count("*").alias("blocks"), F.when(F.count("*") == 1, F.sha2(F.min("ids"), 256)).alias("sha"))
    large = one.where("blocks > 1").select("k1", "k2")
    stream = parts.join(large, ["k1", "k2"], "left_semi").select("k1", "k2", "block", "ids").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "block")
    long = batches(stream, _streamed_sha, "k1 bigint, k2 bigint, sha string").withColumnRenamed("sha", "long_sha")
    return one.join(long, ["k1", "k2"], "left").select("k1", "k2", "rep", "n", F.coalesce("sha", "long_sha").alias("sha"))


# ------------------------------------------------------------------------------------------ shards

NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, p1 bigint, p2 bigint"


def _shard_nodes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences sorted by shard, cut between shards, packed and folded."""
    held, rows = [], 0
    for batch in it:
        t = pa.Table.from_batches([batch])
        held.append(t)
        rows += len(t)
        if rows >= ROWS:
            t = pa.concat_tables(held)
            a, b = t["s1"].to_numpy(), t["s2"].to_numpy()
            cut = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            if len(cut):
                yield from _folded(t.slice(0, int(cut[-1]) + 1))
                t = t.slice(int(cut[-1]) + 1)
            held, rows = [t], len(t)
    if rows:
        yield from _folded(pa.concat_tables(held))


def _dense(*columns: np.ndarray) -> np.ndarray:
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _folded(t: pa.Table) -> Iterator[pa.RecordBatch]:
    t = t.combine_chunks()
    path = t["path"].combine_chunks()
    lengths = np.diff(path.offsets.to_numpy()).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    flat = path.flatten()
    turn1, turn2, size = (flat.field(c).to_numpy() for c in ("t1", "t2", "bytes"))
    n, rep, length, cut, tail = (t[c].to_numpy() for c in ("n", "rep", "length", "cut", "tail"))
    # labels: the shard in place of the first turn, as equal turns below different upper nodes are different nodes
    shard = _dense(t["s1"].to_numpy(), t["s2"].to_numpy())
    labels = _dense(turn1, turn2) + shard.max() + 1
    labels[starts] = shard
    labels = _dense(labels)
    trie = pack(labels, starts, lengths)
    state = walk(trie, labels, starts, lengths)
    if (state < 0).any():
        raise RuntimeError("a sequence left the trie that was made of it")
    seq = np.repeat(np.arange(len(starts)), lengths)
    depth = cut[seq] + np.arange(len(seq)) - starts[seq]
    last = starts + lengths - 1
    cells = len(trie.check)
    convs, owner, deep, weight = np.zeros(cells, np.int64), np.full(cells, np.iinfo(np.int64).max), np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    np.add.at(convs, state, n[seq])
    np.minimum.at(owner, state, rep[seq])
    deep[state], weight[state] = depth, size
    nodes = np.unique(state)
    parent = trie.check[nodes]
    children = np.bincount(parent, minlength=cells)
    goes_on = length > depth[last]                          # the rest of such a sequence is its tail
    children[state[last[goes_on]]] += 1
    leaves = np.where(children == 0, 1, 0)
    leaves[state[last[goes_on]]] = 1
    saved = (convs - 1) * weight
    np.add.at(saved, state[last], tail)
    for d in range(int(deep.max()), int(deep[nodes].min()), -1):
        at = nodes[deep[nodes] == d]
        at = at[trie.check[at] > 0]
        np.add.at(leaves, trie.check[at], leaves[at])
        np.add.at(saved, trie.check[at], saved[at])
    ends = np.full(cells, NOTHING, object)
    done = ~goes_on
    ends[state[last[done]]] = np.array(t["sha"].to_pylist(), object)[done]
    top = np.zeros(cells, np.int64)
    top[state[starts]] = np.arange(len(starts))             # any sequence of the shard knows the upper node above it
    is_top, up = parent == 0, top[nodes]
    p1, p2 = t["p1"].to_numpy(), t["p2"].to_numpy()
    out = [pa.array(owner[nodes]), pa.array(deep[nodes]), pa.array(owner[parent], mask=is_top), pa.array(convs[nodes]), pa.array(children[nodes].astype(np.int64)), pa.array(leaves[nodes]),
           pa.array(saved[nodes]), pa.array(ends[nodes], pa.string()), pa.array(p1[up], mask=~is_top), pa.array(p2[up], mask=~is_top)]
    names = [x.split()[0] for x in NODE.split(", ")]
    whole_batch = pa.RecordBatch.from_arrays(out, names)
    for i in range(0, len(nodes), 8192):
        yield whole_batch.slice(i, 8192)


# ------------------------------------------------------------------------------------------ the trie

def nodes(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """One row for each node, from rows as `whole` or `rebuilt` give them: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (over the subtree: members less one, times the bytes of the last text), ends_sha256 (digest of the members that end here)."""
    limit = LIMIT if limit is None else limit
    empty = staged(rows.where("length = 0").select("conv_id").distinct())
    laid = staged(keyed(rows))
    zero = F.lit(0).cast("long")
    ends = laid.where("place = length").select("conv_id", "k1", "k2").unionByName(empty.select("conv_id", zero.alias("k1"), zero.alias("k2")))
    distinct = staged(sequences(ends))
    reps = distinct.where("k1 <> 0 or k2 <> 0").select(F.col("rep").alias("conv_id"), "n", "sha")
    total = laid.where("place = length").select("conv_id", F.col("upto").alias("all_bytes"))
    kept = laid.join(reps.join(total, "conv_id"), "conv_id")

    shared = kept.groupBy("k1", "k2").agg(F.count("*").alias("held")).where("held > 1")
    edge = kept.select("conv_id", "place", "k1", "k2").join(shared, ["k1", "k2"]).groupBy("conv_id").agg(
        (F.max("place") + 1).alias("own"), (F.coalesce(F.max(F.when(F.col("held") > limit, F.col("place"))), F.lit(0)) + 1).alias("cut"))
    one = F.lit(1).cast("long")
    kept = staged(kept.join(edge, "conv_id", "left").withColumns({"own": F.coalesce("own", one), "cut": F.coalesce("cut", one)}))

    # tails: below a sequence's first own turn nothing branches
    tail = kept.where("place > own").select(
        "conv_id", F.col("place").alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(F.col("place") < F.col("length"), 1).otherwise(0).cast("long").alias("n_children"),
        one.alias("n_leaves"), ((F.col("n") - 1) * (F.col("all_bytes") - F.col("upto") + F.col("bytes"))).alias("saved_tokens"),
        F.when(F.col("place") == F.col("length"), F.col("sha")).otherwise(NOTHING).alias("ends_sha256"))

    # shards
    inner = kept.where("place between cut and own")
    first = F.col("place") == F.col("cut")
    final = F.col("place") == F.least("own", "length")
    paths = inner.groupBy(F.col("conv_id").alias("rep")).agg(
        F.first("n").alias("n"), F.first("length").alias("length"), F.first("cut").alias("cut"), F.first("sha").alias("sha"),
        F.max(F.when(final, (F.col("n") - 1) * (F.col("all_bytes") - F.col("upto")))).alias("tail"),
        *[F.max(F.when(first, F.col(c))).alias(a) for c, a in (("k1", "s1"), ("k2", "s2"), ("p1", "p1"), ("p2", "p2"))],
        F.sort_array(F.collect_list(F.struct("place", "t1", "t2", "bytes"))).alias("path"))
    dealt = paths.repartition("s1", "s2").sortWithinPartitions("s1", "s2")
    made = staged(batches(dealt, _shard_nodes, NODE))
    tops = made.where("p1 is not null")

    # upper nodes, the root among them
    upper = kept.where(F.col("place") < F.col("cut")).groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.first("place").alias("depth"), F.sum("n").alias("n_convs"), F.first("bytes").alias("bytes"), F.max(F.when(F.col("place") == F.col("length"), F.col("sha"))).alias("sha"),
        F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    none = F.lit(None).cast("long")
    root = distinct.agg(F.min("rep").alias("conv_id"), zero.alias("depth"), F.sum("n").alias("n_convs"), zero.alias("bytes"), F.max(F.when((F.col("k1") == 0) & (F.col("k2") == 0), F.col("sha"))).alias("sha")).where("n_convs is not null")
    upper = staged(upper.unionByName(root.select(zero.alias("k1"), zero.alias("k2"), "*", none.alias("p1"), none.alias("p2"))))
    below = tops.groupBy("p1", "p2").agg(F.count("*").alias("n_tops"), F.sum("n_leaves").alias("top_leaves"), F.sum("saved_tokens").alias("top_saved"))
    inner_children = upper.where("p1 is not null").groupBy("p1", "p2").agg(F.count("*").alias("n_upper"))
    handed = below.join(inner_children, ["p1", "p2"], "full").withColumnsRenamed({"p1": "k1", "p2": "k2"})
    upper = upper.join(handed, ["k1", "k2"], "left")
    count = F.coalesce("n_tops", zero) + F.coalesce("n_upper", zero)
    upper = staged(upper.select("k1", "k2", "p1", "p2", "conv_id", "depth", "n_convs", "sha", count.alias("n_children"), F.coalesce("top_leaves", F.when(count == 0, one).otherwise(zero)).alias("n_leaves"),
                                ((F.col("n_convs") - 1) * F.col("bytes") + F.coalesce("top_saved", zero)).alias("saved_tokens"), F.col("p1").alias("a1"), F.col("p2").alias("a2")))
    deepest = upper.agg(F.max("depth")).first()[0] or 0
    for _ in range(int(deepest).bit_length()):
        up = upper.where("a1 is not null").groupBy("a1", "a2").agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved")).withColumnsRenamed({"a1": "k1", "a2": "k2"})
        over = upper.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        upper = upper.join(up, ["k1", "k2"], "left").join(over, ["a1", "a2"], "left").select(
            "k1", "k2", "p1", "p2", "conv_id", "depth", "n_convs", "sha", "n_children", (F.col("n_leaves") + F.coalesce("more_leaves", zero)).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("more_saved", zero)).alias("saved_tokens"), F.col("b1").alias("a1"), F.col("b2").alias("a2"))
        upper = staged(upper)
    names = upper.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    high = upper.join(names, ["p1", "p2"], "left").select("conv_id", "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(NOTHING)).alias("ends_sha256"))
    low = made.where("p1 is null").select(columns).unionByName(tops.join(names, ["p1", "p2"]).withColumn("parent_conv_id", F.col("above")).select(columns))
    return high.unionByName(low).unionByName(tail.select(columns))


def digest(conversations: DataFrame) -> DataFrame:
    """nodes over the rebuilt conversations."""
    return nodes(rebuilt(turns(conversations)))


#: The same question for DuckDB.
SQL = r"""
WITH crc AS MATERIALIZED (
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS f FROM range(256) r(i)),
t AS MATERIALIZED (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i, coalesce(role, '') AS r, coalesce(text, '') AS x
    FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (
    SELECT conv_id, n, xor(list_reduce(list_transform(range(1, length(s) + 1), lambda k: CAST(ascii(substr(s, CAST(k AS INT), 1)) AS BIGINT)), lambda a, b: xor(a >> 8, f[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 9 AS h
    FROM (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, count(*) AS n FROM t GROUP BY 1, 2), crc),
b AS (
    SELECT c.conv_id, 0 AS own, t.i, r, x FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.i <= h
    UNION ALL SELECT c.conv_id, 1, t.i, r, x FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > h),
s AS MATERIALIZED (
    SELECT c.conv_id, coalesce(q, []) AS q
    FROM c LEFT JOIN (SELECT conv_id, list(sha256(strlen(r) || ':' || r || x) || ' ' || strlen(x) ORDER BY own, i) AS q FROM b GROUP BY 1) USING (conv_id)),
p AS MATERIALIZED (SELECT conv_id AS member, d AS depth, q[1:d] AS prefix, len(q) AS size, min(conv_id) OVER (PARTITION BY q[1:d]) AS conv_id FROM s, unnest(range(len(q) + 1)) u(d)),
n AS MATERIALIZED (
    SELECT conv_id, depth, count(*) AS n_convs, coalesce(CAST(split_part(any_value(prefix[depth]), ' ', 2) AS BIGINT), 0) AS bytes,
           sha256(coalesce(string_agg(CAST(member AS VARCHAR), ',' ORDER BY member) FILTER (WHERE size = depth), '')) AS ends_sha256
    FROM p GROUP BY conv_id, depth),
up AS MATERIALIZED (SELECT member, depth, conv_id FROM p),
k AS MATERIALIZED (SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id FROM n JOIN up ON up.member = n.conv_id AND up.depth = n.depth - 1),
kids AS MATERIALIZED (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM k GROUP BY ALL),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children, parent_conv_id FROM n LEFT JOIN kids USING (conv_id, depth) LEFT JOIN k USING (conv_id, depth)),
sub AS (
    SELECT up.conv_id, up.depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens
    FROM w JOIN up ON up.member = w.conv_id AND up.depth <= w.depth GROUP BY ALL)
SELECT w.conv_id, w.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM w JOIN sub USING (conv_id, depth)
"""
