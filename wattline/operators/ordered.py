"""Ordered operators that never put a whole series into one task.

A window over `partitionBy(entity)` sorts every row of that entity in one task, which fails when one entity holds a third
of the data.  The operators here cut each series into time chunks first:

* a neighbour that only matters within `reach` seconds comes from the chunk itself plus a thin halo copied from the
  chunk before (or after) it;
* running totals and row numbers are two-level: inside a chunk, plus an offset from the (small) table of chunk totals;
* the last earlier value is looked up inside the chunk, else carried in from the table of chunk summaries.

A chunk of one entity is bounded because (entity, stamp) is a key: the chunk length caps the rows it can hold.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def chunk_of(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def with_neighbour(df: DataFrame, keys: list[str], ts: str, reach: int, forward: bool = False, out: str = "neighbour_ts",
                   chunk: int = DAY) -> DataFrame:
    """Add the previous (or next) stamp of the same key when it is at most `reach` seconds away, else NULL.

    One exchange on (keys, chunk).  `reach` must not exceed `chunk`.
    """
    if reach > chunk:
        raise ValueError("reach must fit inside one chunk")
    span = F.lit(chunk * 1_000_000)
    home = chunk_of(F.col(ts), chunk)
    inside = F.pmod(F.unix_micros(ts), span)
    if forward:
        near, other = inside <= F.lit(reach * 1_000_000), home - 1
    else:
        near, other = inside >= span - F.lit(reach * 1_000_000), home + 1
    spread = df.withColumn("_home", home).withColumn(
        "_chunk", F.explode(F.when(near, F.array(F.col("_home"), other)).otherwise(F.array(F.col("_home")))))
    w = Window.partitionBy(*keys, "_chunk").orderBy(ts)
    seen = (F.lead(ts) if forward else F.lag(ts)).over(w)
    gap = F.abs(F.unix_micros(seen) - F.unix_micros(ts))
    return (spread.withColumn(out, seen).withColumn(out, F.when(gap <= reach * 1_000_000, F.col(out)))
            .filter(F.col("_chunk") == F.col("_home")).drop("_home", "_chunk"))


def running_sum(df: DataFrame, keys: list[str], ts: str, value: Column, out: str, tie: list[str] | None = None,
                chunk: int = DAY) -> DataFrame:
    """Inclusive running sum of `value` per key in (ts, tie) order, exact and two-level."""
    order = [ts, *(tie or [])]
    base = df.withColumn("_v", value).withColumn("_chunk", chunk_of(F.col(ts), chunk))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = base.groupBy(*keys, "_chunk").agg(F.sum("_v").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_c"),
                            F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    match = F.col("_chunk") == F.col("_c")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = base.withColumn(out, F.sum("_v").over(inside)).join(offsets, match)
    return (joined.withColumn(out, F.col(out) + F.col("_offset"))
            .drop("_v", "_chunk", "_c", "_offset", *[f"_k{i}" for i in range(len(keys))]))


def row_index(df: DataFrame, keys: list[str], ts: str, tie: list[str] | None = None, out: str = "row_no",
              chunk: int = DAY) -> DataFrame:
    """1-based position of each row in its key's (ts, tie) order."""
    return running_sum(df, keys, ts, F.lit(1).cast("long"), out, tie, chunk)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in `order`.  A `max_by` aggregate, so copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def _place(df: DataFrame, cuts: str, value: str, n: int, out: str) -> DataFrame:
    """Number of cut points below `value`, of at most `n` sorted ones: the block by its last cut, then the place in it.

    Two sums of plain comparisons, about 2 * sqrt(n), which compile; a lambda over the array runs all n uncompiled for each row.
    """
    step = max(isqrt(n) + 1, 1)
    below = lambda places: " + ".join(["0", *[f"if(get(`{cuts}`, {i}) < `{value}`, 1, 0)" for i in places]])                       # noqa: E731
    block = df.withColumn("_block", F.expr(f"{step} * ({below(range(step - 1, n, step))})"))
    return block.withColumn(out, F.expr(f"_block + {below(f'_block + {i}' for i in range(step))}")).drop("_block")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], bins: int = 256,
                    names: list[str] | None = None) -> DataFrame:
    """Linear-interpolation quantiles per key for groups of any size.

    The built-in exact percentile gathers every distinct value of a group into one task.  Here: (1) a mergeable sketch
    gives cut points per key, (2) rows are counted per (key, bin) with map-side combining, (3) only the bins that hold a
    wanted rank are sorted.  The result is exact; the sketch only balances the bins.
    """
    names = names or [f"p{round(p * 100):02d}" for p in probs]
    rows = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    cuts = (df.filter(F.col(value).isNotNull()).groupBy(*keys)
            .agg(F.sort_array(F.array_distinct(F.approx_percentile(value, [i / bins for i in range(1, bins)], 4 * bins))).alias("_cuts"))
            .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_cuts"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    located = _place(rows.join(cuts, on) if keys else rows.crossJoin(cuts), "_cuts", value, bins - 1, "_bin").select(*keys, value, "_n", "_bin")
    per_bin = located.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_bn"))
    w = Window.partitionBy(*keys).orderBy("_bin")
    whole = Window.partitionBy(*keys)
    marked = (per_bin.withColumn("_upto", F.sum("_bn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("_total", F.sum("_bn").over(whole)).withColumn("_before", F.col("_upto") - F.col("_bn")))
    wanted = marked.withColumn("_p", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"))
                                                         for i, p in enumerate(probs)])))
    pos = F.col("_p.p") * (F.col("_total") - 1)
    wanted = (wanted.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor(pos), F.ceil(pos)))))
              .filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_upto")))
              .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bin").alias("_b"), "_before", "_total",
                      F.col("_p.i").alias("_i"), "_rank"))
    group = [f"_k{i}" for i in range(len(keys))]
    per_bin_wanted = wanted.groupBy(*group, "_b").agg(F.first("_before").alias("_before"), F.first("_total").alias("_total"), F.collect_list(F.struct("_i", "_rank")).alias("_ranks"))
    on_bin = F.col("_bin") == F.col("_b")
    for i, k in enumerate(keys):
        on_bin = on_bin & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = located.join(per_bin_wanted, on_bin).withColumn("_hi", F.col("_before") + F.sum("_n").over(inside)).withColumn("_r", F.explode("_ranks"))
    hits = ranked.filter((F.col("_r._rank") < F.col("_hi")) & (F.col("_r._rank") >= F.col("_hi") - F.col("_n")))
    mine = lambda i, agg: agg(F.when(F.col("_r._i") == i, F.struct("_r._rank", F.col(value).alias("v"))))["v"]                      # noqa: E731
    at = hits.groupBy(*keys).agg(F.first("_total").alias("_total"), *[x for i in range(len(probs)) for x in (mine(i, F.min).alias(f"_lo{i}"), mine(i, F.max).alias(f"_up{i}"))])
    place = [F.lit(float(p)) * (F.col("_total") - 1) for p in probs]
    return at.select(*keys, *[(F.col(f"_lo{i}") + (F.col(f"_up{i}") - F.col(f"_lo{i}")) * (x - F.floor(x))).alias(n) for i, (x, n) in enumerate(zip(place, names, strict=True))])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Top k rows per key.  Spark limits each map task to k rows per key before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
