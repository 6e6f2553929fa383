"""Bootstrap and permutation designs as tables.

Every random number is a hash of (seed, draw, position), so a lost task recomputes the same rows.  A resampled sum only depends on how often each
observation is drawn, so a block of draws is one array of such counts, and the sums of all series over a block are one matrix product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattline.functions.numeric import hash_uniform

Uniform = Callable[[Column, Column, int], Column]


def default_uniform(b: Column, t: Column, stream: int) -> Column:
    return hash_uniform(b, t, F.lit(stream))


def stationary_indices(spark: SparkSession, n_obs: int, draws: int, mean_block: float, length: int | None = None,
                       seed: int = 0, uniform: Uniform | None = None) -> DataFrame:
    """(b, t, idx): stationary bootstrap with geometric blocks.

    A block starts at t = 0 and wherever a uniform falls below 1 / mean_block; inside a block the index advances by one
    and wraps.  So idx = (start of the last block + t - its position) mod n_obs, a window over one draw.
    """
    u = uniform or (lambda b, t, s: hash_uniform(b, t, F.lit(s), seed=seed))
    length = length or n_obs
    grid = spark.range(1, draws + 1).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("t"))
    b, t = F.col("b"), F.col("t")
    fresh = (t == 0) | (u(b, t, 1) < 1.0 / mean_block)
    start = F.floor(u(b, t, 2) * n_obs)
    w = Window.partitionBy("b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    block = F.last(F.when(fresh, F.struct(start.alias("s"), t.alias("at"))), ignorenulls=True).over(w)
    return grid.withColumn("_k", block).select("b", "t", F.pmod(F.col("_k.s") + t - F.col("_k.at"), F.lit(n_obs)).cast("int").alias("idx"))


def resample_weights(indices: DataFrame) -> DataFrame:
    """(b, idx, w): how often each observation is drawn; resampled sums only need these."""
    return indices.groupBy("b", "idx").agg(F.count(F.lit(1)).cast("double").alias("w"))


def drawn_counts(spark: SparkSession, n_obs: int, draws: int, mean_block: float, length: int | None = None, seed: int = 0, uniform: Uniform | None = None, block: int = 64) -> DataFrame:
    """(first, counts): for each block of draws, the first draw and how often it draws each observation, as 16-bit counts laid draw by draw.

    The draws are those of `stationary_indices`."""
    u = uniform or (lambda b, t, s: hash_uniform(b, t, F.lit(s), seed=seed))
    length = length or n_obs
    if length >= 1 << 16:
        raise ValueError("a resample is shorter than 65,536 observations")
    blocks = spark.range(0, -(-draws // block), 1).repartition(min(-(-draws // block), 2 * spark.sparkContext.defaultParallelism))
    b = F.sequence(F.col("id") * block + 1, F.least(F.col("id") * block + block, F.lit(draws)))
    t = F.sequence(F.lit(0), F.lit(length - 1))
    laid = lambda s: F.flatten(F.transform(b, lambda i: F.transform(t, lambda j: u(i, j, s).cast("double"))))                        # noqa: E731

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(length)
        for batch in it:
            out = []
            for one, two in zip(batch.column("u1"), batch.column("u2"), strict=True):
                fresh, start = (x.values.to_numpy().reshape(-1, length) for x in (one, two))
                at = np.maximum.accumulate(np.where((fresh < 1.0 / mean_block) | (t == 0), t, 0), axis=1)
                start = np.floor(start * n_obs).astype(np.int64)
                idx = (np.take_along_axis(start, at, 1) + t - at) % n_obs
                rows = np.arange(len(idx))[:, None] * n_obs
                out.append(np.bincount((idx + rows).ravel(), minlength=len(idx) * n_obs).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("first"), pa.array(out, pa.binary())], ["first", "counts"])

    return blocks.select((F.col("id") * block + 1).alias("first"), laid(1).alias("u1"), laid(2).alias("u2")).mapInArrow(count, "first bigint, counts binary")


def resampled_sums(rows: DataFrame, by: list[str], t: str, values: list[str], counts: DataFrame, n_obs: int, packs: int = 16) -> DataFrame:
    """(by, b, _n, values): for each series and draw the number of drawn observations that the series has, and the drawn sums of each value.

    Series are laid side by side in at most `packs` arrays (calendar by series), which meet the blocks of draws; no row is made for an observation of a draw."""
    key = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("_0"))
    series = rows.groupBy(key.alias("_key")).agg(F.collect_list(F.struct(F.col(t).cast("int").alias("t"), *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)])).alias("_x"))
    pack = series.groupBy(F.pmod(F.xxhash64("_key"), F.lit(packs)).alias("_pack")).agg(F.collect_list(F.struct("_key", "_x")).alias("_all"))
    pack = pack.select(F.transform("_all", lambda s: s["_key"]).alias("keys"), F.transform("_all", lambda s: s["_x"]).alias("x"))

    def product(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for first, counts, keys, x in zip(batch.column("first").to_pylist(), batch.column("counts").to_pylist(), batch.column("keys"), batch.column("x"), strict=True):
                w = np.frombuffer(counts, np.uint16).reshape(-1, n_obs).astype(float)
                lists = x.values
                size = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten()
                at, who = flat.field("t").to_numpy(), np.repeat(np.arange(len(size)), size)
                out = []
                for v in [None, *range(len(values))]:
                    m = np.zeros((n_obs, len(size)))
                    m[at, who] = 1.0 if v is None else flat.field(f"v{v}").to_numpy(zero_copy_only=False)
                    out.append((w @ m).ravel())
                which = np.tile(np.arange(len(size)), len(w))
                draw = np.repeat(np.arange(len(w)) + first, len(size))
                yield pa.RecordBatch.from_arrays([keys.values.take(pa.array(which)), pa.array(draw), *map(pa.array, out)], ["_key", "b", "_n", *[f"v{i}" for i in range(len(values))]])

    joined = counts.join(pack)                               # blocks of draws by packs of series: both sides are few rows
    kind = series.schema["_key"].dataType.simpleString()
    made = joined.mapInArrow(product, f"_key {kind}, b bigint, _n double, " + ", ".join(f"v{i} double" for i in range(len(values))))
    return made.select(*[F.col(f"_key.{c}").alias(c) for c in by], "b", "_n", *[F.col(f"v{i}").alias(v) for i, v in enumerate(values)])


def position_index(days: DataFrame, day: str, out: str = "t") -> DataFrame:
    """Distinct days numbered from 0 (a calendar-sized table)."""
    return days.select(day).distinct().withColumn(out, F.row_number().over(Window.orderBy(day)) - 1)


def studentised(mean: Column, sd: Column, n: Column) -> Column:
    return F.when(sd > 0, mean / sd * F.sqrt(n)).otherwise(F.lit(0.0))


def bootstrap_mean_p(series: DataFrame, by: list[str], day: str, value: str, draws: int = 10_000, mean_block: float = 5.0,
                     seed: int = 0, uniform: Uniform | None = None) -> DataFrame:
    """One-sided block-bootstrap p for mean > 0: share of demeaned resamples whose studentised mean reaches the observed."""
    spark = series.sparkSession
    s = series.groupBy(*by, day).agg(F.sum(value).alias("_x"))
    pos = position_index(s, day)
    n = pos.count()
    obs = s.groupBy(*by).agg(F.avg("_x").alias("_m"), F.stddev_samp("_x").alias("_sd"), F.count("_x").alias("n_days"))
    obs = obs.withColumn("t_stat", studentised(F.col("_m"), F.col("_sd"), F.col("n_days")))
    rows = s.join(pos, day).join(obs, by) if by else s.join(pos, day).join(obs)
    z = F.col("_x") - F.col("_m")
    counts = drawn_counts(spark, n, draws, mean_block, seed=seed, uniform=uniform)
    sums = resampled_sums(rows.select(*by, "t", z.alias("_s1"), (z * z).alias("_s2")), by, "t", ["_s1", "_s2"], counts, n).where("_n > 0")
    seen = obs.select(*by, "t_stat", "n_days", F.col("_m").alias("mean"))
    sums = sums.join(seen, by) if by else sums.join(seen)
    mean = F.col("_s1") / F.col("_n")
    sd = F.sqrt(F.greatest((F.col("_s2") - F.col("_n") * mean * mean) / (F.col("_n") - 1), F.lit(0.0)))
    sims = sums.withColumn("_t", studentised(mean, sd, F.col("_n")))
    return sims.groupBy(*by).agg(F.first("n_days").alias("n_days"), F.first("mean").alias("mean"), F.first("t_stat").alias("t_stat"),
                                 F.avg((F.col("_t") >= F.col("t_stat")).cast("double")).alias("p_value"))


def power_curve(series: DataFrame, day: str, value: str, lengths: list[int], sims: int = 2000, mean_block: float = 5.0,
                alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Critical value and power of the one-sided test at each forward length, taking the series as the truth."""
    spark = series.sparkSession
    s = series.groupBy(day).agg(F.sum(value).alias("_x"))
    pos = position_index(s, day)
    n = pos.count()
    rows = s.join(pos, day)
    rows = rows.join(rows.agg(F.avg("_x").alias("_m")))
    g = None
    for length in lengths:
        for kind, off in (("null", 0), ("alt", 1)):
            x = F.col("_x") - (F.col("_m") if kind == "null" else F.lit(0.0))
            counts = drawn_counts(spark, n, sims, mean_block, length=length, seed=seed + 7919 * length + off)
            part = resampled_sums(rows.select("t", x.alias("_s1"), (x * x).alias("_s2")), [], "t", ["_s1", "_s2"], counts, n)
            part = part.select(F.lit(length).alias("n_days"), F.lit(kind).alias("kind"), "b", "_s1", "_s2")
            g = part if g is None else g.unionByName(part)
    m = F.col("_s1") / F.col("n_days")
    sd = F.sqrt(F.greatest((F.col("_s2") - F.col("n_days") * m * m) / (F.col("n_days") - 1), F.lit(0.0)))
    g = g.withColumn("_t", studentised(m, sd, F.col("n_days")))
    crit = g.filter("kind = 'null'").groupBy("n_days").agg(F.percentile("_t", F.lit(1 - alpha)).alias("crit_t"))
    return g.filter("kind = 'alt'").join(crit, "n_days").groupBy("n_days").agg(
        F.first("crit_t").alias("crit_t"), F.avg((F.col("_t") > F.col("crit_t")).cast("double")).alias("power"))


def required_length(curve: DataFrame, target: float = 0.8) -> DataFrame:
    return curve.filter(F.col("power") >= target).agg(F.min("n_days").cast("double").alias("n_days"))


CLUSTER_PIECE = 1 << 19             # clusters that one row holds as arrays (8 MB); more are dealt over several rows


def cluster_bootstrap(df: DataFrame, by: list[str], cluster: str, pnl: str, draws: int = 4000, seed: int = 0, block: int = 32) -> DataFrame:
    """Bootstrap of the mean P&L per trade that resamples whole clusters.

    Clusters are numbered once; draw b picks cluster floor(u * K) K times.  The per-cluster sums are arrays that meet the blocks of draws, and a draw is
    folded where it is made, so no row is made for a pick and only the arrays are moved, once a block.
    """
    sums = df.groupBy(*by, cluster).agg(F.sum(F.coalesce(F.col(pnl), F.lit(0.0))).alias("_tot"),
                                        F.count(pnl).cast("double").alias("_trades"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    num = sums.withColumn("_c", F.row_number().over(w.orderBy(cluster)) - 1).withColumn("_k", F.count(F.lit(1)).over(w))
    size = F.lit(CLUSTER_PIECE)
    piece = num.groupBy(*by, "_k", (F.col("_c") - F.col("_c") % size).alias("_at")).agg(F.sort_array(F.collect_list(F.struct("_c", "_tot", "_trades"))).alias("_x"))
    piece = piece.select(*by, "_k", "_at", F.transform("_x", lambda x: x["_tot"]).alias("_tots"), F.transform("_x", lambda x: x["_trades"]).alias("_all"))
    work = piece.withColumn("_lo", F.explode(F.sequence(F.lit(0), (F.col("_k") - 1).cast("int"), size))).withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(draws), F.lit(block))))
    work = work.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by, "_at", "_lo", "_b")
    keys, turns = [F.col(k) for k in by], F.sequence("_lo", F.least(F.col("_lo") + size, F.col("_k").cast("int")) - 1)
    pick = lambda b: F.transform(turns, lambda c: F.floor(hash_uniform(*keys, b, c, seed=seed) * F.col("_k")).cast("int") - F.col("_at"))              # noqa: E731
    here = lambda c, i: F.coalesce(F.get(c, i), F.lit(0.0))                                  # noqa: E731
    none = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("n"))
    fold = lambda b: F.aggregate(pick(b), none, lambda a, i: F.struct((a["t"] + here("_tots", i)).alias("t"), (a["n"] + here("_all", i)).alias("n")))      # noqa: E731
    made = work.select(*by, F.explode(F.transform(F.sequence("_b", F.least(F.col("_b") + (block - 1), F.lit(draws))), lambda b: F.struct(b.alias("b"), fold(b).alias("s")))).alias("_d"))
    boot = made.groupBy(*by, F.col("_d.b").alias("b")).agg(F.sum("_d.s.t").alias("_t"), F.sum("_d.s.n").alias("_n"))
    boot = boot.filter("_n > 0").withColumn("_m", F.col("_t") / F.col("_n"))
    ci = boot.groupBy(*by).agg(F.percentile("_m", F.lit(0.025)).alias("lo"), F.percentile("_m", F.lit(0.975)).alias("hi"),
                               F.avg((F.col("_m") <= 0).cast("double")).alias("p"))
    obs = sums.groupBy(*by).agg(F.sum("_trades").cast("bigint").alias("n_trades"), F.try_divide(F.sum("_tot"), F.sum("_trades")).alias("mean"))
    return obs.join(ci, by, "left") if by else obs.join(ci)


def shuffle_within(df: DataFrame, groups: list[str], row_id: list[str], payload: list[str], draws: int, seed: int = 0, block: int = 64) -> DataFrame:
    """`draws` permutations of `payload` inside each group: (b, all other columns, shuffled payload).

    Rows of a group are matched rank to rank between their stable order and a hash order.  A group is one location-hour or
    one auction, i.e. bounded by the calendar or by the auction's paths, so it is one array, and only the arrays are moved, once a block of draws.
    """
    keep = [c for c in df.columns if c not in [*payload, *groups, *row_id]]
    row = F.struct(*row_id, *keep, *payload)
    laid = df.groupBy(*groups).agg(F.sort_array(F.collect_list(row)).alias("_rows")).withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(draws), F.lit(block))))
    laid = laid.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *groups, "_b")
    each = laid.select(*groups, "_rows", F.explode(F.sequence("_b", F.least(F.col("_b") + (block - 1), F.lit(draws)))).alias("b"))
    drawn = lambda r: F.struct(hash_uniform(F.col("b"), *[r[c] for c in row_id], seed=seed).alias("_u"), r.alias("_r"))       # noqa: E731
    pairs = each.select("b", *groups, F.explode(F.arrays_zip("_rows", F.sort_array(F.transform("_rows", drawn)).alias("_mixed"))).alias("_p"))
    return pairs.select("b", *groups, *[F.col(f"_p._rows.{c}").alias(c) for c in [*row_id, *keep]], *[F.col(f"_p._mixed._r.{c}").alias(c) for c in payload])
