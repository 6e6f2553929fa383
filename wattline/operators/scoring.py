"""Forecast scores as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions import quantiles as Q
from wattline.operators.ordered import exact_quantiles
from wattline.settings import QCOLS

TOTAL = "ALL"


def with_total(df: DataFrame, col: str = "zone", label: str = TOTAL) -> DataFrame:
    """Every row also counts for the total row: one pass and one shuffle instead of a second scan."""
    return df.withColumn(col, F.explode(F.array(F.col(col).cast("string"), F.lit(label))))


def smape(y: Column, f: Column) -> Column:
    denom = (F.abs(y) + F.abs(f)) / F.lit(2.0)
    return F.avg(F.when(denom > 1e-9, F.abs(y - f) / denom))


def add_row_losses(df: DataFrame) -> DataFrame:
    """ae, se and, where the quantiles exist, crps."""
    y, f = F.col("y"), F.col("mean")
    out = df.withColumns({"ae": F.abs(y - f), "se": (y - f) * (y - f)})
    return out.withColumn("crps", Q.crps(y)) if set(QCOLS) <= set(df.columns) else out


def score_table(joined: DataFrame, by: list[str], reference: str | None = None, tail: float = 0.95) -> DataFrame:
    """Point and probabilistic scores per group.

    Tail and normal errors split each group at the exact `tail` quantile of |y|, found without gathering the group.
    """
    y, f = F.col("y"), F.col("mean")
    rows = joined.withColumn("_abs", F.abs(y)).withColumn("_ae", F.abs(y - f))
    cut = exact_quantiles(rows, by, "_abs", [tail], names=["_cut"])
    rows = rows.join(cut, by) if by else rows.join(cut)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("_ae").alias("mae"), F.sqrt(F.avg((y - f) * (y - f))).alias("rmse"),
            smape(y, f).alias("smape"), F.avg(F.when(F.col("_abs") >= F.col("_cut"), F.col("_ae"))).alias("tail_mae"),
            F.avg(F.when(F.col("_abs") < F.col("_cut"), F.col("_ae"))).alias("normal_mae")]
    if reference:
        base = F.avg(F.abs(y - F.col(reference)))
        aggs.append(F.when(base > 0, F.avg("_ae") / base).alias("rmae"))
    if set(QCOLS) <= set(joined.columns):
        has = Q.has_quantiles()
        aggs += [F.count_if(has).alias("n_prob"), F.avg(Q.crps(y)).alias("crps"), F.avg(Q.pinball_mean(y)).alias("pinball_mean"),
                 *[F.avg(F.when(has, Q.covered(y, lo, hi))).alias(n)
                   for n, lo, hi in (("cov50", "q25", "q75"), ("cov90", "q05", "q95"), ("cov98", "q01", "q99"))]]
    return rows.groupBy(*by).agg(*aggs)


def scored_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("scored") & F.col("y").isNotNull() & F.col("mean").isNotNull())


def zone_and_total_scores(joined: DataFrame, by: list[str], reference: str | None = None) -> DataFrame:
    return score_table(with_total(scored_rows(joined)), [*by, "zone"], reference)


def melt_scores(scores: DataFrame, ids: list[str]) -> DataFrame:
    metrics = [c for c in scores.columns if c not in ids]
    return scores.select(*ids, *[F.col(c).cast("double") for c in metrics]).unpivot(ids, metrics, "metric", "value")


def daily_losses(pred: DataFrame, by: list[str]) -> DataFrame:
    """Daily mean losses per group; the daily CRPS is NULL when any row of the day lacks quantiles."""
    rows = add_row_losses(scored_rows(pred))
    crps = F.when(F.count("crps") == F.count(F.lit(1)), F.avg("crps")) if "crps" in rows.columns else F.lit(None).cast("double")
    return rows.groupBy(*by, F.col("delivery_date").alias("day")).agg(
        crps.alias("crps"), F.avg("se").alias("se"), F.avg("ae").alias("ae"), F.count(F.lit(1)).alias("n"))


def brier(p: Column, hit: Column) -> Column:
    return F.avg((p - hit) * (p - hit))


def log_loss(p: Column, hit: Column, floor: float = 1e-4) -> Column:
    q = F.greatest(F.lit(floor), F.least(F.lit(1 - floor), p))
    return -F.avg(hit * F.ln(q) + (F.lit(1.0) - hit) * F.ln(F.lit(1.0) - q))


def ks_uniform(df: DataFrame, by: list[str], u: str, bins: int = 4096) -> DataFrame:
    """Kolmogorov-Smirnov distance of `u` from the uniform distribution, exact.

    Equal values are counted first.  Values are ranked inside one of `bins` cells, and the cells before it, a fixed number a group, give the rest
    of the rank, so no task orders a whole group.
    """
    from pyspark.sql import Window

    values = df.filter(F.col(u).isNotNull()).groupBy(*by, F.col(u).alias("_u")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_cell", F.least(F.greatest(F.floor(F.col("_u") * bins), F.lit(0)), F.lit(bins - 1)))
    keys = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    cells = values.groupBy(*keys, F.col("_cell").alias("_own")).agg(F.sum("_n").alias("_in"))
    group = [f"_by{i}" for i in range(len(by))]
    whole = Window.partitionBy(*group)
    cells = cells.withColumn("_before", F.sum("_in").over(whole.orderBy("_own")) - F.col("_in")).withColumn("_tot", F.sum("_in").over(whole))
    same = F.col("_cell") == F.col("_own")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    w = Window.partitionBy(*by, "_cell").orderBy("_u").rowsBetween(Window.unboundedPreceding, 0)
    up = values.join(cells, same).withColumn("_cum", F.col("_before") + F.sum("_n").over(w))
    gap = F.greatest(F.abs(F.col("_cum") / F.col("_tot") - F.col("_u")), F.abs((F.col("_cum") - F.col("_n")) / F.col("_tot") - F.col("_u")))
    return up.groupBy(*by).agg(F.max(gap).alias("ks_stat"), F.max("_tot").alias("n"))
