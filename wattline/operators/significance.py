"""Tests on daily loss series and on interval misses.

A daily series per group is bounded by the calendar, so it is folded into one array and the lagged sums are array
expressions: no self joins and no window per lag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.numeric import bind, chi2_1_sf, norm_cdf


def ordered_array(order: str, value: str) -> Column:
    """Aggregate: values in `order` order."""
    pairs = F.sort_array(F.collect_list(F.struct(order, value)))
    return F.transform(pairs, lambda s: s[value].cast("double"))


def _total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def newey_west(arr: Column, lag: Column | None = None) -> Column:
    """HAC variance of a mean's summands with Bartlett weights; default lag floor(n^(1/3))."""
    def body(a: Column) -> Column:
        n = F.size(a)
        depth = lag if lag is not None else F.floor(F.cbrt(n.cast("double")) + F.lit(1e-9)).cast("int")

        def with_centre(dc: Column) -> Column:
            def term(k: Column) -> Column:
                products = F.zip_with(F.slice(dc, k + 1, n - k), F.slice(dc, F.lit(1), n - k), lambda x, y: x * y)
                return F.lit(2.0) * (F.lit(1.0) - k / (depth + 1)) * _total(products) / n

            lags = F.when(depth >= 1, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
            return _total(F.transform(dc, lambda x: x * x)) / n + _total(F.transform(lags, term))

        return bind(bind(_total(a) / n, lambda m: F.transform(a, lambda x: x - m)), with_centre)

    return bind(arr, body)


def diebold_mariano(daily: DataFrame, by: list[str], day: str, loss_a: str, loss_b: str) -> DataFrame:
    """One row per group: statistic, one-sided p that A is better, days, mean difference.

    `daily` may hold several rows a day; they are averaged first.
    """
    d = daily.groupBy(*by, day).agg(F.avg(F.col(loss_a) - F.col(loss_b)).alias("_d"))
    g = d.groupBy(*by).agg(ordered_array(day, "_d").alias("_s"), F.count("_d").alias("n_days"), F.avg("_d").alias("mean_diff"))
    g = g.withColumn("_v", newey_west(F.col("_s")))
    g = g.withColumn("dm_stat", F.when(F.col("_v") > 0, F.col("mean_diff") / F.sqrt(F.col("_v") / F.col("n_days"))))
    return g.withColumn("p_a_better", norm_cdf(F.col("dm_stat"))).select(*by, "dm_stat", "p_a_better", "n_days", "mean_diff")


def _xlogy(k: Column, q: Column) -> Column:
    return F.when(k > 0, k * F.ln(F.when(q > 0, q))).otherwise(F.lit(0.0))


def kupiec(df: DataFrame, by: list[str], miss: Column, p: float) -> DataFrame:
    """Proportion-of-failures likelihood ratio: is the miss rate `p`?"""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.sum(miss.cast("double")).alias("_x"))
    n, x = F.col("_n"), F.col("_x")
    rate = x / n
    ll0 = (n - x) * F.lit(math_log(1 - p)) + x * F.lit(math_log(p))
    ll1 = _xlogy(n - x, F.lit(1.0) - rate) + _xlogy(x, rate)
    lr = F.lit(-2.0) * (ll0 - ll1)
    return g.withColumn("miss_rate", rate).withColumn("lr", lr).withColumn("p_value", chi2_1_sf(lr)).drop("_n", "_x")


def math_log(x: float) -> float:
    import math

    return math.log(x)


def christoffersen(df: DataFrame, by: list[str], order: str, miss: Column) -> DataFrame:
    """Independence test per series from the transition counts of its time-ordered misses.

    Series are one value per day (zone, local hour), so the lag window is bounded by the calendar.
    """
    w = Window.partitionBy(*by).orderBy(order)
    t = df.withColumn("_b", miss.cast("int")).withColumn("_a", F.lag("_b").over(w))
    cnt = lambda a, b: F.count_if((F.col("_a") == a) & (F.col("_b") == b)).cast("double")
    g = t.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), cnt(0, 0).alias("n00"), cnt(0, 1).alias("n01"), cnt(1, 0).alias("n10"),
                           cnt(1, 1).alias("n11"))
    n00, n01, n10, n11 = (F.col(c) for c in ("n00", "n01", "n10", "n11"))

    def loglik(k0: Column, k1: Column) -> Column:
        q = F.try_divide(k1, k0 + k1)
        return _xlogy(k0, F.lit(1.0) - q) + _xlogy(k1, q)

    pi = (n01 + n11) / F.greatest(n00 + n01 + n10 + n11, F.lit(1.0))
    l0 = _xlogy(n00 + n10, F.lit(1.0) - pi) + _xlogy(n01 + n11, pi)
    lr = F.lit(-2.0) * (l0 - (loglik(n00, n01) + loglik(n10, n11)))
    return g.withColumn("lr", F.when(F.col("n") >= 3, lr)).withColumn("p_value", chi2_1_sf(F.col("lr")))


def coverage_tests(pred: DataFrame, by: list[str]) -> DataFrame:
    """Miss rates and Kupiec p for the 90 % and 98 % intervals, and the median Christoffersen p over (zone, hour) series."""
    from wattline.functions.quantiles import has_quantiles

    d = pred.filter(has_quantiles() & F.col("y").isNotNull())
    outside = lambda lo, hi: ~F.col("y").between(F.col(lo), F.col(hi))                       # noqa: E731
    out = None
    for level, lo, hi in ((90, "q05", "q95"), (98, "q01", "q99")):
        k = kupiec(d, by, outside(lo, hi), 1 - level / 100).select(
            *by, F.col("miss_rate").alias(f"miss{level}"), F.col("p_value").alias(f"kupiec_p{level}"))
        out = k if out is None else out.join(k, by)
    c = christoffersen(d, [*by, "zone", "hour_local"], "ts_utc", outside("q05", "q95"))
    med = c.groupBy(*by).agg(F.median("p_value").alias("christoffersen_p90_median"))
    return out.join(med, by)


def clustered_slope(df: DataFrame, by: list[str], x: str, y: str, cluster: str) -> DataFrame:
    """OLS y = a + b x with cluster-robust standard error of b, from sums: per cluster first, then the 2 x 2 algebra."""
    X, Y = F.col(x), F.col(y)
    m = df.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.sum(X).alias("_sx"), F.sum(X * X).alias("_sxx"),
                            F.regr_slope(Y, X).alias("slope"), F.regr_intercept(Y, X).alias("intercept"))
    per = df.groupBy(*by, cluster).agg(F.count(F.lit(1)).cast("double").alias("_cn"), F.sum(X).alias("_cx"), F.sum(X * X).alias("_cxx"),
                                       F.sum(Y).alias("_cy"), F.sum(X * Y).alias("_cxy"))
    j = per.join(m, by) if by else per.join(m)
    u0 = F.col("_cy") - F.col("intercept") * F.col("_cn") - F.col("slope") * F.col("_cx")
    u1 = F.col("_cxy") - F.col("intercept") * F.col("_cx") - F.col("slope") * F.col("_cxx")
    det = F.col("_n") * F.col("_sxx") - F.col("_sx") * F.col("_sx")
    w = (F.col("_n") * u1 - F.col("_sx") * u0) / det          # second row of (X'X)^-1 times the cluster score
    out = j.groupBy(*by).agg(F.first("slope").alias("slope"), F.sqrt(F.sum(w * w)).alias("se"))
    return out.withColumn("t", F.when(F.col("se") > 0, F.col("slope") / F.col("se")))
