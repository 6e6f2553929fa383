"""Forecasting models as distributed jobs on the event panel (rows only; their properties are tested on seeded worlds)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from wattline.checks.base import FOLDS_SQL, LAGGED_SQL, Tables, check, rounded
from wattline.checks.panels import ZONES, build
from wattline.models.ensemble import average_members
from wattline.models.lear import LearModel
from wattline.models.naive import NaiveModel, ZeroCongestion
from wattline.models.spike import excess_quantiles
from wattline.operators.boosting import Fit, Options, boost, predict
from wattline.plans.backtest import run_folds
from wattline.plans.folds import Fold
from wattline.session import cut_lineage

FOLD = Fold("2024-11", date(2024, 10, 27), date(2024, 11, 20), date(2024, 11, 21), date(2024, 11, 25))


@check("lear_forecast")
def lear(t: Tables):
    p = cut_lineage(build(t))
    out = LearModel("lear", (21, None), "holdout", energy_zone=ZONES[0]).fit_predict(p, [FOLD])
    return rounded(out.groupBy("market", "component", "zone").agg(F.count(F.lit(1)).alias("n"), F.count("mean").alias("forecasts"), F.avg("mean").alias("mean")), 3)


@check("naive_backtest")
def naive(t: Tables):
    p = cut_lineage(build(t))
    ref = NaiveModel("lago_naive").points(p).filter(F.col("delivery_date").between(F.lit(FOLD.test_start), F.lit(date(2024, 11, 24))))
    out = run_folds(NaiveModel("persist_da_d1"), p, [FOLD], ref)
    return rounded(out.groupBy("fold", "market", "component", "zone").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y") - F.col("mean"))).alias("mae"), F.avg(F.abs(F.col("y") - F.col("ref_mean"))).alias("ref_mae"),
                                                                          F.avg(F.col("q95") - F.col("q05")).alias("width")), 4)


@check("zero_congestion")
def zero(t: Tables):
    out = run_folds(ZeroCongestion(), build(t), [FOLD])
    return rounded(out.groupBy("market", "zone").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("y")).alias("mae")), 4)


@check("spike_conditional_quantiles", """WITH x AS (SELECT event_type, quantile_cont(value, 0.95) AS thr FROM events GROUP BY 1)
SELECT event_type, round(thr, 6) AS thr, round(thr + 20 / 0.2 * (pow(1 - 0.5, -0.2) - 1), 6) AS q50, round(thr + 20 / 0.2 * (pow(1 - 0.99, -0.2) - 1), 6) AS q99, round(thr + least(20 / 0.8, 20 / 0.2 * (pow(1 - 0.99, -0.2) - 1)), 6) AS mean FROM x""")
def spike_quantiles(t: Tables):
    from wattline.operators.ordered import exact_quantiles

    x = exact_quantiles(t.events, ["event_type"], "value", [0.95], names=["thr"]).withColumns({"xi": F.lit(0.2), "sigma": F.lit(20.0)})
    return rounded(excess_quantiles(x).select("event_type", "thr", "q50", "q99", "mean"))


@check("ensemble_average")
def ensemble(t: Tables):
    from wattline.checks.scoring import calibrated

    return rounded(average_members(calibrated(t).filter("q01 IS NOT NULL")).select("delivery_date", "zone", "market", "mean", "q05", "q50", "q95"))


def _boost_rows(t: Tables):
    """Book rows with features in steps of two from 44 to 60, so that both engines see the same cut points: yesterday's and last week's price, the real-time price two days ago."""
    b = t.lagged_book()
    whole = lambda c: F.least(F.greatest(2 * F.floor(F.col(c) / 2), F.lit(44)), F.lit(60)).cast("double")       # noqa: E731
    code = F.substring("zone", 1, 1).cast("int")
    return b.select(F.xxhash64("d", "zone").alias("id"), F.unix_date("d").alias("day"), code.alias("part"), F.array(whole("da_l1"), whole("da_l7"), whole("rt_l2")).alias("x"),
                    F.array("da", "rt").alias("y"), "d", "zone")


def _boost_fits(t: Tables) -> list[Fit]:
    number = lambda d: (d - date(1970, 1, 1)).days                                               # noqa: E731
    return [Fit((f.name, m), i, number(f.train_start), number(f.train_end), number(f.test_start), number(f.test_end)) for f in t.folds() for i, m in enumerate(("da", "rt"))]


@check("boosted_first_split", f"""WITH {LAGGED_SQL}, {FOLDS_SQL},
r AS MATERIALIZED (SELECT d, zone, list_transform([da_l1, da_l7, rt_l2], lambda v: CASE WHEN v IS NOT NULL THEN least(greatest(2 * floor(v / 2), 44), 60) END) AS x, [da, rt] AS y FROM lagged),
s AS MATERIALIZED (SELECT fold, ['da', 'rt'][k] AS market, f - 1 AS feature, coalesce(x[f], -1e9) AS v, count(*) AS n, sum(y[k]) AS g
  FROM r, folds, (SELECT unnest([1, 2]) AS k), (SELECT unnest([1, 2, 3]) AS f) WHERE d >= train_start AND d < train_end GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS ln, sum(g) OVER w AS lg, sum(n) OVER p AS tn, sum(g) OVER p AS tg FROM s WINDOW w AS (PARTITION BY fold, market, feature ORDER BY v ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY fold, market, feature)),
q AS (SELECT *, lg * lg / ln + (tg - lg) * (tg - lg) / (tn - ln) - tg * tg / tn AS gain FROM c WHERE ln >= 20 AND tn - ln >= 20)
SELECT fold, market, CAST(feature AS INTEGER) AS feature, round(lg / ln, 6) AS left_mean, round((tg - lg) / (tn - ln), 6) AS right_mean
FROM (SELECT *, row_number() OVER (PARTITION BY fold, market ORDER BY round(gain, 6) DESC, feature, v) AS i FROM q) WHERE i = 1""")
def boosted_first_split(t: Tables):
    """Root split of every fold's and market's tree, found in one job; leaves are shown with the target's mean added back."""
    options = Options("l2", trees=1, depth=1, rate=1.0, min_rows=20, bins=127, rows=1.0, features=1.0)
    fits = _boost_fits(t)
    forest = boost(_boost_rows(t).drop("d", "zone"), fits, 3, 2, options)
    rows = [(*f.name, int(forest.feature[0][k, 0]), float(forest.start[k] + forest.value[0][k, 1]), float(forest.start[k] + forest.value[0][k, 2])) for k, f in enumerate(fits) if forest.feature[0][k, 0] >= 0]
    return rounded(t.spark.createDataFrame(rows, "fold string, market string, feature int, left_mean double, right_mean double"))


@check("boosted_forecast")
def boosted_forecast(t: Tables):
    """Trees of all folds and both markets: mean absolute error of each fold beside that of yesterday's price.  No SQL: the first split has it, and tests hold whole trees against a search of all splits."""
    options = Options("l1", trees=8, depth=3, rate=0.4, min_rows=20, bins=32)
    rows, fits = cut_lineage(_boost_rows(t)), _boost_fits(t)
    forest = boost(rows.drop("d", "zone"), fits, 3, 2, options)
    names = F.array(*[F.struct(F.lit(f.name[0]).alias("fold"), F.lit(f.name[1]).alias("market"), F.lit(f.target).alias("target")) for f in fits])
    made = predict(rows, forest, options).select("id", F.get(names, F.col("fit")).alias("f"), "mean").select("id", "f.*", "mean")
    j = made.join(rows, "id").withColumn("actual", F.get("y", F.col("target")))
    return rounded(j.groupBy("fold", "market").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("mean") - F.col("actual"))).alias("mae"), F.avg(F.abs(F.get("x", F.lit(0)) - F.col("actual"))).alias("persistence_mae")), 4)


@check("tail_fits")
def tail_fits(t: Tables):
    """Pareto fits of the values above each event type's 95th percentile, and of all of them pooled.  No SQL: tests hold the merged sums against fits of single groups."""
    from wattline.operators.ordered import exact_quantiles
    from wattline.operators.tails import gpd_fits

    thr = exact_quantiles(t.events, ["event_type"], "value", [0.95], names=["thr"])
    e = t.events.join(thr, "event_type").where("value > thr").select("event_type", (F.col("value") - F.col("thr")).alias("e"))
    return rounded(gpd_fits(e.unionByName(e.withColumn("event_type", F.lit(None).cast("string"))), ["event_type"], "e"), 4)
