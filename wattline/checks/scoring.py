"""Baselines, residual quantiles, scores, tests on losses, post-processing of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.checks.base import FOLD_START, FOLDS_SQL, LAGGED_SQL, PRED_SQL, Tables, check, parents, rounded
from wattline.functions import quantiles as Q
from wattline.models.naive import RULES, lag_forecast
from wattline.models.residuals import oos_quantiles, residual_tables
from wattline.operators.reshape import day_grid
from wattline.operators.scoring import daily_losses, score_table, with_total
from wattline.operators.significance import christoffersen, diebold_mariano, kupiec
from wattline.plans import postprocess as P
from wattline.plans.backtest import pooled_summary
from wattline.plans.diagnostics import common_row_scores, fold_win_rate
from wattline.plans.folds import assign_test_fold, fold_table, inner_folds, spread_history
from wattline.settings import QCOLS, QUANTILES

LEVELS_SQL = "[" + ", ".join(str(q) for q in QUANTILES) + "]"
CRPS_SQL = "2 * (" + " + ".join(f"greatest({q} * (y - q[{i + 1}]), ({q} - 1) * (y - q[{i + 1}])) * {w!r}" for i, (q, w) in enumerate(zip(QUANTILES, Q.CELL_WIDTHS))) + ")"
PINBALL_SQL = "(" + " + ".join(f"greatest({q} * (y - q[{i + 1}]), ({q} - 1) * (y - q[{i + 1}]))" for i, q in enumerate(QUANTILES)) + f") / {len(QUANTILES)}"


@check("fold_calendar", f"WITH {FOLDS_SQL} SELECT f.*, count(o_orderkey) AS n_train FROM folds f LEFT JOIN orders ON o_orderdate >= train_start AND o_orderdate < train_end GROUP BY ALL")
def fold_calendar(t: Tables):
    n = spread_history(t.orders.select(F.to_date("o_orderdate").alias("delivery_date")), t.folds(), from_train_start=True).groupBy("fold").agg(F.count(F.lit(1)).alias("n_train"))
    return fold_table(t.spark, t.folds()).join(n, "fold", "left").na.fill(0, ["n_train"])


@check("fold_assignment", f"WITH {FOLDS_SQL} SELECT fold, train_end, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last FROM orders JOIN folds ON CAST(o_orderdate AS DATE) >= test_start AND CAST(o_orderdate AS DATE) < test_end GROUP BY 1, 2")
def fold_assignment(t: Tables):
    d = assign_test_fold(t.orders.select(F.to_date("o_orderdate").alias("delivery_date")), t.folds())
    return d.groupBy("fold", "train_end").agg(F.count(F.lit(1)).alias("n"), F.min("delivery_date").alias("first"), F.max("delivery_date").alias("last"))


@check("inner_fold_rows", f"""WITH {FOLDS_SQL}, o AS (SELECT * FROM folds WHERE fold = '2000-06'), m AS (SELECT fold, train_end, CAST(unnest(generate_series(date_trunc('month', train_end)::TIMESTAMP - INTERVAL 3 MONTH, date_trunc('month', train_end)::TIMESTAMP - INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS DATE) AS m FROM o)
SELECT fold || '/inner-' || strftime(m, '%Y-%m') AS fold, count(*) AS n FROM m JOIN orders ON CAST(o_orderdate AS DATE) >= m AND CAST(o_orderdate AS DATE) < least(CAST(m + INTERVAL 1 MONTH AS DATE), train_end) GROUP BY 1""")
def inner_fold_rows(t: Tables):
    outer = next(f for f in t.folds() if f.name == "2000-06")
    return assign_test_fold(t.orders.select(F.to_date("o_orderdate").alias("delivery_date")), inner_folds(outer)).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@check("naive_rules", f"""WITH {LAGGED_SQL} SELECT d, zone, coalesce(da_l1, da_l7) AS persist_da_d1, coalesce(da_l7, da_l1) AS weekly_da_d7, CASE WHEN isodow(d) BETWEEN 2 AND 5 THEN coalesce(da_l1, da_l7) ELSE coalesce(da_l7, da_l1) END AS lago_naive,
coalesce(rt_l2, da_l1, da_l7) AS persist_rt_d2 FROM lagged""")
def naive_rules(t: Tables):
    b = t.lagged_book().withColumnsRenamed({"da_l1": "lag_da_d1_total", "da_l7": "lag_da_d7_total", "rt_l2": "lag_rt_d2_total"}).withColumn("dow", F.weekday("d") + 1)
    return b.select("d", "zone", *[lag_forecast(r, "total").alias(r) for r in RULES])


# residuals are those of out-of-sample predictions, so they begin with the first fold
RESID_SQL = f"""{PRED_SQL}, {FOLDS_SQL}, err AS (SELECT f.fold, p.trial, p.market, p.zone, p.d, p.y - p.mean AS r FROM pred p JOIN folds f ON p.d < f.train_end AND p.d >= f.train_end - 365 WHERE p.mean IS NOT NULL AND p.trial <> 'm2' AND p.d >= DATE '{FOLD_START}'),
lastd AS (SELECT fold, trial, max(d) AS l FROM err GROUP BY 1, 2), rec AS (SELECT err.* FROM err JOIN lastd USING (fold, trial) WHERE d > l - 365),
cell AS (SELECT fold, trial, market, zone, quantile_cont(r, {LEVELS_SQL}) AS q, count(*) AS n FROM rec GROUP BY 1, 2, 3, 4),
oos AS (SELECT f.fold, p.d, p.zone, p.market, p.trial, p.mean, p.y, list_transform(c.q, lambda x: x + p.mean) AS q FROM pred p JOIN folds f ON p.d >= f.test_start AND p.d < f.test_end
  LEFT JOIN cell c ON c.fold = f.fold AND c.trial = p.trial AND c.market = p.market AND c.zone = p.zone WHERE p.trial <> 'm2')"""


def calibrated(t: Tables, trials: tuple = ("m1", "m7")):
    """Predictions with out-of-sample residual quantiles, trial by trial."""
    return oos_quantiles(t.predictions().filter(F.col("trial").isin(list(trials))), t.folds(), by=["trial"])


@check("residual_quantiles", f"WITH {RESID_SQL} SELECT fold, market, zone, n, {', '.join(f'round(q[{i + 1}], 6) AS {c}' for i, c in enumerate(QCOLS))} FROM cell WHERE trial = 'm1' AND n >= 60")
def residual_quantiles(t: Tables):
    p = parents(t, ("m1",))["m1"].filter(F.col("mean").isNotNull() & (F.col("delivery_date") >= F.lit(FOLD_START))).withColumn("r", F.col("y") - F.col("mean"))
    h = spread_history(p, t.folds(), 365)
    cell, _ = residual_tables(h.join(h.groupBy("fold").agg(F.max("delivery_date").alias("l")), "fold").filter(F.col("delivery_date") > F.date_sub("l", 365)), ["fold"])
    n = h.groupBy("fold", "market", "zone").agg(F.count("r").alias("n"))
    return rounded(cell.select("fold", "market", "zone", *Q.spread_array(F.col("_q"))).join(n, ["fold", "market", "zone"]))


@check("oos_fold_scores", f"""WITH {RESID_SQL}, z AS (SELECT *, unnest([zone, 'ALL']) AS zn FROM oos WHERE mean IS NOT NULL)
SELECT trial, market, zn AS zone, count(*) AS n, round(avg({CRPS_SQL}), 6) AS crps, round(avg({PINBALL_SQL}), 6) AS pinball_mean, round(avg(CASE WHEN y BETWEEN q[6] AND q[16] THEN 1.0 ELSE 0.0 END), 6) AS cov50,
round(avg(CASE WHEN y BETWEEN q[2] AND q[20] THEN 1.0 ELSE 0.0 END), 6) AS cov90, round(avg(CASE WHEN y BETWEEN q[1] AND q[21] THEN 1.0 ELSE 0.0 END), 6) AS cov98 FROM z WHERE q IS NOT NULL GROUP BY 1, 2, 3""")
def oos_fold_scores(t: Tables):
    c = with_total(calibrated(t).filter("mean IS NOT NULL").filter(Q.has_quantiles()))
    y = F.col("y")
    return rounded(c.groupBy("trial", "market", "zone").agg(
        F.count(F.lit(1)).alias("n"), F.avg(Q.crps(y)).alias("crps"), F.avg(Q.pinball_mean(y)).alias("pinball_mean"),
        *[F.avg(Q.covered(y, lo, hi)).alias(a) for a, lo, hi in (("cov50", "q25", "q75"), ("cov90", "q05", "q95"), ("cov98", "q01", "q99"))]))


@check("score_table", f"""WITH {PRED_SQL}, z AS (SELECT *, abs(y) AS a, abs(y - mean) AS e, unnest([zone, 'ALL']) AS zn FROM pred WHERE mean IS NOT NULL), cut AS (SELECT trial, market, zn, quantile_cont(a, 0.95) AS c FROM z GROUP BY 1, 2, 3)
SELECT trial, market, zn AS zone, count(*) AS n, round(avg(e), 6) AS mae, round(sqrt(avg((y - mean) * (y - mean))), 6) AS rmse, round(avg(e / ((a + abs(mean)) / 2)) FILTER ((a + abs(mean)) / 2 > 1e-9), 6) AS smape,
round(avg(e) FILTER (a >= c), 6) AS tail_mae, round(avg(e) FILTER (a < c), 6) AS normal_mae FROM z JOIN cut USING (trial, market, zn) GROUP BY 1, 2, 3""")
def scores(t: Tables):
    p = with_total(t.predictions().filter("mean IS NOT NULL"))
    return rounded(score_table(p, ["trial", "market", "zone"]))


@check("relative_mae", f"""WITH {PRED_SQL} SELECT a.market, count(*) AS n, round(avg(abs(a.y - a.mean)) / avg(abs(a.y - b.mean)), 6) AS rmae FROM pred a JOIN pred b USING (d, zone, market)
WHERE a.trial = 'm1' AND b.trial = 'm7' AND a.mean IS NOT NULL AND b.mean IS NOT NULL GROUP BY 1""")
def relative_mae(t: Tables):
    a = P.align(parents(t, ("m1", "m7"))).filter("m_0 IS NOT NULL AND m_1 IS NOT NULL")
    s = pooled_summary(a.select("*", F.col("m_0").alias("mean")).drop("ref_mean").withColumn("ref_mean", F.col("m_1")), [])
    return rounded(s.select("market", "n", "rmae"))


LOSS_SQL = f"""{PRED_SQL}, loss AS (SELECT trial, market, d AS day, avg((y - mean) * (y - mean)) AS se, round(avg(abs(y - mean)), 6) AS ae, count(*) AS n FROM pred WHERE mean IS NOT NULL GROUP BY 1, 2, 3)"""


def losses(t: Tables):
    return daily_losses(t.predictions(), ["trial", "market"]).withColumn("ae", F.round("ae", 6))


@check("daily_loss_table", f"WITH {LOSS_SQL} SELECT trial, market, day, round(se, 3) AS se, ae, n FROM loss")
def daily_loss_table(t: Tables):
    return losses(t).drop("crps").withColumn("se", F.round("se", 3))


DM_SQL = f"""{LOSS_SQL}, dd AS (SELECT a.market, a.day, a.ae - b.ae AS x FROM loss a JOIN loss b USING (market, day) WHERE a.trial = 'm1' AND b.trial = 'm7'),
m AS (SELECT market, count(*) AS n, avg(x) AS mu, CAST(floor(cbrt(count(*)) + 1e-9) AS INTEGER) AS lmax FROM dd GROUP BY 1), s AS (SELECT market, row_number() OVER (PARTITION BY market ORDER BY day) AS i, x - mu AS c FROM dd JOIN m USING (market)),
g AS (SELECT a.market, k, sum(a.c * b.c) / any_value(n) AS cov, any_value(lmax) AS lmax FROM s a JOIN m USING (market) JOIN (SELECT unnest(range(0, 40)) AS k) ks ON k <= lmax JOIN s b ON b.market = a.market AND b.i = a.i - k GROUP BY 1, 2),
v AS (SELECT market, sum(CASE WHEN k = 0 THEN cov ELSE 2 * (1 - k / (lmax + 1)) * cov END) AS v FROM g GROUP BY 1)"""


@check("diebold_mariano", f"WITH {DM_SQL} SELECT market, n AS n_days, round(mu, 6) AS mean_diff, round(mu / sqrt(v / n), 6) AS dm_stat FROM m JOIN v USING (market)")
def dm(t: Tables):
    l = losses(t)
    j = l.filter("trial = 'm1'").select("market", "day", F.col("ae").alias("a")).join(l.filter("trial = 'm7'").select("market", "day", F.col("ae").alias("b")), ["market", "day"])
    return rounded(diebold_mariano(j, ["market"], "day", "a", "b").drop("p_a_better"))


@check("kupiec_coverage", f"""WITH {RESID_SQL}, x AS (SELECT trial, market, CASE WHEN y BETWEEN q[2] AND q[20] THEN 0 ELSE 1 END AS miss FROM oos WHERE q IS NOT NULL AND mean IS NOT NULL), k AS (SELECT trial, market, count(*)::DOUBLE AS n, sum(miss)::DOUBLE AS x FROM x GROUP BY 1, 2)
SELECT trial, market, round(x / n, 6) AS miss_rate, round(-2 * ((n - x) * ln(0.9) + x * ln(0.1) - (n - x) * ln(1 - x / n) - x * ln(x / n)), 5) AS lr FROM k""")
def kupiec_coverage(t: Tables):
    c = calibrated(t).filter("mean IS NOT NULL").filter(Q.has_quantiles())
    k = kupiec(c, ["trial", "market"], ~F.col("y").between(F.col("q05"), F.col("q95")), 0.1).drop("p_value")
    return rounded(k.withColumn("lr", F.round("lr", 5)))


@check("christoffersen_counts", f"""WITH {RESID_SQL}, x AS (SELECT trial, market, zone, d, CASE WHEN y BETWEEN q[2] AND q[20] THEN 0 ELSE 1 END AS b FROM oos WHERE q IS NOT NULL AND mean IS NOT NULL),
p AS (SELECT *, lag(b) OVER (PARTITION BY trial, market, zone ORDER BY d) AS a FROM x), c AS (SELECT trial, market, zone, count(*) AS n, count(*) FILTER (a = 0 AND b = 0)::DOUBLE AS n00, count(*) FILTER (a = 0 AND b = 1)::DOUBLE AS n01,
count(*) FILTER (a = 1 AND b = 0)::DOUBLE AS n10, count(*) FILTER (a = 1 AND b = 1)::DOUBLE AS n11 FROM p GROUP BY 1, 2, 3), l AS (SELECT *, (n01 + n11) / (n00 + n01 + n10 + n11) AS pi, n01 / (n00 + n01) AS p0, n11 / nullif(n10 + n11, 0) AS p1 FROM c)
SELECT trial, market, zone, n, n00, n01, n10, n11, round(-2 * ((n00 + n10) * ln(1 - pi) + (n01 + n11) * ln(pi) - n00 * ln(1 - p0) - n01 * ln(p0)
 - CASE WHEN n10 > 0 THEN n10 * ln(1 - p1) ELSE 0 END - CASE WHEN n11 > 0 THEN n11 * ln(p1) ELSE 0 END), 5) AS lr FROM l""")
def christoffersen_counts(t: Tables):
    c = calibrated(t).filter("mean IS NOT NULL").filter(Q.has_quantiles())
    k = christoffersen(c, ["trial", "market", "zone"], "ts_utc", ~F.col("y").between(F.col("q05"), F.col("q95"))).drop("p_value")
    return rounded(k.withColumn("lr", F.round("lr", 5)))


@check("fold_win_rate", f"""WITH {PRED_SQL}, {FOLDS_SQL}, s AS (SELECT fold, a.market, avg(abs(a.y - a.mean)) / avg(abs(a.y - b.mean)) AS v FROM pred a JOIN pred b USING (d, zone, market) JOIN folds f ON a.d >= test_start AND a.d < test_end
WHERE a.trial = 'm1' AND b.trial = 'm7' AND a.mean IS NOT NULL AND b.mean IS NOT NULL GROUP BY 1, 2) SELECT market, count(*) AS folds, round(avg(CASE WHEN v < 1 THEN 1.0 ELSE 0.0 END), 6) AS frac_folds_beat_ref, round(median(v), 6) AS median_fold_rmae FROM s GROUP BY 1""")
def win_rate(t: Tables):
    a = assign_test_fold(P.align(parents(t, ("m1", "m7"))).filter("m_0 IS NOT NULL AND m_1 IS NOT NULL"), t.folds())
    s = a.groupBy("fold", "market").agg((F.avg(F.abs(F.col("y") - F.col("m_0"))) / F.avg(F.abs(F.col("y") - F.col("m_1")))).alias("value"))
    s = s.withColumns({"metric": F.lit("rmae"), "component": F.lit("total"), "zone": F.lit("ALL")})
    return rounded(fold_win_rate(s, ["market"]))


@check("clip_to_history", f"""WITH {PRED_SQL}, {FOLDS_SQL}, h AS (SELECT f.fold, p.market, p.zone, min(p.y) AS lo, max(p.y) AS hi FROM pred p JOIN folds f ON p.d < f.train_end WHERE trial = 'm7' GROUP BY 1, 2, 3)
SELECT f.fold, p.d AS delivery_date, p.zone, p.market, CASE WHEN p.mean IS NOT NULL THEN round(least(greatest(p.mean * 1.5, lo), hi), 6) END AS mean FROM pred p JOIN folds f ON p.d >= f.test_start AND p.d < f.test_end LEFT JOIN h USING (fold, market, zone) WHERE trial = 'm7'""")
def clip_history(t: Tables):
    p = parents(t, ("m7",))["m7"]
    hist = p.select("delivery_date", *P.CELL, F.col("y").alias("v"))
    out = P.clip_long(p.withColumn("mean", F.col("mean") * 1.5), hist, t.folds())
    return rounded(out.select("fold", "delivery_date", "zone", "market", "mean"))


ALIGN_SQL = f"""{PRED_SQL}, {FOLDS_SQL}, al AS MATERIALIZED (SELECT a.d, a.zone, a.market, a.y, a.mean AS m0, b.mean AS m1, c.mean AS m2 FROM pred a JOIN pred b USING (d, zone, market) JOIN pred c USING (d, zone, market) WHERE a.trial = 'm1' AND b.trial = 'm7' AND c.trial = 'm2')"""


@check("combine_equal", f"WITH {ALIGN_SQL} SELECT fold, d AS delivery_date, zone, market, round((m0 + m1 + m2) / 3, 6) AS mean FROM al JOIN folds ON d >= test_start AND d < test_end")
def combine_equal(t: Tables):
    return rounded(P.combine(parents(t), t.folds(), "equal").select("fold", "delivery_date", "zone", "market", "mean"))


@check("combine_median", f"WITH {ALIGN_SQL} SELECT fold, d AS delivery_date, zone, market, round(list_aggregate([m0, m1, m2], 'median'), 6) AS mean FROM al JOIN folds ON d >= test_start AND d < test_end")
def combine_median(t: Tables):
    return rounded(P.combine(parents(t), t.folds(), "median").select("fold", "delivery_date", "zone", "market", "mean"))


@check("combine_inverse_mae", f"""WITH {ALIGN_SQL}, w AS (SELECT fold, market, 1 / avg(abs(m0 - y)) AS i0, 1 / avg(abs(m1 - y)) AS i1, 1 / avg(abs(m2 - y)) AS i2 FROM al JOIN folds ON d < train_end AND d >= train_end - 365 GROUP BY 1, 2)
SELECT f.fold, d AS delivery_date, zone, al.market, round((i0 * m0 + i1 * m1 + i2 * m2) / (i0 + i1 + i2), 6) AS mean FROM al JOIN folds f ON d >= test_start AND d < test_end JOIN w ON w.fold = f.fold AND w.market = al.market""")
def combine_inverse(t: Tables):
    return rounded(P.combine(parents(t), t.folds(), "inv_mae").select("fold", "delivery_date", "zone", "market", "mean"))


@check("select_variants", f"WITH {ALIGN_SQL} SELECT d AS delivery_date, zone, market, round(list_aggregate(list_filter([m0, m2], lambda x: x IS NOT NULL), 'avg'), 6) AS mean FROM al")
def select_variants(t: Tables):
    a = P.align(parents(t)).withColumnsRenamed({"m_0": "mean_w56", "m_1": "mean_w364", "m_2": "mean_wall"})
    return rounded(P.select_windows(a, ["w56", "wall"]).select("delivery_date", "zone", "market", "mean"))


@check("assemble_components", f"""WITH {ALIGN_SQL}, e AS (SELECT d, zone, market, round(m0 * 0.6, 6) AS en, round(m0 * 0.1, 6) AS lo, round(m1 * 0.3, 6) AS co FROM al)
SELECT d AS delivery_date, zone, market, 'energy' AS component, en AS mean FROM e UNION ALL SELECT d, zone, market, 'loss', lo FROM e UNION ALL SELECT d, zone, market, 'congestion', co FROM e
UNION ALL SELECT d, zone, market, 'total', round(en + lo + co, 6) FROM e""")
def assemble_components(t: Tables):
    def split(p):
        rows = F.array(*[F.struct(F.lit(c).alias("component"), F.round(F.col("mean") * k, 6).alias("mean")) for c, k in (("energy", 0.6), ("loss", 0.1), ("congestion", 0.3), ("total", 1.0))])
        return p.withColumn("_r", F.explode(rows)).withColumns({"component": F.col("_r.component"), "mean": F.col("_r.mean")}).drop("_r")

    p = {n: split(d) for n, d in parents(t, ("m1", "m7")).items()}
    return rounded(P.assemble(p, {"energy": "m1", "loss": "m1", "congestion": "m7"}).select("delivery_date", "zone", "market", "component", "mean"))


@check("distribution_mean_scale", f"""WITH {RESID_SQL} SELECT trial, market, d AS delivery_date, zone, round(list_sum(q[2:20]) / 19, 6) AS dmean, round((q[20] - q[2]) / 3.29, 6) AS sd,
round((1 - 1.0::DOUBLE / 3) * list_sum(q[2:20]) / 19 + 1.0::DOUBLE / 3 * 90, 6) AS mixed FROM oos WHERE q IS NOT NULL AND q[1] IS NOT NULL""")
def distribution_mean_scale(t: Tables):
    c = calibrated(t).filter(Q.has_quantiles())
    return rounded(c.select("trial", "market", "delivery_date", "zone", Q.distribution_mean().alias("dmean"), Q.distribution_scale().alias("sd"),
                            Q.mixture_mean(Q.distribution_mean(), F.lit(90.0), F.lit(1 / 3)).alias("mixed")))


@check("common_row_scores", f"""WITH {RESID_SQL}, a AS (SELECT * FROM oos WHERE trial = 'm1' AND q IS NOT NULL AND q[1] IS NOT NULL), b AS (SELECT * FROM oos WHERE trial = 'm7' AND q IS NOT NULL AND q[1] IS NOT NULL AND isodow(d) < 6),
u AS (SELECT * FROM a SEMI JOIN b USING (d, zone, market) UNION ALL SELECT * FROM b SEMI JOIN a USING (d, zone, market))
SELECT trial AS model, market, count(DISTINCT d) AS days, count(*) AS n, round(avg({CRPS_SQL}), 6) AS crps, round(sqrt(avg((mean - y) * (mean - y))), 6) AS rmse, round(avg(CASE WHEN y BETWEEN q[2] AND q[20] THEN 1.0 ELSE 0.0 END), 6) AS cov90 FROM u GROUP BY 1, 2""")
def common_rows(t: Tables):
    c = calibrated(t).filter(Q.has_quantiles())
    truth = c.filter("trial = 'm1'").select("ts_utc", "zone", "market", "y")
    f = {"m1": c.filter("trial = 'm1'").drop("y"), "m7": c.filter("trial = 'm7' AND weekday(delivery_date) < 5").drop("y")}
    return rounded(common_row_scores(f, truth, ["ts_utc", "zone", "market"]))


@check("adaptive_conformal")
def adaptive_conformal(t: Tables):
    """Sequential state per series: no SQL form.  Checked against a direct loop in the tests."""
    c = P.calibrate_aci(parents(t, ("m1",))["m1"])
    return rounded(c.select("delivery_date", "zone", "market", "mean", "y", *QCOLS))


@check("spike_mixture")
def mixture(t: Tables):
    c = calibrated(t, ("m1",)).filter("market = 'rt'").drop("trial")
    spike = c.withColumns({q: F.col(q) + 40 for q in QCOLS} | {"mean": F.col("mean") + 40, "p_spike": F.lit(0.1)})
    return rounded(P.spike_mixture(c, spike).select("delivery_date", "zone", "mean", *QCOLS))


@check("day_grid_filled")
def day_grid_filled(t: Tables):
    """Hourly means on a 24-hour grid per type and day with linear fill."""
    e = t.events.select("event_type", F.to_date("ts").alias("d"), F.hour("ts").alias("hr"), "value")
    return rounded(day_grid(e, ["event_type", "d"], "hr", "value").select("event_type", "d", F.posexplode("h").alias("hr", "value")))
