"""Positions, P&L, limits, forward record, path contracts, monthly products."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from wattline.checks.base import BOOK_SQL, FOLDS_SQL, LAGGED_SQL, LOCAL, Tables, check, rounded
from wattline.checks.scoring import calibrated
from wattline.operators.reshape import wide_with_quantiles
from wattline.plans import monthly, paths, pricing, trading

KEYS = ["delivery_date", "ts_utc", "zone", "hour_local"]


def signal(t: Tables):
    """Forecast means: lag 1 for da, lag 2 for rt; interval half-widths 8 and 12."""
    b = t.lagged_book().filter("da_l1 IS NOT NULL AND rt_l2 IS NOT NULL")
    return b.select(F.col("d").alias("delivery_date"), F.col("d").cast("timestamp").alias("ts_utc"), "zone", F.lit(0).alias("hour_local"), F.col("da_l1").alias("mean_da"), F.col("rt_l2").alias("mean_rt"),
                    *[(F.col(c) + k).alias(n) for n, c, k in (("q05_da", "da_l1", -8.0), ("q95_da", "da_l1", 8.0), ("q05_rt", "rt_l2", -12.0), ("q95_rt", "rt_l2", 12.0))],
                    F.col("da").alias("y_da"), F.col("rt").alias("y_rt"), "da_l7", "da_l2")


def positions(t: Tables):
    w = signal(t)
    lags = w.select("ts_utc", "zone", F.col("da_l7").alias("lag_da_d1_total"), F.col("da_l2").alias("lag_rt_d2_total"))
    return trading.positions_v1(w.drop("da_l7", "da_l2"), lags)


POS_SQL = f"""{LAGGED_SQL}, w AS (SELECT d, zone, da, rt, da_l1 - rt_l2 AS s, sqrt((16 / 3.29) ** 2 + (24 / 3.29) ** 2) AS sc, coalesce(sign(da_l7 - da_l2), 0)::DOUBLE AS xp FROM lagged WHERE da_l1 IS NOT NULL AND rt_l2 IS NOT NULL),
pos AS (SELECT d, zone, da - rt AS spread, CASE WHEN abs(s) > 0.5 THEN greatest(-1, least(1, s / sc)) ELSE 0 END AS xs, xp, -1.0::DOUBLE AS xd FROM w),
tr AS (SELECT d, zone, spread, 'signal' AS strategy, xs AS x, xs * spread - 0.5 * abs(xs) AS pnl FROM pos UNION ALL SELECT d, zone, spread, 'persistence', xp, xp * spread - 0.5 * abs(xp) FROM pos
UNION ALL SELECT d, zone, spread, 'always_dec', xd, xd * spread - 0.5 * abs(xd) FROM pos)"""


def trades(t: Tables):
    return trading.melt_strategies(positions(t), ["signal", "persistence", "always_dec"], ["delivery_date", "zone", "spread"])


@check("rule_positions", f"WITH {POS_SQL} SELECT d AS delivery_date, zone, strategy, round(x, 5) AS x, round(pnl, 5) AS pnl FROM tr")
def rule_positions(t: Tables):
    return rounded(trades(t).drop("spread"), 5)


STAT_SQL = f"""{POS_SQL}, dl AS (SELECT strategy, d, sum(pnl) AS p FROM tr GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER (PARTITION BY strategy ORDER BY d) AS cum FROM dl), dd AS (SELECT *, cum - max(cum) OVER (PARTITION BY strategy ORDER BY d) AS draw FROM c),
tp AS (SELECT strategy, sum(p) AS top FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY abs(p) DESC, d) AS r, count(*) OVER (PARTITION BY strategy) AS n FROM dl) WHERE r <= greatest(1, n // 100) GROUP BY 1),
rw AS (SELECT strategy, sum(abs(x)) AS mwh, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) FILTER (x <> 0) AS hit FROM tr GROUP BY 1)"""


@check("strategy_statistics", f"""WITH {STAT_SQL} SELECT strategy, count(*) AS days, round(sum(p), 4) AS pnl_total, round(sum(p) / any_value(mwh), 5) AS pnl_per_mwh, round(any_value(mwh), 4) AS mwh_traded, round(any_value(hit), 5) AS hit_rate,
round(avg(p) / stddev_samp(p) * sqrt(365), 5) AS sharpe_ann, round(min(draw), 4) AS max_drawdown, round(sum(p) FILTER (d <> DATE '1998-06-09'), 4) AS pnl_excluding, round(any_value(top) / sum(p), 5) AS top1pct_days_share FROM dd JOIN tp USING (strategy) JOIN rw USING (strategy) GROUP BY 1""")
def strategy_statistics(t: Tables):
    s = trading.strategy_stats(trades(t), ["strategy"], [date(1998, 6, 9)])
    s = rounded(s, 5)
    return s.withColumns({c: F.round(c, 4) for c in ("pnl_total", "mwh_traded", "max_drawdown", "pnl_excluding")})


@check("cost_sensitivity", f"WITH {POS_SQL} SELECT strategy, round(sum(pnl + 0.25 * abs(x)), 4) AS cost_025, round(sum(pnl), 4) AS cost_050, round(sum(pnl - 0.5 * abs(x)), 4) AS cost_100 FROM tr GROUP BY 1")
def cost_sensitivity(t: Tables):
    return rounded(trading.cost_table(trades(t), ["strategy"]), 4)


@check("directional_skill", f"WITH {POS_SQL} SELECT zone, round(avg(spread) FILTER (x > 0), 5) AS mean_spread_when_inc, round(avg(spread) FILTER (x < 0), 5) AS mean_spread_when_dec, round(corr(x, spread), 5) AS corr_signed_mw_spread FROM tr WHERE strategy = 'signal' GROUP BY 1")
def directional_skill(t: Tables):
    return rounded(trading.skill_table(trades(t).filter("strategy = 'signal'"), ["zone"]), 5)


@check("period_pnl", f"WITH {POS_SQL} SELECT strategy, CASE WHEN d < DATE '1997-01-01' THEN 0 WHEN d < DATE '1999-01-01' THEN 1 ELSE 2 END AS period, round(sum(pnl), 4) AS pnl FROM tr GROUP BY 1, 2")
def period_pnl(t: Tables):
    return rounded(trading.period_table(trades(t), ["strategy"], [date(1997, 1, 1), date(1999, 1, 1)]), 4)


@check("residual_correlation", f"""WITH {LAGGED_SQL} SELECT zone, round(corr(da - da_l1, rt - rt_l2), 6) AS rho FROM lagged WHERE da_l1 IS NOT NULL AND rt_l2 IS NOT NULL AND d < DATE '1999-12-25' AND d >= DATE '1999-12-25' - 365 GROUP BY 1""")
def residual_correlation(t: Tables):
    f = [x for x in t.folds() if x.name == "2000-01"]
    r = signal(t).select("delivery_date", "zone", (F.col("y_da") - F.col("mean_da")).alias("r_da"), (F.col("y_rt") - F.col("mean_rt")).alias("r_rt"))
    return rounded(trading.fold_rho(r, f).drop("fold"))


@check("residual_correlation_folds", f"""WITH {LAGGED_SQL}, {FOLDS_SQL} SELECT fold, zone, round(corr(da - da_l1, rt - rt_l2), 6) AS rho FROM lagged JOIN folds ON d < train_end AND d >= train_end - 365 WHERE da_l1 IS NOT NULL AND rt_l2 IS NOT NULL GROUP BY 1, 2""")
def residual_correlation_folds(t: Tables):
    r = signal(t).select("delivery_date", "zone", (F.col("y_da") - F.col("mean_da")).alias("r_da"), (F.col("y_rt") - F.col("mean_rt")).alias("r_rt"))
    return rounded(trading.fold_rho(r, t.folds()))


@check("correlated_positions", f"""WITH {LAGGED_SQL}, w AS (SELECT d, zone, da_l1 - rt_l2 AS s, sqrt(greatest(5.0 ** 2 + 7.0 ** 2 - 2 * 0.3 * 5.0 * 7.0, 1e-6)) AS sc FROM lagged WHERE da_l1 IS NOT NULL AND rt_l2 IS NOT NULL)
SELECT d AS delivery_date, zone, round(s, 4) AS spread_fcst, round(sc, 6) AS spread_scale, round(CASE WHEN abs(s) > 0.5 THEN greatest(-1, least(1, s / sc)) ELSE 0 END, 5) AS x_mw FROM w""")
def correlated_positions(t: Tables):
    s, sc, x = trading.position_v2(F.col("mean_da"), F.col("mean_rt"), F.lit(5.0), F.lit(7.0), F.lit(0.3))
    return signal(t).select("delivery_date", "zone", F.round(s, 4).alias("spread_fcst"), F.round(sc, 6).alias("spread_scale"), F.round(x, 5).alias("x_mw"))


@check("paper_pnl", f"""WITH {POS_SQL}, g AS (SELECT d AS delivery_date, sum(abs(x)) AS mwh, sum(x) AS net_mw, sum(pnl) AS pnl FROM tr WHERE strategy = 'signal' GROUP BY 1)
SELECT delivery_date, round(mwh, 5) AS mwh, round(net_mw, 5) AS net_mw, round(pnl, 4) AS pnl, round(sum(pnl) OVER (ORDER BY delivery_date), 3) AS cum_pnl FROM g""")
def paper(t: Tables):
    p = positions(t)
    out = trading.paper_pnl(p.select("delivery_date", "ts_utc", "zone", F.col("x_signal").alias("x_mw")), p.select("ts_utc", "zone", "y_da", "y_rt"))
    return out.select("delivery_date", *[F.round(c, k).alias(c) for c, k in (("mwh", 5), ("net_mw", 5), ("pnl", 4), ("cum_pnl", 3))])


@check("naive_last_spread", f"""WITH {BOOK_SQL} SELECT b.d AS delivery_date, b.zone, coalesce(sign(a.da - a.rt), 0)::DOUBLE AS x_naive FROM book b LEFT JOIN book a ON a.zone = b.zone AND a.d = b.d - 2""")
def last_spread(t: Tables):
    b = t.book().select(F.col("d").alias("delivery_date"), F.col("d").cast("timestamp").alias("ts_utc"), "zone", F.col("da").alias("y_da"), F.col("rt").alias("y_rt"))
    return trading.naive_last_spread(b).select("delivery_date", "zone", "x_naive")


@check("counted_forward_days", f"""WITH {BOOK_SQL}, x AS (SELECT d, zone, timezone('UTC', timezone('America/New_York', CAST(d - 1 AS TIMESTAMP) + INTERVAL 5 HOUR)) AS deadline, CAST(d - 1 AS TIMESTAMP) + to_hours(CASE WHEN da > 45 THEN 12 ELSE 8 END) AS created, CASE WHEN rt < 60 THEN rt END AS y_rt, da AS y_da FROM book WHERE d >= DATE '1998-01-01'),
ok AS (SELECT d FROM x WHERE created <= deadline GROUP BY 1 HAVING count(*) >= 2 AND count(y_rt) = count(*)) SELECT d AS delivery_date, zone, y_da, y_rt FROM x WHERE created <= deadline AND d IN (SELECT d FROM ok)""")
def counted(t: Tables):
    b = t.book().select(F.col("d").alias("delivery_date"), F.col("d").cast("timestamp").alias("ts_utc"), "zone", "da", "rt")
    created = F.date_sub("delivery_date", 1).cast("timestamp") + F.make_dt_interval(hours=F.when(F.col("da") > 45, 12).otherwise(8))
    out = b.select("ts_utc", "zone", F.col("da").alias("y_da"), F.when(F.col("rt") < 60, F.col("rt")).alias("y_rt"))
    c = trading.counted_days(b.select("delivery_date", "ts_utc", "zone", created.alias("created_utc")), out, date(1998, 1, 1), 2)
    return c.select("delivery_date", "zone", "y_da", "y_rt")


PRICED_SQL = f"""{BOOK_SQL}, p AS (SELECT d, zone, least(da / 50, 1.0) AS xc, rt / 10 AS loss99, 0.8 AS pc, da AS q99, CASE WHEN da > 45 THEN 1 WHEN da < 30 THEN -1 ELSE 0 END AS side, 40.0 AS bid, da AS y_da, rt AS y_rt FROM book),
sc AS (SELECT d, least(1, CASE WHEN sum(xc * loss99) > 0 THEN 12 / sum(xc * loss99) ELSE 1 END, CASE WHEN sum(xc * pc * greatest(q99, 0)) > 0 THEN 130 / sum(xc * pc * greatest(q99, 0)) ELSE 1 END) AS k FROM p GROUP BY 1),
r AS (SELECT p.*, k, xc * k AS x, CASE WHEN side <> 0 AND side * y_da >= side * bid THEN xc * k ELSE 0 END AS xe FROM p JOIN sc USING (d))"""


def priced(t: Tables):
    b = t.book().select(F.col("d").alias("delivery_date"), F.col("d").cast("timestamp").alias("ts_utc"), "zone", F.lit(0).alias("hour_local"), (F.col("da") / 50).alias("x_pre"), (F.col("rt") / 10).alias("loss99"),
                        F.lit(0.8).alias("p_clear"), F.col("da").alias("da_q99"), F.when(F.col("da") > 45, 1).when(F.col("da") < 30, -1).otherwise(0).alias("side"), F.lit(40.0).alias("bid_price"), F.col("da").alias("y_da"), F.col("rt").alias("y_rt"))
    return pricing.realise(pricing.apply_limits(b, pricing.Limits(1.0, 12.0, 130.0)))


@check("limits_and_clearing", f"WITH {PRICED_SQL} SELECT d AS delivery_date, zone, round(k, 6) AS limit_scale, round(x, 6) AS x, round(xe, 6) AS x_eff, round(xe * (side * (y_da - y_rt) - 0.5), 5) AS pnl FROM r")
def limits(t: Tables):
    return rounded(priced(t).select("delivery_date", "zone", "limit_scale", "x", "x_eff", F.round("pnl", 5).alias("pnl")))


@check("shuffled_outcome_null")
def outcome_null(t: Tables):
    return rounded(pricing.null_table(priced(t)), 4)


def _wide(t: Tables):
    return wide_with_quantiles(calibrated(t, ("m1",)), KEYS)


def _hours(t: Tables):
    """The book as one zone whose hours are the order priorities: a year then holds the history that a copula asks for."""
    hour = F.substring("zone", 1, 1).cast("int")
    return _wide(t).withColumns({"hour_local": hour, "ts_utc": F.col("ts_utc") + F.make_dt_interval(hours=hour), "zone": F.lit("ALL")})


@check("bid_curve_backtest")
def bid_curve(t: Tables):
    """Draw-based pricing; no SQL form.  The map runs without a shuffle of draws."""
    p = pricing.backtest(_wide(t), t.folds())
    return rounded(p.select("delivery_date", "zone", "side", "bid_price", "p_clear", "x", "pnl"), 4)


@check("bid_curve_backtest_copula")
def bid_curve_copula(t: Tables):
    p = pricing.backtest(_hours(t), t.folds())
    return rounded(p.select("delivery_date", "hour_local", "rho", "side", "bid_price", "p_clear", "x", "pnl"), 4)


@check("joint_scenarios")
def joint_scenarios(t: Tables):
    s = pricing.spread_forecast(_wide(t), t.folds(), "indep")
    return rounded(s.select("delivery_date", "zone", "y", "mean", "q05", "q50", "q95", "pit"), 4)


@check("joint_scenarios_gauss")
def joint_scenarios_gauss(t: Tables):
    s = pricing.spread_forecast(_hours(t), t.folds())
    return rounded(s.select("delivery_date", "hour_local", "rho", "y", "mean", "q05", "q50", "q95", "pit"), 4)


@check("joint_scenarios_emp")
def joint_scenarios_emp(t: Tables):
    s = pricing.spread_forecast(_hours(t), t.folds(), "emp")
    return rounded(s.select("delivery_date", "hour_local", "y", "mean", "q05", "q50", "q95", "pit"), 4)


@check("tail_splice")
def tail_splice(t: Tables):
    c = calibrated(t, ("m1",)).filter("market = 'rt'").drop("trial")
    s = pricing.splice_tail(c, t.folds())
    return rounded(s.select("delivery_date", "zone", "q90", "q95", "q99"), 4)


# ------------------------------------------------------------------------------------------ path contracts
# points = suppliers with congestion per ship day, auctions = ship months, paths = supplier to part's first supplier

AWARD_SQL = """aw AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS round_id, o_custkey % 3 AS period_id, o_custkey % 40 AS poi, (o_custkey * 7 + 1) % 40 AS pow, ((o_custkey * 31) % 40 - 10)::DOUBLE * 100 AS mcp0, o_totalprice, CAST(date_trunc('month', o_orderdate) AS DATE) AS posted FROM orders)"""


def awards(t: Tables):
    m = F.trunc("o_orderdate", "MM")
    o = t.orders
    a = o.select((F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("round_id"), (F.col("o_custkey") % 3).alias("period_id"), (F.col("o_custkey") % 40).alias("poi"), ((F.col("o_custkey") * 7 + 1) % 40).alias("pow"),
                 F.lit(1).cast("bigint").alias("tccs_awarded"), m.alias("posted_date"), F.add_months(m, 1).alias("period_start"), F.date_sub(F.add_months(m, 2), 1).alias("period_end"), F.lit(1).alias("period_months"))
    price = ((F.col("poi") * 31 + F.col("pow") * 17 + F.col("period_id") * 5 + F.col("round_id")) % 40 - 10).cast("double")
    return a.withColumn("mcp", price)


def rounds(t: Tables):
    return awards(t).select("round_id").distinct().withColumns({"kind": F.lit("monthly"), "term_months": F.lit(1)})


PATH_SQL = """aw AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS round_id, o_custkey % 3 AS period_id, o_custkey % 40 AS poi, (o_custkey * 7 + 1) % 40 AS pow, CAST(date_trunc('month', o_orderdate) AS DATE) AS posted FROM orders),
pa AS (SELECT round_id, period_id, poi, pow, ((poi * 31 + pow * 17 + period_id * 5 + round_id) % 40 - 10)::DOUBLE AS c, count(*) AS mw, any_value(posted) AS posted, CAST(any_value(posted) + INTERVAL 1 MONTH AS DATE) AS a, CAST(any_value(posted) + INTERVAL 2 MONTH AS DATE) - 1 AS b FROM aw GROUP BY ALL)"""


@check("auction_paths", f"WITH {PATH_SQL} SELECT round_id, period_id, poi, pow, c, mw, posted, a AS start, b AS \"end\" FROM pa")
def auction_paths(t: Tables):
    p = paths.auction_paths(awards(t), rounds(t))
    return p.select("round_id", "period_id", "poi", "pow", "c", "mw", "posted", "start", "end")


@check("illiquid_paths", f"""WITH {PATH_SQL} SELECT p.round_id, p.period_id, p.poi, p.pow, (p.poi < 20 OR p.pow < 20) AND NOT EXISTS (SELECT 1 FROM pa q WHERE q.poi = p.poi AND q.pow = p.pow AND q.posted < p.posted AND q.posted >= p.posted - INTERVAL 24 MONTH) AS illiquid FROM pa p""")
def illiquid(t: Tables):
    p = paths.auction_paths(awards(t), rounds(t))
    nodes = t.supplier.filter("s_suppkey < 20").select(F.col("s_suppkey").alias("ptid"))
    return paths.illiquid_flag(p, nodes).select("round_id", "period_id", "poi", "pow", "illiquid")


CONG_SQL = """cg AS (SELECT l_suppkey % 40 AS ptid, l_shipdate + INTERVAL 12 HOUR AS ts, floor(avg(l_quantity) * 100 + 0.5) / 100 AS cong FROM lineitem GROUP BY 1, 2)"""


@check("realised_path_payoff", f"""WITH {PATH_SQL}, {CONG_SQL}, pr AS (SELECT DISTINCT poi, pow, a, b FROM pa), h AS (SELECT p.poi, p.pow, s.ts, k.cong - s.cong AS x FROM (SELECT DISTINCT poi, pow FROM pr) p JOIN cg s ON s.ptid = p.poi JOIN cg k ON k.ptid = p.pow AND k.ts = s.ts)
SELECT p.poi, p.pow, p.a, round(sum(x), 4) AS payoff, count(x) AS hours FROM pr p LEFT JOIN h ON h.poi = p.poi AND h.pow = p.pow AND CAST({LOCAL.format('h.ts')} AS DATE) BETWEEN p.a AND p.b GROUP BY 1, 2, 3""")
def path_payoff(t: Tables):
    cong = t.lineitem.groupBy((F.col("l_suppkey") % 40).alias("ptid"), (F.col("l_shipdate") + F.expr("INTERVAL 12 HOUR")).alias("ts_utc")).agg((F.floor(F.avg("l_quantity") * 100 + 0.5) / 100).alias("cong"))
    p = paths.auction_paths(awards(t), rounds(t)).select("poi", "pow", F.col("start").alias("a"), F.col("end").alias("b")).distinct().withColumn("ask", F.struct("poi", "pow", "a"))
    return rounded(paths.span_payoff(cong, p).select("poi", "pow", "a", "payoff", "hours"), 4)


EDGE_SQL = f"""{PATH_SQL}, ob AS (SELECT round_id AS auction, poi || '>' || pow AS path, 'k' || period_id AS kind, c, (poi - pow) * 3.0::DOUBLE AS y, (poi - 20) * 2.0::DOUBLE AS f, CASE WHEN poi > 5 THEN c * 0.5 END AS persistence FROM pa),
ed AS (SELECT *, f - c AS s, y - c AS o, 0.02 * abs(c) + 0.5 AS cost FROM ob)"""


def observations(t: Tables):
    p = paths.auction_paths(awards(t), rounds(t))
    return p.select(F.col("round_id").alias("auction"), F.concat_ws(">", F.col("poi").cast("string"), F.col("pow").cast("string")).alias("path"), F.concat(F.lit("k"), "period_id").alias("kind"), "c", F.lit(1).alias("months"),
                    ((F.col("poi") - F.col("pow")) * 3.0).alias("y"), ((F.col("poi") - 20) * 2.0).alias("f"), F.when(F.col("poi") > 5, F.col("c") * 0.5).alias("persistence"), F.col("c").alias("climatology"))


@check("buy_rule_edge", f"WITH {EDGE_SQL} SELECT auction, count(*) AS n, round(sum(CASE WHEN s > cost THEN o - cost END), 4) AS pnl, count(*) FILTER (s > cost) AS trades FROM ed GROUP BY 1")
def buy_rule(t: Tables):
    e = paths.edge(observations(t), "f")
    return rounded(e.groupBy("auction").agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("pnl"), F.count("pnl").alias("trades")), 4)


@check("path_accuracy", f"""WITH {EDGE_SQL}, r AS (SELECT kind, unnest(['c', 'persistence', 'f']) AS forecast, unnest([y - c, y - persistence, y - f]) AS e FROM ob WHERE persistence IS NOT NULL)
SELECT kind, forecast, count(*) AS n, round(avg(abs(e)), 5) AS mae, round(sqrt(avg(e * e)), 5) AS rmse, round(avg(e), 5) AS bias FROM r GROUP BY 1, 2""")
def path_accuracy(t: Tables):
    return rounded(paths.accuracy(observations(t), ["c", "persistence", "f"], ["kind"]), 5)


@check("path_universe", f"WITH {EDGE_SQL} SELECT kind, count(DISTINCT auction) AS auction_periods, count(*) AS path_periods, count(y) AS with_payoff, count(persistence) AS with_all_baselines FROM ob GROUP BY 1")
def path_universe(t: Tables):
    return paths.universe(observations(t))


@check("path_summary")
def path_summary(t: Tables):
    return rounded(paths.summarise(observations(t), "f"), 4)


# ------------------------------------------------------------------------------------------ monthly products

MONTH_SQL = f"""{BOOK_SQL}, ac AS (SELECT CAST(date_trunc('month', d) AS DATE) AS month, zone, CASE WHEN isodow(d) < 6 THEN 'peak' ELSE 'offpeak' END AS period, floor(CAST(sum(CAST(da AS DECIMAL(18,4))) AS DOUBLE) / count(*) * 10000 + 0.5) / 10000 AS total, floor(CAST(sum(CAST(rt AS DECIMAL(18,4)) - CAST(da AS DECIMAL(18,4))) AS DOUBLE) / count(*) * 10000 + 0.5) / 10000 AS congestion FROM book GROUP BY 1, 2, 3),
v AS (SELECT m AS month, h, CAST(m - to_months(CAST(h - 1 AS INTEGER)) AS DATE) - 7 AS cutoff FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '1998-01-01', (SELECT date_trunc('month', max(d)) FROM book), INTERVAL 1 MONTH)) AS DATE) AS m), (SELECT unnest(range(1, 7)) AS h)),
kn AS (SELECT v.month, v.h, v.cutoff, a.month AS km, a.zone, a.period, a.total, a.congestion FROM v JOIN ac a ON CAST(a.month + INTERVAL 1 MONTH AS DATE) <= v.cutoff)"""


def _monthly(t: Tables):
    b = t.book()
    def up(c):
        return F.floor(F.sum(c).cast("double") / F.count(F.lit(1)) * 10000 + 0.5) / 10000

    da, rt = F.col("da").cast("decimal(18,4)"), F.col("rt").cast("decimal(18,4)")
    a = b.groupBy(F.trunc("d", "MM").alias("month"), "zone", F.when(F.weekday("d") < 5, "peak").otherwise("offpeak").alias("period")).agg(up(da).alias("total"), up(rt - da).alias("congestion"))
    gas = b.groupBy(F.col("d").alias("trade_date")).agg(F.avg("rt").alias("hh"))
    return a, gas


@check("monthly_points", f"""WITH {MONTH_SQL}, n AS (SELECT month, h, zone, period, avg(total) AS nt, avg(congestion) AS nc, max(total) FILTER (km = month - INTERVAL 12 MONTH) AS yt FROM kn WHERE month(km) = month(month) AND km < month GROUP BY 1, 2, 3, 4),
l AS (SELECT month, h, max(km) AS lm FROM kn GROUP BY 1, 2), p AS (SELECT kn.month, kn.h, zone, period, total, congestion FROM kn JOIN l ON l.month = kn.month AND l.h = kn.h AND km = lm), u AS (SELECT DISTINCT zone, period FROM ac)
SELECT v.month, CAST(v.h AS INTEGER) AS h, v.cutoff, u.zone, u.period, round(nt, 7) AS m5_norm_total, round(nc, 7) AS m5_norm_congestion, yt AS m5_lastyear_total, p.total AS m5_persist_total, p.congestion AS m5_persist_congestion
FROM v CROSS JOIN u LEFT JOIN n ON n.month = v.month AND n.h = v.h AND n.zone = u.zone AND n.period = u.period LEFT JOIN p ON p.month = v.month AND p.h = v.h AND p.zone = u.zone AND p.period = u.period""")
def monthly_points(t: Tables):
    a, gas = _monthly(t)
    pf = monthly.point_forecasts(a, gas, date(1998, 1, 1))
    return pf.select("month", "h", "cutoff", "zone", "period", F.round("m5_norm_total", 7).alias("m5_norm_total"), F.round("m5_norm_congestion", 7).alias("m5_norm_congestion"), "m5_lastyear_total", "m5_persist_total", "m5_persist_congestion")


@check("monthly_distributions")
def monthly_distributions(t: Tables):
    a, gas = _monthly(t)
    pf = monthly.decay_fit(monthly.point_forecasts(a, gas, date(1998, 1, 1)), a)
    d = None
    for m in ("m5_norm", "m5_anchor", "m5_decay"):
        s = monthly.monthly_scores(monthly.distributions(pf, a, m)).withColumn("model", F.lit(m))
        d = s if d is None else d.unionByName(s)
    return rounded(d, 5)
