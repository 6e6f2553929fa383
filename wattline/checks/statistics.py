"""Overfitting and multiple-testing statistics, bootstraps, permutations, clustered regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.checks.base import BOOK_SQL, Tables, check, rounded
from wattline.checks.scoring import LOSS_SQL, losses
from wattline.operators import overfit as O
from wattline.operators.resampling import bootstrap_mean_p, cluster_bootstrap, power_curve, shuffle_within, stationary_indices
from wattline.operators.scoring import ks_uniform
from wattline.operators.significance import clustered_slope
from wattline.plans.diagnostics import per_trial

BLOCKS, DRAWS, MEAN_DRAWS = 16, 2000, 10_000           # the operators' defaults


def lcg(b, t, stream):
    """Integer-hash uniform that SQL can repeat."""
    return F.pmod(b * 7919 + t * 104729 + F.lit(stream * 1299709) + F.pmod(b * t, F.lit(10007)) * 31, F.lit(10007)) / F.lit(10007.0)


LCG_SQL = "(((b * 7919 + t * 104729 + {s} * 1299709 + ((b * t) % 10007) * 31) % 10007) / 10007.0::DOUBLE)"


def skill(t: Tables, market: str = "da"):
    s = losses(t).filter(F.col("market") == market).select("day", "trial", F.col("ae").alias("loss"))
    return O.skill_matrix(s, "m7")


SKILL_SQL = f"""{LOSS_SQL}, full_days AS (SELECT day FROM loss WHERE market = 'da' GROUP BY 1 HAVING count(DISTINCT trial) = 3),
skill AS (SELECT a.day, a.trial, b.ae - a.ae AS v FROM loss a JOIN loss b USING (market, day) JOIN full_days USING (day) WHERE market = 'da' AND b.trial = 'm7')"""


@check("skill_matrix", f"WITH {SKILL_SQL} SELECT day, trial, round(v, 6) AS value FROM skill")
def skill_matrix(t: Tables):
    return rounded(skill(t))


@check("sharpe_moments", f"""WITH {SKILL_SQL}, m AS (SELECT trial, count(*) AS n, avg(v) AS mu, stddev_samp(v) AS sd, stddev_pop(v) AS sp FROM skill GROUP BY 1)
SELECT trial, any_value(n) AS "T", round(any_value(mu), 6) AS mean, round(any_value(sd), 6) AS std, round(any_value(mu) / nullif(any_value(sd), 0), 6) AS sr,
round(avg(((v - mu) / nullif(sp, 0)) ** 3), 5) AS skew, round(avg(((v - mu) / nullif(sp, 0)) ** 4), 5) AS kurt FROM skill JOIN m USING (trial) GROUP BY 1""")
def sharpe_moments(t: Tables):
    m = O.moments(skill(t), ["trial"], "value")
    return rounded(m.withColumns({"skew": F.round("skew", 5), "kurt": F.round("kurt", 5)}))


@check("mean_pairwise_correlation", f"WITH {SKILL_SQL}, w AS (SELECT day, max(v) FILTER (trial = 'm1') AS a, max(v) FILTER (trial = 'm2') AS b FROM skill GROUP BY 1) SELECT 2.0::DOUBLE AS n_trials, round(corr(a, b), 6) AS rho FROM w")
def pairwise(t: Tables):
    return rounded(O.mean_pairwise_correlation(skill(t).filter("trial <> 'm7'")))


CSCV_SQL = f"""{SKILL_SQL}, pos AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS t FROM (SELECT DISTINCT day FROM skill)), sz AS (SELECT count(*) AS n, count(*) // {BLOCKS} AS size FROM pos),
bs AS (SELECT trial, (t - (n - size * {BLOCKS})) // size AS blk, sum(v) AS s FROM skill JOIN pos USING (day), sz WHERE t >= n - size * {BLOCKS} GROUP BY 1, 2),
combos AS (SELECT CAST(unnest(range(0, {1 << BLOCKS})) AS BIGINT) AS combo), half AS (SELECT combo FROM combos WHERE bit_count(combo) = {BLOCKS // 2}),
r AS (SELECT combo, trial, sum(CASE WHEN (combo >> blk) & 1 = 1 THEN s ELSE 0 END) / any_value(size * {BLOCKS // 2}) AS i, sum(CASE WHEN (combo >> blk) & 1 = 0 THEN s ELSE 0 END) / any_value(size * {BLOCKS // 2}) AS o FROM half, bs, sz GROUP BY 1, 2),
best AS (SELECT combo, trial, i, o FROM (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY i DESC, trial) AS k FROM r) WHERE k = 1),
ranked AS (SELECT b.combo, b.trial, b.i, b.o, 1 + count(*) FILTER (r.o < b.o) AS rank, count(*) AS nt FROM best b JOIN r USING (combo) GROUP BY ALL)"""


@check("cscv_splits", f"WITH {CSCV_SQL} SELECT combo, trial, round(i + 1e-12, 9) AS is_best, round(o + 1e-12, 9) AS oos_best, CAST(rank AS INTEGER) AS rank, round(ln((rank / (nt + 1)) / (1 - rank / (nt + 1))), 6) AS logit FROM ranked")
def cscv_splits(t: Tables):
    c = O.cscv_table(skill(t)).drop("oos_all", "n_trials")
    c = c.withColumns({"logit": F.round("logit", 6), "is_best": F.col("is_best") + 1e-12, "oos_best": F.col("oos_best") + 1e-12})      # exact ties at the last digit go up in both engines
    return rounded(c, 9)


@check("backtest_overfitting", f"""WITH {CSCV_SQL}, l AS (SELECT *, ln((rank / (nt + 1)) / (1 - rank / (nt + 1))) AS logit FROM ranked)
SELECT round(avg(CASE WHEN logit <= 0 THEN 1.0 ELSE 0.0 END), 6) AS pbo, round(median(logit), 6) AS logit_median, count(*) AS combinations, round(regr_slope(o, i), 4) AS degradation_slope,
round(avg(CASE WHEN o < 0 THEN 1.0 ELSE 0.0 END), 6) AS prob_oos_loss, round(median(o), 6) AS oos_selected_median FROM l""")
def backtest_overfitting(t: Tables):
    p = O.pbo(skill(t)).select("pbo", "logit_median", "combinations", F.round("degradation_slope", 4).alias("degradation_slope"), "prob_oos_loss", "oos_selected_median")
    return rounded(p)


BOOT_SQL = f"""g AS (SELECT CAST(b AS BIGINT) AS b, CAST(t AS BIGINT) AS t FROM (SELECT unnest(range(1, {{k}} + 1)) AS b), (SELECT unnest(range(0, {{n}})) AS t)),
f AS (SELECT b, t, t = 0 OR {LCG_SQL.format(s=1)} < {{p}} AS fresh, CAST(floor({LCG_SQL.format(s=2)} * {{n}}) AS BIGINT) AS st FROM g),
blk AS (SELECT b, t, last_value(CASE WHEN fresh THEN st END IGNORE NULLS) OVER w AS st, last_value(CASE WHEN fresh THEN t END IGNORE NULLS) OVER w AS a0 FROM f WINDOW w AS (PARTITION BY b ORDER BY t ROWS UNBOUNDED PRECEDING)),
idx AS (SELECT b, t, CAST((st + t - a0) % {{n}} AS INTEGER) AS idx FROM blk)"""


@check("stationary_bootstrap", f"""WITH n AS (SELECT count(DISTINCT CAST(ts AS DATE)) AS n FROM events), {BOOT_SQL.format(k=DRAWS, n='(SELECT n FROM n)', p='0.2')} SELECT b, CAST(t AS INTEGER) AS t, idx FROM idx""")
def stationary_bootstrap(t: Tables):
    n = t.events.select(F.to_date("ts")).distinct().count()
    return stationary_indices(t.spark, n, DRAWS, 5.0, uniform=lcg).select("b", F.col("t").cast("int").alias("t"), "idx")


@check("bootstrap_mean_test", f"""WITH {SKILL_SQL}, x AS (SELECT day, sum(v) AS x FROM skill WHERE trial = 'm1' GROUP BY 1), o AS (SELECT count(*) AS n, avg(x) AS mu, stddev_samp(x) AS sd FROM x),
s AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, x - mu AS z FROM x, o), {BOOT_SQL.format(k=MEAN_DRAWS, n='(SELECT n FROM o)', p='0.2')},
sim AS (SELECT b, avg(z) / stddev_samp(z) * sqrt(count(*)) AS ts FROM idx JOIN s ON s.i = idx.idx GROUP BY 1) SELECT any_value(n) AS n_days, round(any_value(mu), 6) AS mean, round(any_value(mu / sd * sqrt(n)), 6) AS t_stat,
round(avg(CASE WHEN ts >= mu / sd * sqrt(n) THEN 1.0 ELSE 0.0 END), 6) AS p_value FROM sim, o""")
def bootstrap_mean_test(t: Tables):
    s = skill(t).filter("trial = 'm1'")
    return rounded(bootstrap_mean_p(s, [], "day", "value", uniform=lcg))


@check("superior_predictive_ability", f"""WITH {SKILL_SQL}, k AS (SELECT * FROM skill WHERE trial <> 'm7'), pos AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM (SELECT DISTINCT day FROM k)), c AS (SELECT count(*) AS n FROM pos),
{BOOT_SQL.format(k=DRAWS, n='(SELECT n FROM c)', p='0.1')}, bm AS (SELECT b, trial, sum(v) / any_value(n) AS m FROM idx JOIN pos ON pos.i = idx.idx JOIN k USING (day), c GROUP BY 1, 2), ob AS (SELECT trial, avg(v) AS d FROM k GROUP BY 1),
st AS (SELECT ob.trial, any_value(d) AS d, sqrt(any_value(n) * var_pop(m)) AS w, any_value(n) AS n FROM bm JOIN ob USING (trial), c GROUP BY 1), s2 AS (SELECT *, -sqrt(w * w / n * 2 * ln(ln(n))) AS thr FROM st),
seen AS (SELECT greatest(max(sqrt(n) * d / w), 0) AS spa, max(sqrt(n) * d) AS rc FROM s2), dr AS (SELECT b, greatest(max(sqrt(n) * (m - d + least(d, 0)) / w), 0) AS lo, greatest(max(sqrt(n) * (m - d + CASE WHEN d >= thr THEN 0 ELSE d END) / w), 0) AS co,
greatest(max(sqrt(n) * (m - d) / w), 0) AS up, max(sqrt(n) * (m - d)) AS rc FROM bm JOIN s2 USING (trial) GROUP BY 1)
SELECT round(avg(CASE WHEN lo >= spa THEN 1.0 ELSE 0.0 END), 6) AS p_spa_lower, round(avg(CASE WHEN co >= spa THEN 1.0 ELSE 0.0 END), 6) AS p_spa_consistent, round(avg(CASE WHEN up >= spa THEN 1.0 ELSE 0.0 END), 6) AS p_spa_upper,
round(avg(CASE WHEN dr.rc >= seen.rc THEN 1.0 ELSE 0.0 END), 6) AS p_reality_check, round(any_value(spa), 5) AS spa_stat FROM dr, seen""")
def superior(t: Tables):
    s = O.spa_test(skill(t).filter("trial <> 'm7'"), uniform=lcg)
    return rounded(s.select("p_spa_lower", "p_spa_consistent", "p_spa_upper", "p_reality_check", F.round("spa_stat", 5).alias("spa_stat")))


@check("multiple_testing", f"""WITH {BOOK_SQL}, g AS (SELECT zone, least(1.0, round(abs(avg(da - rt)) / 5, 6)) AS p FROM book GROUP BY 1), r AS (SELECT zone, p, row_number() OVER (ORDER BY p, zone) AS i, count(*) OVER () AS m FROM g),
h AS (SELECT *, least(1, (m - i + 1) * p) AS a, least(1, p * m * (SELECT sum(1.0::DOUBLE / k) FROM (SELECT unnest(range(1, 6)) AS k)) / i) AS c FROM r)
SELECT zone, p, round(max(a) OVER (ORDER BY i), 6) AS p_holm, round(min(c) OVER (ORDER BY i DESC), 6) AS p_bhy FROM h""")
def multiple_testing(t: Tables):
    g = t.book().groupBy("zone").agg(F.least(F.lit(1.0), F.round(F.abs(F.avg(F.col("da") - F.col("rt"))) / 5, 6)).alias("p"))
    return rounded(O.bhy(O.holm(g, [], "p", "zone"), [], "p", "zone"))


@check("clustered_slope", """WITH x AS (SELECT l_returnflag AS g, l_suppkey AS c, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), m AS (SELECT g, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx FROM x GROUP BY 1),
u AS (SELECT g, c, sum(y - a - b * x) AS u0, sum(x * (y - a - b * x)) AS u1 FROM x JOIN m USING (g) GROUP BY 1, 2), v AS (SELECT g, any_value(b) AS slope, sqrt(sum(((n * u1 - sx * u0) / (n * sxx - sx * sx)) ** 2)) AS se FROM u JOIN m USING (g) GROUP BY 1)
SELECT g, round(slope, 6) AS slope, round(se, 6) AS se, round(slope / se, 4) AS t FROM v""")
def cluster_slope(t: Tables):
    x = t.lineitem.select(F.col("l_returnflag").alias("g"), F.col("l_suppkey").alias("c"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return rounded(clustered_slope(x, ["g"], "x", "y", "c").withColumn("t", F.round("t", 4)))


@check("cluster_bootstrap")
def cluster_boot(t: Tables):
    """Hash draws: no SQL form.  Properties are tested."""
    x = t.lineitem.select("l_returnflag", "l_suppkey", F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice") / 1000 - 36).alias("pnl"))
    return rounded(cluster_bootstrap(x, ["l_returnflag"], "l_suppkey", "pnl"))


@check("permutation_within_groups")
def permutations(t: Tables):
    """Ten shuffles of da inside each priority and month; sums per draw never change."""
    b = t.book().withColumn("m", F.trunc("d", "MM"))
    s = shuffle_within(b.select("zone", "m", "d", "da"), ["zone", "m"], ["d"], ["da"], 10)
    return rounded(s.groupBy("b", "zone", "m").agg(F.count(F.lit(1)).alias("n"), F.sum("da").alias("total")), 4)


@check("forward_power_curve")
def forward_power(t: Tables):
    return rounded(power_curve(skill(t).filter("trial = 'm1'"), "day", "value", [60, 250]))


@check("trial_diagnostics")
def trial_diagnostics(t: Tables):
    s = losses(t).filter("market = 'da'").select("day", "trial", F.col("ae").alias("loss"), "n")
    return rounded(per_trial(s, "m7", 10))


@check("uniformity_distance", """WITH u AS (SELECT l_returnflag AS g, l_extendedprice / 110000 AS u FROM lineitem), r AS (SELECT g, u, rank() OVER (PARTITION BY g ORDER BY u) AS lo, count(*) OVER (PARTITION BY g ORDER BY u) AS hi, count(*) OVER (PARTITION BY g) AS n FROM u)
SELECT g, any_value(n) AS n, round(max(greatest(abs(hi / n - u), abs((lo - 1) / n - u))), 6) AS ks_stat FROM r GROUP BY 1""")
def uniformity(t: Tables):
    u = t.lineitem.select(F.col("l_returnflag").alias("g"), (F.col("l_extendedprice") / 110000).alias("u"))
    return rounded(ks_uniform(u, ["g"], "u"))
