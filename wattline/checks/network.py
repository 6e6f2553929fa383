"""Sparse algebra, catalogues, co-binding, drift, node regressions, run bookkeeping."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wattline.checks.base import BOOK_SQL, FOLDS_SQL, Tables, check, rounded
from wattline.models.congestion import binding_scores, crossfit_lift, outage_lift
from wattline.operators.audit import checksum_diff, column_checksums
from wattline.operators.sparse import cobinding, gram, key_drift, matrix_drift, ridge_factors, subspace_drift, top_keys
from wattline.plans.folds import assign_test_fold
from wattline.plans.nodes import node_coefficients, node_forecast
from wattline.plans.registry import Registry, latest_per_model, latest_state
from wattline.plans.structure import constraint_catalogue, window_days
from wattline.plans.views import signal_constraints, signal_cobinding
from wattline.session import checkpoint_dir, cut_lineage

K = 12
# constraint = supplier, slot = ship day, shadow price = daily quantity; market by order priority group
SHADOW_SQL = """sp AS (SELECT CASE WHEN o_orderpriority < '3' THEN 'da' ELSE 'rt' END AS market, CAST(l_shipdate AS DATE) AS d, 'S' || l_suppkey AS key, CAST(sum(l_quantity) AS DOUBLE) AS mu
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"""
CAT_SQL = f"""cat AS (SELECT yr, market, key, s, r FROM (SELECT year(d) AS yr, market, key, sum(mu) AS s, row_number() OVER (PARTITION BY year(d), market ORDER BY sum(mu) DESC, key) AS r FROM sp GROUP BY 1, 2, 3) WHERE r <= {K})"""


def shadow(t: Tables, keys=None, days=None):
    """Daily quantity per constraint; of `keys` (key) or `days` (d) only, which are then taken out before the join."""
    l = t.lineitem
    if days is not None:
        l = l.join(F.broadcast(days.select(F.col("d").alias("_d")).distinct()), F.to_date("l_shipdate") == F.col("_d"), "left_semi")
    if keys is not None:
        l = l.join(F.broadcast(keys.withColumnRenamed("key", "_key")), F.concat(F.lit("S"), F.col("l_suppkey")) == F.col("_key"), "left_semi")
    j = l.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.when(F.col("o_orderpriority") < "3", "da").otherwise("rt").alias("market"), F.to_date("l_shipdate").alias("d"),
                     F.concat(F.lit("S"), F.col("l_suppkey")).alias("key")).agg(F.sum("l_quantity").alias("mu")).withColumn("hr", F.lit(0))


def catalogue(t: Tables):
    """Yearly top constraints per market: (fold, market, key, sum_abs, rank)."""
    return top_keys(shadow(t).withColumn("fold", F.year("d")), ["fold", "market"], "key", "mu", K)


def indexed(t: Tables):
    c = cut_lineage(catalogue(t).select("fold", "market", "key", (F.col("rank") - 1).cast("int").alias("c")))        # at most K keys a year and market
    return shadow(t, c.select("key").distinct()).withColumn("fold", F.year("d")).join(c, ["fold", "market", "key"])


@check("top_constraints", f"WITH {SHADOW_SQL}, {CAT_SQL} SELECT CAST(yr AS INTEGER) AS fold, market, key, s AS sum_abs, CAST(r AS INTEGER) AS rank FROM cat")
def top_constraints(t: Tables):
    return catalogue(t)


@check("sparse_gram", f"""WITH {SHADOW_SQL}, {CAT_SQL}, x AS (SELECT cat.yr, cat.market, d, r - 1 AS c, mu FROM sp JOIN cat ON cat.yr = year(d) AND cat.market = sp.market AND cat.key = sp.key)
SELECT CAST(a.yr AS INTEGER) AS fold, a.market, CAST(a.c AS INTEGER) AS i, CAST(b.c AS INTEGER) AS j, sum(a.mu * b.mu) AS v FROM x a JOIN x b USING (yr, market, d) WHERE a.c <= b.c GROUP BY ALL""")
def sparse_gram(t: Tables):
    return gram(indexed(t), ["fold", "market"], ["d"], "c", "mu", K)


@check("cobinding_graph", f"""WITH {SHADOW_SQL}, {CAT_SQL}, x AS (SELECT cat.yr, cat.market, d, cat.key, r FROM sp JOIN cat ON cat.yr = year(d) AND cat.market = sp.market AND cat.key = sp.key), n AS (SELECT yr, market, key, count(*) AS n FROM x GROUP BY 1, 2, 3),
p AS (SELECT a.yr, a.market, a.key AS ka, b.key AS kb, count(*) AS nab FROM x a JOIN x b USING (yr, market, d) WHERE a.r < b.r GROUP BY ALL)
SELECT CAST(p.yr AS INTEGER) AS fold, p.market, ka AS key_a, kb AS key_b, nab AS hours_both, round(nab / (na.n + nb.n - nab), 6) AS jaccard FROM p JOIN n na ON na.yr = p.yr AND na.market = p.market AND na.key = ka
JOIN n nb ON nb.yr = p.yr AND nb.market = p.market AND nb.key = kb WHERE nab >= 3""")
def cobinding_graph(t: Tables):
    return rounded(cobinding(shadow(t).withColumn("fold", F.year("d")), catalogue(t), ["fold", "market"], ["d"], "key", K, 3))


@check("top_cobinding_edges", f"""WITH {SHADOW_SQL}, {CAT_SQL}, x AS (SELECT cat.yr, d, cat.key, r FROM sp JOIN cat ON cat.yr = year(d) AND cat.market = sp.market AND cat.key = sp.key WHERE sp.market = 'da'), n AS (SELECT yr, key, count(*) AS n FROM x GROUP BY 1, 2),
p AS (SELECT a.yr, a.key AS ka, b.key AS kb, count(*) AS nab FROM x a JOIN x b USING (yr, d) WHERE a.r < b.r GROUP BY ALL),
e AS (SELECT p.yr, ka, kb, nab, nab / (na.n + nb.n - nab) AS jaccard FROM p JOIN n na ON na.yr = p.yr AND na.key = ka JOIN n nb ON nb.yr = p.yr AND nb.key = kb)
SELECT ka AS key_a, kb AS key_b, nab AS hours_both, round(jaccard, 6) AS jaccard FROM e WHERE yr = (SELECT max(yr) FROM e) ORDER BY e.jaccard DESC, ka, kb LIMIT 10""")
def top_edges(t: Tables):
    """Strongest edges of the latest fold; ties by name."""
    g = cobinding(shadow(t).withColumn("fold", F.year("d")), catalogue(t), ["fold", "market"], ["d"], "key", K, 1)
    return rounded(signal_cobinding(g, "da", None, 10))


@check("catalogue_drift", f"""WITH {SHADOW_SQL}, {CAT_SQL}, j AS (SELECT coalesce(n.market, o.market) AS market, coalesce(n.yr, o.yr + 1) AS yr, n.key AS nk, o.key AS ok FROM cat n FULL JOIN cat o ON n.market = o.market AND n.key = o.key AND n.yr = o.yr + 1)
SELECT market, CAST(yr AS INTEGER) AS fold, round(count(*) FILTER (nk IS NOT NULL AND ok IS NOT NULL) / count(*), 6) AS catalog_jaccard, count(*) FILTER (ok IS NULL) AS keys_added, count(*) FILTER (nk IS NULL) AS keys_dropped
FROM j WHERE yr > (SELECT min(yr) FROM cat) AND yr <= (SELECT max(yr) FROM cat) GROUP BY 1, 2""")
def catalogue_drift(t: Tables):
    return rounded(key_drift(catalogue(t), ["market"], "fold", "key"))


@check("constraint_windows", f"""WITH {SHADOW_SQL}, w AS (SELECT DISTINCT CAST(year(d) AS INTEGER) AS yr FROM sp), x AS (SELECT w.yr AS fold, market, key, d, mu FROM sp JOIN w ON d BETWEEN make_date(w.yr, 1, 1) AND make_date(w.yr, 6, 30)),
c AS (SELECT fold, market, key, sum(mu) AS s, count(DISTINCT d) AS h, row_number() OVER (PARTITION BY fold, market ORDER BY sum(mu) DESC, key) AS r FROM x GROUP BY 1, 2, 3)
SELECT fold, market, key, CAST(r AS INTEGER) AS rank, s AS sum_abs_shadow, round(h / ((make_date(fold, 6, 30) - make_date(fold, 1, 1) + 1) * 24), 6) AS bind_rate, make_date(fold, 1, 1) AS window_start, make_date(fold, 6, 30) AS window_end FROM c WHERE r <= {K}""")
def constraint_windows(t: Tables):
    y = t.orders.select(F.year("o_orderdate").alias("fold")).distinct()
    w = cut_lineage(y.select("fold", F.make_date("fold", F.lit(1), F.lit(1)).alias("window_start"), F.make_date("fold", F.lit(6), F.lit(30)).alias("window_end")))
    return rounded(constraint_catalogue(shadow(t, days=window_days(w)), w, K, one_row_a_slot=True))


def _factors(t: Tables):
    """Zone = order priority, congestion = book price."""
    y = t.book().select(F.year("d").alias("fold"), "d", "zone", F.col("da").alias("cong"))
    x = indexed(t).filter("market = 'da'").select("fold", "d", "c", "mu")
    return ridge_factors(x, y, ["fold"], ["d"], "c", "mu", "zone", "cong", K).withColumn("market", F.lit("da"))


@check("ridge_shift_factors")
def ridge(t: Tables):
    """A K x K solve per year: checked against numpy in the tests."""
    return rounded(_factors(t), 4)


@check("factor_drift")
def factor_drift(t: Tables):
    f = _factors(t)
    d = matrix_drift(f, ["market"], "fold", "zone", "c").join(matrix_drift(f, ["market"], "fold", "zone", "c", inner_rows=True, out="inner_change"), ["market", "fold"])
    return rounded(d.join(subspace_drift(f, ["market"], "fold", "zone", "c", k=3), ["market", "fold"]), 4)


@check("most_sensitive_zone", f"""WITH {SHADOW_SQL}, {CAT_SQL}, zf AS (SELECT year(CAST(l_shipdate AS DATE)) AS yr, 'da' AS market, 'S' || l_suppkey AS key, l_returnflag AS zone, CAST(sum(l_quantity) AS DOUBLE) - 300 AS a FROM lineitem GROUP BY ALL),
b AS (SELECT yr, market, key, zone FROM (SELECT *, row_number() OVER (PARTITION BY yr, market, key ORDER BY abs(a) DESC, zone DESC) AS k FROM zf) WHERE k = 1)
SELECT CAST(cat.yr AS INTEGER) AS fold, CAST(r AS INTEGER) AS rank, cat.key, s AS sum_abs_shadow, 0.5::DOUBLE AS bind_rate, zone AS most_sensitive_zone FROM cat LEFT JOIN b USING (yr, market, key) WHERE market = 'da' AND cat.yr = (SELECT max(yr) FROM cat WHERE market = 'da')""")
def most_sensitive(t: Tables):
    c = catalogue(t).withColumnRenamed("sum_abs", "sum_abs_shadow").withColumn("bind_rate", F.lit(0.5))
    z = t.lineitem.groupBy(F.year("l_shipdate").alias("fold"), F.lit("da").alias("market"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("key"), F.col("l_returnflag").alias("zone")).agg(
        (F.sum("l_quantity") - 300).alias("a"))
    return signal_constraints(c, z, "da")


LIFT_SQL = f"""WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, 'E' || (o_custkey % 7) AS equipment FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority < '3'), b AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d, l_returnflag || l_linestatus AS key FROM lineitem WHERE l_quantity > 45),
nd AS (SELECT count(DISTINCT CAST(o_orderdate AS DATE)) AS n FROM orders), e AS (SELECT equipment, count(*)::DOUBLE AS ne FROM o GROUP BY 1), s AS (SELECT e.* FROM e, nd WHERE ne >= 10 AND ne <= 0.9 * n),
k AS (SELECT key, greatest(1.0 / any_value(n), least(1 - 1.0 / any_value(n), count(*) / any_value(n))) AS p FROM b, nd GROUP BY 1), j AS (SELECT key, equipment, count(*)::DOUBLE AS bo FROM b JOIN o USING (d) GROUP BY 1, 2)
SELECT key, equipment, ne AS n_out_days, coalesce(bo, 0) AS bind_out_days, round(p, 6) AS base_rate, round(ln((coalesce(bo, 0) + 20 * p) / (ne + 20)) - ln(p), 6) AS lift FROM k CROSS JOIN s LEFT JOIN j USING (key, equipment)"""


def _lift_inputs(t: Tables):
    o = t.orders.filter("o_orderstatus = 'F' AND o_orderpriority < '3'").select(F.to_date("o_orderdate").alias("d"), F.concat(F.lit("E"), F.col("o_custkey") % 7).alias("equipment")).distinct()
    b = t.lineitem.filter("l_quantity > 45").select(F.to_date("l_shipdate").alias("d"), F.concat("l_returnflag", "l_linestatus").alias("key")).distinct()
    return o, b


@check("outage_lift", LIFT_SQL)
def lift(t: Tables):
    o, b = _lift_inputs(t)
    one = lambda df: df.withColumn("g", F.lit(1))                                           # noqa: E731
    n = one(t.orders.agg(F.count_distinct(F.to_date("o_orderdate")).cast("double").alias("n")))
    return rounded(outage_lift(one(o), one(b), n, ["g"]).drop("g", "n"))


@check("crossfit_lift")
def lift_blocks(t: Tables):
    o, b = _lift_inputs(t)
    return rounded(crossfit_lift(o, b, t.orders.select(F.to_date("o_orderdate").alias("d"))).drop("n"))


@check("binding_scores", """WITH x AS (SELECT l_returnflag AS market, CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END AS h, greatest(0.001, least(0.999, l_discount * 8 + 0.05)) AS p, greatest(0.001, least(0.999, l_tax * 5 + 0.1)) AS c FROM lineitem)
SELECT market, round(avg(h), 6) AS base_rate, round(avg((p - h) ** 2), 6) AS brier, round(avg((c - h) ** 2), 6) AS brier_clim, round(-avg(h * ln(p) + (1 - h) * ln(1 - p)), 6) AS logloss, round(-avg(h * ln(c) + (1 - h) * ln(1 - c)), 6) AS logloss_clim FROM x GROUP BY 1""")
def binding(t: Tables):
    x = t.lineitem.select(F.col("l_returnflag").alias("market"), F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0).alias("shadow_actual"), (F.col("l_discount") * 8 + 0.05).alias("p_bind"), (F.col("l_tax") * 5 + 0.1).alias("freq30_h"))
    return rounded(binding_scores(x, ["market"]))


NODE_SQL = f"""{BOOK_SQL}, {FOLDS_SQL}, n AS (SELECT l_suppkey AS ptid, CAST(l_shipdate AS DATE) AS d, avg(l_extendedprice) / 1000 AS mlc, -avg(l_quantity) AS mcc FROM lineitem GROUP BY 1, 2), nz AS (SELECT s_suppkey AS ptid, CASE s_nationkey % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END AS zone FROM supplier),
j AS (SELECT n.ptid, nz.zone, n.d, n.mlc AS nl, -n.mcc AS nc, b.da AS zl, b.rt AS zc FROM n JOIN nz USING (ptid) JOIN book b ON b.zone = nz.zone AND b.d = n.d),
co AS (SELECT fold, ptid, zone, regr_intercept(nl, zl) AS al, regr_slope(nl, zl) AS bl, regr_intercept(nc, zc) AS ac, regr_slope(nc, zc) AS bc, regr_count(nl, zl) AS n_obs FROM j JOIN folds ON d < train_end AND d >= train_end - 365 GROUP BY 1, 2, 3),
fx AS (SELECT fold, ptid, zone, CASE WHEN n_obs >= 80 THEN coalesce(al, 0) ELSE 0 END AS a_loss, CASE WHEN n_obs >= 80 THEN coalesce(bl, 1) ELSE 1 END AS b_loss, CASE WHEN n_obs >= 80 THEN coalesce(ac, 0) ELSE 0 END AS a_cong, CASE WHEN n_obs >= 80 THEN coalesce(bc, 1) ELSE 1 END AS b_cong, CAST(n_obs AS BIGINT) AS n_obs FROM co)"""


def _coefficients(t: Tables):
    l = t.lineitem.select(F.col("l_suppkey").alias("ptid"), F.date_trunc("day", "l_shipdate").alias("ts_utc"), "l_extendedprice", "l_quantity").repartition("ptid")      # as the coefficients need it: one exchange
    n = l.groupBy("ptid", "ts_utc").agg((F.avg("l_extendedprice") / 1000).alias("mlc"), (-F.avg("l_quantity")).alias("mcc"))
    zone = F.element_at(F.array(*[F.lit(z) for z in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]), (F.col("s_nationkey") % 5 + 1).cast("int"))
    nodes = t.supplier.select(F.col("s_suppkey").alias("ptid"), zone.alias("zone"))
    z = t.book().select(F.col("d").cast("timestamp").alias("ts_utc"), "zone", F.col("da").alias("da_mlc"), (-F.col("rt")).alias("da_mcc"))
    return node_coefficients(n.withColumn("ts_local", F.col("ts_utc").cast("timestamp_ntz")), nodes, z, "da", t.folds(), min_obs=80)


@check("node_coefficients", f"WITH {NODE_SQL} SELECT fold, ptid, zone, round(a_loss, 5) AS a_loss, round(b_loss, 5) AS b_loss, round(a_cong, 5) AS a_cong, round(b_cong, 5) AS b_cong, n_obs FROM fx")
def coefficients(t: Tables):
    return rounded(_coefficients(t), 5)


@check("node_forecast", f"""WITH {NODE_SQL} SELECT f.fold, b.d AS delivery_date, ptid, b.zone, round(b.da * 0.6, 4) AS energy, round(a_loss + b_loss * b.da / 7.0::DOUBLE, 4) AS loss, round(a_cong + b_cong * b.da / 11.0::DOUBLE, 4) AS congestion,
round(b.da * 0.6 + a_loss + b_loss * b.da / 7.0::DOUBLE + a_cong + b_cong * b.da / 11.0::DOUBLE, 4) AS total FROM book b JOIN folds f ON b.d >= test_start AND b.d < test_end JOIN fx ON fx.fold = f.fold AND fx.zone = b.zone""".replace("b.da * 0.6,", "b.da / 3.0::DOUBLE,").replace("b.da * 0.6 +", "b.da / 3.0::DOUBLE +"))
def forecast_nodes(t: Tables):
    b = assign_test_fold(t.book().withColumn("delivery_date", F.col("d")), t.folds())
    rows = F.array(*[F.struct(F.lit(c).alias("component"), (F.col("da") / k).alias("mean")) for c, k in (("energy", 3.0), ("loss", 7.0), ("congestion", 11.0))])
    zf = b.select("fold", "delivery_date", F.col("d").cast("timestamp").alias("ts_utc"), "zone", F.lit("da").alias("market"), F.explode(rows).alias("_r")).select("fold", "delivery_date", "ts_utc", "zone", "market", "_r.*")
    return rounded(node_forecast(zf, _coefficients(t), "da", ["fold"]).drop("ts_utc", "market"), 4)


@check("panel_column_changes", """SELECT unnest(['o_totalprice', 'o_extra', 'o_orderpriority']) AS column, unnest(['changed', 'added', 'removed']) AS change FROM (SELECT 1 FROM orders LIMIT 1)""")
def panel_changes(t: Tables):
    """A price raised for one status, a column added, a column removed: exactly those three are reported."""
    a = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    b = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"), F.lit(1).alias("o_extra"))
    return checksum_diff(column_checksums(a, ["o_orderkey"]), column_checksums(b, ["o_orderkey"]))


@check("latest_run_states", """WITH s AS (SELECT o_custkey AS run, o_orderdate AS tm, o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'failed' ELSE 'running' END AS status, 'model' || (o_custkey % 10) AS model FROM orders),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY tm DESC, (status <> 'running') DESC, k DESC) AS r FROM s) WHERE r = 1)
SELECT model, run_id FROM (SELECT model, lpad(run::VARCHAR, 9, '0') AS run_id, row_number() OVER (PARTITION BY model ORDER BY tm DESC, run DESC) AS q FROM l WHERE status = 'done') WHERE q = 1""")
def run_states(t: Tables):
    st = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "failed").otherwise("running")
    e = t.orders.select(F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("run_id"), F.concat(F.lit("model"), F.col("o_custkey") % 10).alias("model"), F.col("o_orderdate").alias("event_utc"), st.alias("status"), "o_orderkey")
    # one event per (run, time, finished): the larger order key
    e = e.groupBy("run_id", "model", "event_utc", (F.col("status") != "running").alias("_f")).agg(F.max_by("status", "o_orderkey").alias("status")).drop("_f")
    return latest_per_model(latest_state(e.withColumn("created_utc", F.col("event_utc"))).filter("status = 'done'"))


@check("registry_slots", f"""WITH {BOOK_SQL} SELECT 'run' || (year(d) % 2) AS run_id, strftime(d, '%Y-%m') AS fold, count(*) AS n, round(sum(CASE WHEN month(d) <= 3 THEN rt ELSE da END), 4) AS total FROM book
GROUP BY 1, 2 UNION ALL SELECT 'run2', strftime(d, '%Y-%m'), count(*), round(sum(rt), 4) FROM book WHERE year(d) = 1996 GROUP BY 2""")
def registry_slots(t: Tables):
    """Two runs' predictions by month, the first quarters written again with other values, and a third run without one column: what readers see."""
    reg = Registry(t.spark, f"{checkpoint_dir(t.spark)}/registry-{uuid.uuid4().hex}")
    b = t.book().select(F.concat(F.lit("run"), F.year("d") % 2).alias("run"), F.date_format("d", "yyyy-MM").alias("fold"), F.month("d").alias("m"), "zone", "da", "rt")
    for run in ("run0", "run1"):
        own = b.where(F.col("run") == run).drop("run")
        reg.save_predictions(run, own.select("fold", "zone", F.col("da").alias("mean")))
        reg.save_predictions(run, own.where("m <= 3").select("fold", "zone", F.col("rt").alias("mean")))
    reg.save_predictions("run2", t.book().where("year(d) = 1996").select(F.date_format("d", "yyyy-MM").alias("fold"), F.col("rt").alias("mean")))
    return rounded(reg.predictions("run0", "run1", "run2").groupBy("run_id", "fold").agg(F.count("*").alias("n"), F.sum("mean").alias("total")), 4)


@check("distinct_configurations", "SELECT count(DISTINCT o_orderpriority || o_orderstatus) AS configs FROM orders")
def configurations(t: Tables):
    return t.orders.agg(F.count_distinct(F.concat("o_orderpriority", "o_orderstatus")).alias("configs"))
