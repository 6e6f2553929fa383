"""Monthly peak and off-peak products: actuals, point forecasts per vintage, error-based distributions."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.calendar import is_holiday, peak_period
from wattline.functions.quantiles import covered, crps, has_quantiles
from wattline.operators.ordered import top_per_group
from wattline.operators.scoring import with_total
from wattline.plans.folds import next_month
from wattline.settings import EMBARGO_DAYS, QCOLS, QUANTILES

HORIZONS = 6
GAS_DAYS, GAS_LAG, NORM_YEARS, MIN_ERRORS, MIN_COVERAGE = 10, 7, 5, 24, 0.95
UNIT = ["zone", "period"]
BASELINES = ("m5_persist", "m5_lastyear", "m5_norm")
MODELS = (*BASELINES, "m5_anchor", "m5_decay")


def actuals(prices: DataFrame) -> DataFrame:
    """(month, zone, period, total, congestion) over months with at least 95 % of their hours."""
    local = F.col("ts_local")
    h = prices.select("zone", F.trunc(F.to_date(local), "MM").alias("month"), peak_period(local, is_holiday(F.to_date(local))).alias("period"), F.col("lbmp"), F.col("mcc"))
    g = h.groupBy("month", *UNIT).agg(F.avg("lbmp").alias("total"), F.avg(-F.col("mcc")).alias("congestion"), F.count(F.lit(1)).alias("_n"))
    full = g.groupBy("month", "zone").agg(F.sum("_n").alias("_n")).filter(F.col("_n") >= MIN_COVERAGE * 24 * F.day(F.last_day("month")))
    return g.drop("_n").join(full.select("month", "zone"), ["month", "zone"], "left_semi")


def cutoff(month: Column, h: Column) -> Column:
    """Information cutoff of horizon h: first day of the month (h - 1) months earlier, minus the embargo."""
    return F.date_sub(F.add_months(month, (1 - h).cast("int")), EMBARGO_DAYS)


def vintages(a: DataFrame, first: date, last: date | None = None) -> DataFrame:
    """(month, h, cutoff) for every target month and horizon."""
    end = a.agg(F.max("month").alias("_b")) if last is None else a.sparkSession.range(1).select(F.lit(last).alias("_b"))
    m = end.select(F.explode(F.sequence(F.lit(first), F.col("_b"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    m = m.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(HORIZONS))))
    return m.withColumn("cutoff", cutoff(F.col("month"), F.col("h")))


def gas_at(gas: DataFrame, cuts: DataFrame) -> DataFrame:
    """(cutoff, gas): mean of the last ten trade days at least a week before each cutoff, whatever their age.

    Each trade day carries the ten values up to and with it; a cutoff takes those of the last trade day it may know.  Both sides are calendar-sized.
    """
    w = Window.orderBy("trade_date").rowsBetween(1 - GAS_DAYS, 0)
    days = gas.select("trade_date", F.avg("hh").over(w).alias("gas"))
    asked = cuts.select("cutoff").distinct().withColumn("_until", F.date_sub("cutoff", GAS_LAG))
    both = days.select(F.col("trade_date").alias("_d"), F.lit(None).cast("date").alias("cutoff"), F.struct("gas").alias("_g")).unionByName(
        asked.select(F.col("_until").alias("_d"), F.col("cutoff").cast("date").alias("cutoff"), F.lit(None).cast("struct<gas:double>").alias("_g")))
    last = Window.orderBy("_d", F.col("cutoff").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("_g", F.last("_g", ignorenulls=True).over(last)).where(F.col("cutoff").isNotNull() & F.col("_g").isNotNull())
    return known.select("cutoff", F.col("_g.gas").alias("gas"))


def _known(a: DataFrame, cuts: DataFrame) -> DataFrame:
    """Actual months fully delivered before each cutoff: (cutoff, actual columns).  Months x cutoffs, both calendar sized."""
    ends = F.add_months("month", 1)
    first = a.agg(F.min(F.year(ends))).first()[0]
    years = cuts.select("cutoff").distinct().withColumn("_y", F.explode(F.sequence(F.least(F.lit(first), F.year("cutoff")), F.year("cutoff"))))
    return a.withColumn("_y", F.year(ends)).join(years, "_y").filter(ends <= F.col("cutoff")).drop("_y")


def point_forecasts(a: DataFrame, gas: DataFrame, first: date, last: date | None = None) -> DataFrame:
    """Every model's point forecasts per (month, h, zone, period), plus the deviations the decay model needs."""
    v = vintages(a, first, last)
    hh = gas.groupBy(F.trunc("trade_date", "MM").alias("month")).agg(F.avg("hh").alias("hh_month"))
    a = a.join(hh, "month", "left")
    known = _known(a, v)
    last_month = known.groupBy("cutoff").agg(F.max("month").alias("last_month"))
    v = v.join(last_month, "cutoff")
    units = a.select(*UNIT).distinct()
    base = v.select("month", "h", "cutoff", "last_month", F.month("month").alias("_cal"))
    k = known.withColumnRenamed("month", "km").withColumn("_cal", F.month("km"))
    # same calendar month: joined on (cutoff, calendar month)
    same = base.join(k, ["cutoff", "_cal"]).filter(F.col("km") < F.col("month"))
    recent = F.col("km") >= F.add_months("month", -12 * NORM_YEARS)
    heat = F.try_divide("total", "hh_month")
    norms = same.groupBy("month", "h", *UNIT).agg(
        F.avg("total").alias("m5_norm_total"), F.avg("congestion").alias("m5_norm_congestion"), F.median(F.when(recent, heat)).alias("_ihr"),
        F.median(F.when(recent, F.col("congestion"))).alias("m5_anchor_congestion"),
        F.max(F.when(F.col("km") == F.add_months("month", -12), F.col("total"))).alias("m5_lastyear_total"),
        F.max(F.when(F.col("km") == F.add_months("month", -12), F.col("congestion"))).alias("m5_lastyear_congestion"))
    lastv = base.select("month", "h", "cutoff", "last_month").join(k.drop("_cal"), "cutoff").filter(F.col("km") == F.col("last_month")).select(
        "month", "h", *UNIT, F.col("total").alias("m5_persist_total"), F.col("congestion").alias("m5_persist_congestion"), F.col("hh_month").alias("_hh_last"))
    own = base.select("month", "h", "cutoff", "last_month", F.month("last_month").alias("_cal")).join(k, ["cutoff", "_cal"]).filter(
        (F.col("km") < F.col("last_month")) & (F.col("km") >= F.add_months("last_month", -12 * NORM_YEARS)))
    own = own.groupBy("month", "h", *UNIT).agg(F.median(heat).alias("_ihr_last"), F.median("congestion").alias("_cn_last"))
    spine = base.drop("_cal").withColumn("_one", F.lit(1)).join(units.withColumn("_one", F.lit(1)), "_one").drop("_one")
    key = ["month", "h", *UNIT]
    out = spine.join(norms, key, "left").join(lastv, key, "left").join(own, key, "left").join(gas_at(gas, v), "cutoff", "left")
    return out.withColumns({"m5_anchor_total": F.col("_ihr") * F.col("gas"), "dev_total": F.ln(F.try_divide("m5_persist_total", F.col("_ihr_last") * F.col("_hh_last"))),
                            "dev_congestion": F.col("m5_persist_congestion") - F.col("_cn_last")}).drop("_ihr", "_ihr_last", "_hh_last", "_cn_last")


def decay_fit(pf: DataFrame, a: DataFrame) -> DataFrame:
    """Adds phi, psi and the decay forecasts: slopes through the origin on targets known at the cutoff, kept in [0, 1]."""
    y = a.select("month", *UNIT, "total", "congestion")
    d = pf.join(y, ["month", *UNIT], "left")
    yt, yc = F.ln(F.try_divide("total", "m5_anchor_total")), F.col("congestion") - F.col("m5_anchor_congestion")
    xt, xc = F.col("dev_total"), F.col("dev_congestion")
    both = lambda u, x: u.isNotNull() & x.isNotNull()                                       # noqa: E731
    # sums per (h, month), then one prefix step over months: cutoffs only ever see whole months
    per = d.groupBy("h", "month").agg(
        F.sum(F.when(both(yt, xt), yt * xt)).alias("_xyt"), F.sum(F.when(both(yt, xt), xt * xt)).alias("_xxt"),
        F.sum(F.when(both(yc, xc), yc * xc)).alias("_xyc"), F.sum(F.when(both(yc, xc), xc * xc)).alias("_xxc"))
    cuts = pf.select("h", "cutoff").distinct()
    j = per.withColumnRenamed("month", "_m").join(cuts, "h").filter(F.add_months("_m", 1) <= F.col("cutoff"))
    unit = lambda r: F.greatest(F.lit(0.0), F.least(F.lit(1.0), r))                         # noqa: E731
    coef = j.groupBy("h", "cutoff").agg(unit(F.try_divide(F.sum("_xyt"), F.sum("_xxt"))).alias("phi"), unit(F.try_divide(F.sum("_xyc"), F.sum("_xxc"))).alias("psi"))
    out = pf.join(coef, ["h", "cutoff"], "left").na.fill(0.0, ["phi", "psi"])
    zero = F.lit(0.0)
    return out.withColumns({"m5_decay_total": F.col("m5_anchor_total") * F.exp(F.col("phi") * F.coalesce("dev_total", zero)),
                            "m5_decay_congestion": F.col("m5_anchor_congestion") + F.col("psi") * F.coalesce("dev_congestion", zero)})


def distributions(pf: DataFrame, a: DataFrame, model: str, min_errors: int = MIN_ERRORS) -> DataFrame:
    """Rows (month, h, zone, period, component) with point, mean, quantiles from the model's earlier errors, and y.

    Total: log errors; congestion: level errors.  A zone with too few errors uses the pool.  Groups are months of history.
    """
    y = a.select("month", *UNIT, F.col("total").alias("_yt"), F.col("congestion").alias("_yc"))
    d = pf.select("month", "h", "cutoff", *UNIT, F.col(f"{model}_total").alias("_pt"), F.col(f"{model}_congestion").alias("_pc")).join(y, ["month", *UNIT], "left")
    comp = F.array(F.struct(F.lit("total").alias("component"), F.col("_pt").alias("point"), F.col("_yt").alias("y")),
                   F.struct(F.lit("congestion").alias("component"), F.col("_pc").alias("point"), F.col("_yc").alias("y")))
    d = d.select("month", "h", "cutoff", *UNIT, F.explode(comp).alias("_c")).select("month", "h", "cutoff", *UNIT, "_c.*")
    is_total = F.col("component") == "total"
    d = d.withColumn("err", F.when(is_total, F.ln(F.try_divide("y", "point"))).otherwise(F.col("y") - F.col("point")))
    errs = d.filter("err IS NOT NULL").select("component", "h", "zone", F.col("month").alias("_m"), "err")
    cuts = d.select("component", "h", "cutoff").distinct()
    prior = errs.join(cuts, ["component", "h"]).filter(F.add_months("_m", 1) <= F.col("cutoff"))
    levels = F.array(*[F.lit(q) for q in QUANTILES])
    stats = lambda tag: [F.percentile("err", levels).alias(f"_q{tag}"), F.count("err").alias(f"_n{tag}"), F.avg("err").alias(f"_m{tag}"), F.avg(F.exp("err")).alias(f"_e{tag}")]
    zonal = prior.groupBy("component", "h", "cutoff", "zone").agg(*stats("z"))
    pool = prior.groupBy("component", "h", "cutoff").agg(*stats("p"))
    j = d.join(zonal, ["component", "h", "cutoff", "zone"], "left").join(pool, ["component", "h", "cutoff"], "left")
    use_z, use_p = F.coalesce(F.col("_nz") >= min_errors, F.lit(False)), F.coalesce(F.col("_np") >= min_errors, F.lit(False))
    pick = lambda s: F.when(use_z, F.col(f"_{s}z")).when(use_p, F.col(f"_{s}p"))            # noqa: E731
    q = pick("q")
    cols = {c: F.when(is_total, F.col("point") * F.exp(q[i])).otherwise(F.col("point") + q[i]) for i, c in enumerate(QCOLS)}
    cols["mean"] = F.when(is_total, F.col("point") * pick("e")).otherwise(F.col("point") + pick("m"))
    return j.withColumns(cols).select("month", "h", "cutoff", *UNIT, "component", "point", "y", "mean", *QCOLS)


def monthly_scores(d: DataFrame, by: list[str] | None = None) -> DataFrame:
    """CRPS, RMSE, MAE and 90 % coverage by component and zone, plus ALL."""
    s = with_total(d.filter(F.col("y").isNotNull() & F.col("mean").isNotNull() & has_quantiles()))
    e = F.col("mean") - F.col("y")
    return s.groupBy(*(by or []), "component", "zone").agg(F.count(F.lit(1)).alias("n"), F.avg(crps(F.col("y"))).alias("crps"), F.sqrt(F.avg(e * e)).alias("rmse"),
                                                           F.avg(F.abs(e)).alias("mae"), F.avg(covered(F.col("y"), "q05", "q95")).alias("cov90"))


def latest_vintage(today: date) -> tuple[date, date]:
    """(cutoff, first target month) of the most recent monthly issue."""
    target = next_month(today)
    if target - timedelta(days=EMBARGO_DAYS) > today:
        target = today.replace(day=1)
    return target - timedelta(days=EMBARGO_DAYS), target


def live(a: DataFrame, gas: DataFrame, today: date, choice: dict[str, str], first: date) -> DataFrame:
    """Forecasts of the latest vintage for six target months, one model per component, nothing after the cutoff."""
    cut, m1 = latest_vintage(today)
    last = m1
    for _ in range(HORIZONS - 1):
        last = next_month(last)
    known = a.filter(F.add_months("month", 1) <= F.lit(cut))
    pf = decay_fit(point_forecasts(known, gas, first, last), known)
    out = None
    for comp, model in choice.items():
        d = distributions(pf, known, model).filter((F.col("component") == comp) & (F.col("cutoff") == F.lit(cut)) & (F.col("month") >= F.lit(m1)))
        d = d.withColumn("model", F.lit(model))
        out = d if out is None else out.unionByName(d)
    return out
