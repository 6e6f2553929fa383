"""Transmission-path contracts: realised and expected payoffs, and whether the pricer's edge is real.

A path pays sink minus source congestion over its period.  Payoffs are linear in the two points, so hourly prices are
first summed per point and local day; a path then needs two small lookups instead of an hourly join.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.clock import hours_between_days, local_date
from wattline.models.congestion import shift_factors
from wattline.operators.resampling import cluster_bootstrap, shuffle_within
from wattline.operators.significance import clustered_slope, diebold_mariano
from wattline.operators.sparse import top_keys
from wattline.session import cut_lineage
from wattline.settings import MARKET_TZ

WINDOW_DAYS, TOP_K, MIN_COVERAGE, NODE_COVERAGE, CUTOFF_LAG = 365, 60, 0.99, 0.90, 7
ILLIQUID_MONTHS = 24
FEE_REL, FEE_ABS = 0.02, 0.5
FINAL_FROM = date(2025, 1, 1)


def auction_paths(awards: DataFrame, rounds: DataFrame) -> DataFrame:
    """One row per awarded path and auction period; a path with two clearing prices fails the job."""
    g = awards.join(rounds.select("round_id", "kind", "term_months"), "round_id").groupBy("round_id", "period_id", "poi", "pow").agg(
        F.min("mcp").alias("c"), F.max("mcp").alias("_hi"), F.sum("tccs_awarded").alias("mw"), F.min("posted_date").alias("posted"),
        F.min("period_start").alias("start"), F.min("period_end").alias("end"), F.min("period_months").alias("months"),
        F.min("kind").alias("kind"), F.min("term_months").alias("term_months"))
    same = F.when(F.col("_hi").eqNullSafe(F.col("c")), F.col("c")).otherwise(F.raise_error(F.lit("a path has two clearing prices in one period")).cast("double"))
    return g.withColumn("c", same).drop("_hi")


def illiquid_flag(paths: DataFrame, nodes: DataFrame, months: int = ILLIQUID_MONTHS) -> DataFrame:
    """Nodal path without an award in the `months` before its auction.

    Distinct posting dates per path are few; the previous one is a lag over them.
    """
    seen = paths.select("poi", "pow", "posted").distinct()
    w = Window.partitionBy("poi", "pow").orderBy("posted")
    seen = seen.withColumn("_last", F.lag("posted").over(w))
    recent = F.coalesce(F.col("_last") >= F.add_months("posted", -months), F.lit(False))
    n = nodes.select(F.col("ptid").alias("_p")).distinct().withColumn("_node", F.lit(True))
    j = paths.join(seen, ["poi", "pow", "posted"])
    for side in ("poi", "pow"):
        j = j.join(n.select(F.col("_p").alias(side), F.col("_node").alias(f"_{side}")), side, "left")
    nodal = F.coalesce(F.col("_poi"), F.lit(False)) | F.coalesce(F.col("_pow"), F.lit(False))
    return j.withColumn("illiquid", nodal & ~recent).drop("_poi", "_pow", "_last")


def point_days(cong: DataFrame, tz: str = MARKET_TZ) -> DataFrame:
    """(ptid, d, s, n): congestion sum and hours with a price per point and local day."""
    return cong.filter("cong IS NOT NULL").groupBy("ptid", local_date(F.col("ts_utc"), tz).alias("d")).agg(F.sum("cong").alias("s"), F.count("cong").alias("n"))


def day_sums(cong: DataFrame, tz: str = MARKET_TZ) -> tuple[DataFrame, DataFrame]:
    """(running, gaps): for each point and day of the table's span the sum `cs` and the hours `ch` of its whole days up to it, and the days on which a point lacks an
    hour that some point has, with what it does have as zero or one whole day: (ptid, d, s, h) summed over whole days only.

    A point is a calendar of days, so the running window is bounded."""
    slim = point_days(cong, tz)
    clock = cong.filter("cong IS NOT NULL").select("ts_utc").distinct().groupBy(local_date(F.col("ts_utc"), tz).alias("d")).agg(F.count("*").alias("h"))
    span = clock.agg(F.min("d").alias("_a"), F.max("d").alias("_b"))
    grid = slim.select("ptid").distinct().join(span).select("ptid", F.explode(F.sequence("_a", "_b")).alias("d"))
    full = slim.join(clock, "d").where("n = h").select("ptid", "d", "s", "h")
    laid = grid.join(full, ["ptid", "d"], "left")
    upto = Window.partitionBy("ptid").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    running = laid.select("ptid", "d", F.sum(F.coalesce("s", F.lit(0.0))).over(upto).alias("cs"), F.sum(F.coalesce("h", F.lit(0))).over(upto).alias("ch"))
    gaps = laid.where("h IS NULL").join(clock.select("d"), "d", "left_semi").select("ptid", "d")
    return running, gaps


def span_payoff(cong: DataFrame, asks: DataFrame, tz: str = MARKET_TZ) -> DataFrame:
    """For asks (ask, poi, pow, a, b): sum of sink minus source over local days a..b where both are priced, and the hours.

    Running sums of whole days answer a span by two lookups an end, whatever its length.  Hours where only one end is priced must not count, so the days on
    which either end lacks an hour are matched hour by hour and put in the place of what the running sums hold of them.
    """
    running, gaps = day_sums(cong, tz)
    running, gaps = cut_lineage(running), cut_lineage(gaps)
    edge = running.agg(F.min("d").alias("_min"), F.max("d").alias("_max"))
    known, own = running.select("ptid").distinct(), asks
    for end in ("poi", "pow"):                               # without a price at one end there is nothing to sum
        own = own.join(known.withColumnRenamed("ptid", end), end, "left_semi")
    own = own.join(edge).withColumns({"_lo": F.date_sub("a", 1), "_hi": F.least("b", "_max")})
    for end in ("poi", "pow"):
        for at in ("_lo", "_hi"):
            # a point has a row for every day of the table's span; before it there is nothing to subtract
            day = F.least(at, "_max") if at == "_lo" else F.col(at)
            look = running.select(F.col("ptid").alias(end), F.col("d").alias("_d"), F.col("cs").alias(f"{at}_{end}_s"), F.col("ch").alias(f"{at}_{end}_h"))
            own = own.withColumn("_d", day).join(look, [end, "_d"], "left").drop("_d")
    part = lambda end, c: F.coalesce(f"_hi_{end}_{c}", F.lit(0)) - F.coalesce(f"_lo_{end}_{c}", F.lit(0))          # noqa: E731
    own = own.select("ask", (part("pow", "s") - part("poi", "s")).alias("_s"), part("pow", "h").alias("_h"))

    # days with gaps
    pairs = asks.where("a <= b").groupBy("poi", "pow").agg(F.min("a").alias("_a"), F.max("b").alias("_b"))
    lost = None
    for end in ("poi", "pow"):
        g = pairs.join(gaps.withColumnRenamed("ptid", end), end).where(F.col("d").between(F.col("_a"), F.col("_b"))).select("poi", "pow", "d")
        lost = g if lost is None else lost.unionByName(g)
    lost = cut_lineage(lost.distinct())
    hours = cong.filter("cong IS NOT NULL").select("ptid", "ts_utc", local_date(F.col("ts_utc"), tz).alias("d"), "cong")
    src = lost.join(hours.select(F.col("ptid").alias("poi"), "d", "ts_utc", F.col("cong").alias("_src")), ["poi", "d"])
    both = src.join(hours.select(F.col("ptid").alias("pow"), "ts_utc", F.col("cong").alias("_snk")), ["pow", "ts_utc"])
    exact = both.groupBy("poi", "pow", "d").agg(F.sum(F.col("_snk") - F.col("_src")).alias("_es"), F.count(F.lit(1)).alias("_eh"))
    # what the running sums hold of these days: the one end that is whole
    for end in ("poi", "pow"):
        day = running.select(F.col("ptid").alias(end), "d", "cs", "ch")
        before = running.select(F.col("ptid").alias(end), F.date_add("d", 1).alias("d"), F.col("cs").alias("_ps"), F.col("ch").alias("_ph"))
        lost = lost.join(day, [end, "d"], "left").join(before, [end, "d"], "left").select(
            *[c for c in lost.columns], (F.coalesce("cs", F.lit(0.0)) - F.coalesce("_ps", F.lit(0.0))).alias(f"_{end}_s"), (F.coalesce("ch", F.lit(0)) - F.coalesce("_ph", F.lit(0))).alias(f"_{end}_h"))
    mend = lost.join(exact, ["poi", "pow", "d"], "left").select(
        "poi", "pow", "d", (F.coalesce("_es", F.lit(0.0)) - F.col("_pow_s") + F.col("_poi_s")).alias("_ms"), (F.coalesce("_eh", F.lit(0)) - F.col("_pow_h")).alias("_mh"))
    mended = asks.select("ask", "poi", "pow", "a", "b").join(mend, ["poi", "pow"]).where(F.col("d").between(F.col("a"), F.col("b"))).groupBy("ask").agg(F.sum("_ms").alias("_ms"), F.sum("_mh").alias("_mh"))
    got = own.join(mended, "ask", "left").select("ask", (F.col("_s") + F.coalesce("_ms", F.lit(0.0))).alias("_p"), (F.col("_h") + F.coalesce("_mh", F.lit(0))).cast("long").alias("hours"))
    out = asks.join(got, "ask", "left").na.fill(0, ["hours"])
    return out.withColumns({"hours": F.when(F.col("a") <= F.col("b"), F.col("hours")).otherwise(F.lit(0)), "payoff": F.when((F.col("a") <= F.col("b")) & (F.col("hours") > 0), F.col("_p"))}).drop("_p")


def price_baselines(paths: DataFrame, cong: DataFrame, tz: str = MARKET_TZ) -> DataFrame:
    """Adds y (realised), climatology and persistence, each NULL where its coverage rule fails."""
    p = paths.withColumn("cutoff", F.date_sub("posted", CUTOFF_LAG)).withColumn("n_hours", hours_between_days(F.col("start"), F.col("end"), tz))
    p = p.withColumn("_id", F.struct("round_id", "period_id", "poi", "pow"))
    prev_a, prev_b = F.add_months("start", -12), F.add_months("end", -12)
    spans = F.array(F.struct(F.lit("y").alias("what"), F.col("start").alias("a"), F.col("end").alias("b")),
                    F.struct(F.lit("clim").alias("what"), F.date_sub("cutoff", WINDOW_DAYS).alias("a"), F.date_sub("cutoff", 1).alias("b")),
                    F.struct(F.lit("prev").alias("what"), prev_a.alias("a"), prev_b.alias("b")))
    asks = p.select("poi", "pow", "_id", F.explode(spans).alias("_s")).select("poi", "pow", F.struct("_id", "_s.what").alias("ask"), "_s.a", "_s.b")
    got = span_payoff(cong, asks, tz)
    wide = got.groupBy(F.col("ask._id").alias("_id")).agg(*[F.max(F.when(F.col("ask.what") == k, F.col(v))).alias(f"_{k}_{v}")
                                                          for k in ("y", "clim", "prev") for v in ("payoff", "hours")])
    j = p.join(wide, "_id").drop("_id")
    clim_hours = hours_between_days(F.date_sub("cutoff", WINDOW_DAYS), F.date_sub("cutoff", 1), tz)
    prev_hours = hours_between_days(prev_a, prev_b, tz)
    return j.withColumns({
        "y": F.when(F.col("_y_hours") >= F.col("n_hours") * MIN_COVERAGE, F.col("_y_payoff")),
        "climatology": F.when(F.col("_clim_hours") >= clim_hours * MIN_COVERAGE, F.col("_clim_payoff") / F.col("_clim_hours") * F.col("n_hours")),
        "persistence": F.when((prev_b < F.col("cutoff")) & (F.col("_prev_hours") >= prev_hours * MIN_COVERAGE),
                              F.col("_prev_payoff") / prev_hours * F.col("n_hours"))}).drop(*[c for c in wide.columns if c != "_id"])


def structural_payoff(paths: DataFrame, shadow: DataFrame, slot_cong: DataFrame, k: int = TOP_K, ridge: float = 1.0, tz: str = MARKET_TZ) -> DataFrame:
    """Adds struct_trailing, struct_seasonal and struct_blend: shift-factor difference x mean shadow price x hours.

    All auctions with the same cutoff share one factor fit; `slot_cong` is (d, hr, ptid, cong), `shadow` (d, hr, key, mu).
    """
    p = paths.withColumn("cutoff", F.date_sub("posted", CUTOFF_LAG)).withColumn("n_hours", hours_between_days(F.col("start"), F.col("end"), tz))
    cuts = p.select("cutoff").distinct().withColumn("d", F.explode(F.sequence(F.date_sub("cutoff", WINDOW_DAYS), F.date_sub("cutoff", 1))))
    sp = shadow.join(cuts, "d")
    cat = top_keys(sp, ["cutoff"], "key", "mu", k)
    points = p.select("cutoff", F.explode(F.array("poi", "pow")).alias("ptid")).distinct()
    cong = slot_cong.join(cuts, "d").join(points, ["cutoff", "ptid"], "left_semi")
    enough = cong.groupBy("cutoff", "ptid").agg(F.count("cong").alias("_n")).filter(F.col("_n") >= NODE_COVERAGE * WINDOW_DAYS * 24)
    cong = fill_slots(cong.join(enough.drop("_n"), ["cutoff", "ptid"]), ["cutoff", "ptid"])
    a = shift_factors(sp, cat, cong, "ptid", "cong", ridge, ["cutoff"], k)
    month = sp.join(cat.select("cutoff", "key"), ["cutoff", "key"]).groupBy("cutoff", "key", F.month("d").alias("m")).agg(F.sum("mu").alias("_mu"))
    slots = cuts.groupBy("cutoff", F.month("d").alias("m")).agg((F.count(F.lit(1)) * 24).alias("_h"))
    # mean shadow price over the window, and over the period's calendar months (the whole window when it has none of them)
    period = p.select("cutoff", "start", "end").distinct().withColumn("_ms", F.array_distinct(F.transform(F.sequence("start", "end"), F.month)))
    hours = period.join(slots, "cutoff").groupBy("cutoff", "start", "end").agg(
        F.sum("_h").alias("_all"), F.sum(F.when(F.array_contains("_ms", F.col("m")), F.col("_h"))).alias("_sea"))
    value = period.join(month, "cutoff").groupBy("cutoff", "start", "end", "key").agg(
        F.sum("_mu").alias("_t"), F.sum(F.when(F.array_contains("_ms", F.col("m")), F.col("_mu"))).alias("_s"))
    value = value.join(hours, ["cutoff", "start", "end"]).withColumns({
        "_tr": F.col("_t") / F.col("_all"), "_se": F.when(F.col("_sea") > 0, F.coalesce("_s", F.lit(0.0)) / F.col("_sea")).otherwise(F.col("_t") / F.col("_all"))})
    worth = value.join(a, ["cutoff", "key"]).groupBy("cutoff", "start", "end", "ptid").agg(
        F.sum(F.col("a") * F.col("_tr")).alias("_tr"), F.sum(F.col("a") * F.col("_se")).alias("_se"))
    end = lambda side: worth.select("cutoff", "start", "end", F.col("ptid").alias(side), F.col("_tr").alias(f"_t_{side}"), F.col("_se").alias(f"_s_{side}"))
    key = ["cutoff", "start", "end"]
    j = p.join(end("poi"), [*key, "poi"], "left").join(end("pow"), [*key, "pow"], "left")
    j = j.withColumns({"struct_trailing": (F.col("_t_pow") - F.col("_t_poi")) * F.col("n_hours"), "struct_seasonal": (F.col("_s_pow") - F.col("_s_poi")) * F.col("n_hours")})
    return j.withColumn("struct_blend", (F.col("struct_trailing") + F.col("struct_seasonal")) / 2).drop("_t_poi", "_t_pow", "_s_poi", "_s_pow")


def fill_slots(cong: DataFrame, by: list[str]) -> DataFrame:
    """Missing hours take the last value before, else the next after; one point's window is a year of hours."""
    span = cong.groupBy(*by).agg(F.min("d").alias("_a"), F.max("d").alias("_b"))
    spine = span.select(*by, F.explode(F.sequence("_a", "_b")).alias("d")).withColumn("hr", F.explode(F.sequence(F.lit(0), F.lit(23))))
    j = spine.join(cong.select(*by, "d", "hr", "cong"), [*by, "d", "hr"], "left")
    w = Window.partitionBy(*by).orderBy("d", "hr")
    before = F.last("cong", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("cong", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return j.withColumn("cong", F.coalesce(before, after))


def observation_table(priced: DataFrame, final_from: date = FINAL_FROM) -> DataFrame:
    """Path label, auction number in posting order and the final-test flag."""
    auctions = priced.select("posted", "round_id", "period_id").distinct()
    num = auctions.withColumn("auction", F.row_number().over(Window.orderBy("posted", "round_id", "period_id")) - 1)
    return priced.join(num, ["posted", "round_id", "period_id"]).withColumns({
        "path": F.concat_ws(">", F.col("poi").cast("string"), F.col("pow").cast("string")), "final": F.col("posted") >= F.lit(final_from)})


def edge(obs: DataFrame, forecast: str, fee_rel: float = FEE_REL, fee_abs: float = FEE_ABS) -> DataFrame:
    """s (claimed edge), o (earned by buying), cost and pnl (NULL where the rule does not buy), per MW-month."""
    m = F.col("months").cast("double")
    out = obs.withColumns({"s": (F.col(forecast) - F.col("c")) / m, "o": (F.col("y") - F.col("c")) / m, "cost": F.lit(fee_rel) * F.abs("c") / m + F.lit(fee_abs)})
    return out.withColumn("pnl", F.when(F.col("s") > F.col("cost"), F.col("o") - F.col("cost")))


def permutation_null(obs: DataFrame, forecast: str, draws: int = 1000, seed: int = 0) -> DataFrame:
    """Mean P&L of the buy rule when the edge is shuffled over the paths of each auction: observed, null mean and sd, p."""
    d = edge(obs, forecast).filter("s IS NOT NULL AND o IS NOT NULL").select("auction", "path", "s", "o", "cost")
    seen = d.agg(F.avg(F.when(F.col("s") > F.col("cost"), F.col("o") - F.col("cost"))).alias("observed"))
    mixed = shuffle_within(d, ["auction"], ["path"], ["s"], draws, seed)
    sims = mixed.groupBy("b").agg(F.avg(F.when(F.col("s") > F.col("cost"), F.col("o") - F.col("cost"))).alias("_m")).filter("_m IS NOT NULL")
    return sims.join(seen).agg(F.first("observed").alias("observed"), F.avg("_m").alias("null_mean"), F.stddev_pop("_m").alias("null_sd"),
                               ((F.count_if(F.col("_m") >= F.col("observed")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def squared_error_dm(obs: DataFrame, forecast: str, base: str) -> DataFrame:
    """Diebold-Mariano on squared error per MW-month, averaged within each auction."""
    sq = lambda f: F.pow((F.col("y") - F.col(f)) / F.col("months"), 2)                                                        # noqa: E731
    d = obs.withColumns({"_a": sq(forecast), "_b": sq(base)}).filter("_a IS NOT NULL AND _b IS NOT NULL")
    return diebold_mariano(d, [], "auction", "_a", "_b")


def summarise(obs: DataFrame, forecast: str, baselines: tuple = ("c", "persistence", "climatology"), draws: int = 4000, seed: int = 0) -> DataFrame:
    """(statistic, value): all declared statistics of one forecast on the rows where it and the payoff exist."""
    obs = cut_lineage(obs.filter(F.col(forecast).isNotNull() & F.col("y").isNotNull()))       # read by every statistic
    d = edge(obs, forecast)
    parts = [d.agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_distinct("auction").cast("double").alias("n_auctions"), F.count_distinct("path").cast("double").alias("n_paths")),
             clustered_slope(d, [], "s", "o", "auction").select(*[F.col(c).alias(f"slope_{c}") for c in ("slope", "se", "t")])]
    for by in ("path", "auction"):
        b = cluster_bootstrap(d, [], by, "pnl", draws, seed)
        parts.append(b.select(*[F.col(c).cast("double").alias(f"boot_{by}_{c}") for c in ("n_trades", "mean", "lo", "hi", "p")]))
    null = permutation_null(obs, forecast, seed=seed)
    parts.append(null.select(*[F.col(c).cast("double").alias(f"placebo_{c}") for c in null.columns]))
    for base in baselines:
        dm = squared_error_dm(d, forecast, base)
        parts.append(dm.select(*[F.col(c).cast("double").alias(f"dm_{base}_{c}") for c in dm.columns]))
    rows = None
    for part in parts:
        long = part.unpivot([], part.columns, "statistic", "value")
        rows = long if rows is None else rows.unionByName(long)
    return rows


def accuracy(obs: DataFrame, forecasts: list[str], by: list[str]) -> DataFrame:
    """MAE, RMSE and bias per MW-month on the rows where every forecast exists."""
    d = obs.dropna(subset=["y", *forecasts])
    rows = F.array(*[F.struct(F.lit(f).alias("forecast"), ((F.col("y") - F.col(f)) / F.col("months")).alias("e")) for f in forecasts])
    e = F.col("e")
    return d.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.*").groupBy(*by, "forecast").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))


def universe(obs: DataFrame) -> DataFrame:
    whole: Column = F.col("y").isNotNull() & F.col("persistence").isNotNull() & F.col("climatology").isNotNull()
    return obs.groupBy("kind").agg(F.count_distinct("auction").alias("auction_periods"), F.count(F.lit(1)).alias("path_periods"),
                                   F.count("y").alias("with_payoff"), F.count_if(whole).alias("with_all_baselines"))
