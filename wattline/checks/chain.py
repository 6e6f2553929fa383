"""A recipe continued over a holdout span through the registry, over the whole book."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.checks.base import FOLD_START, FOLDS_SQL, PRED_SQL, Tables, check, rounded
from wattline.models.naive import long_forecast
from wattline.plans import backtest
from wattline.plans.folds import Fold, assign_test_fold
from wattline.plans.recipes import Clipped, Combined, Stored, continue_over_holdout
from wattline.plans.registry import Registry
from wattline.session import checkpoint_dir, cut_lineage
from wattline.settings import MARKETS, TARGETS

SPLIT = date(2000, 1, 1)        # folds from here on are the holdout


class Lagged:
    """The day-ahead price of some days before, for both markets."""

    def __init__(self, name: str, *lags: str):
        self.name, self.lags = name, lags

    def config(self) -> dict:
        return {"lags": list(self.lags)}

    def fit_predict(self, panel: DataFrame, folds: list[Fold]) -> DataFrame:
        point = F.coalesce(*[F.col(c) for c in self.lags])
        return long_forecast(assign_test_fold(panel, folds), {(m, "total"): point for m in MARKETS}, ["fold"])


def book_panel(t: Tables) -> DataFrame:
    """The lagged book as a panel of one hour a day that knows only the total price."""
    b = t.lagged_book()
    known = {f"{m}_total": F.col(m) for m in MARKETS}
    return b.select(F.col("d").alias("delivery_date"), F.col("d").cast("timestamp").alias("ts_utc"), "zone", F.lit(0).alias("hour_local"), "da_l1", "da_l7",
                    *[known.get(c, F.lit(None).cast("double")).alias(c) for c in TARGETS], *[F.lit(True).alias(f"score_{m}") for m in MARKETS])


@check("holdout_chain", f"""WITH {PRED_SQL}, {FOLDS_SQL},
al AS MATERIALIZED (SELECT a.d, a.zone, a.market, a.y, a.mean AS m0, b.mean AS m1 FROM pred a JOIN pred b USING (d, zone, market) WHERE a.trial = 'm1' AND b.trial = 'm7'),
w AS MATERIALIZED (SELECT fold, market, 1 / avg(abs(m0 - y)) AS i0, 1 / avg(abs(m1 - y)) AS i1 FROM al JOIN folds ON d < train_end AND d >= train_end - 365 WHERE d >= DATE '{FOLD_START}' GROUP BY 1, 2),
h AS MATERIALIZED (SELECT fold, zone, min(da) AS da_lo, max(da) AS da_hi, min(rt) AS rt_lo, max(rt) AS rt_hi FROM book JOIN folds ON d < train_end GROUP BY 1, 2),
c AS (SELECT f.fold, d, al.zone, al.market, coalesce(i0 / (i0 + i1), 0.5) AS weight, coalesce(i0 / (i0 + i1), 0.5) * m0 + coalesce(i1 / (i0 + i1), 0.5) * m1 AS v,
  CASE al.market WHEN 'da' THEN da_lo ELSE rt_lo END AS lo, CASE al.market WHEN 'da' THEN da_hi ELSE rt_hi END AS hi
  FROM al JOIN folds f ON d >= test_start AND d < test_end LEFT JOIN w ON w.fold = f.fold AND w.market = al.market LEFT JOIN h ON h.fold = f.fold AND h.zone = al.zone)
SELECT fold, CASE WHEN d < DATE '{SPLIT}' THEN 'validation' ELSE 'holdout' END AS span, d AS delivery_date, zone, market, round(weight, 6) AS weight,
  round(CASE WHEN v IS NOT NULL THEN least(greatest(v, lo), hi) END, 6) AS mean FROM c""")
def holdout_chain(t: Tables):
    """Two members run over the validation folds, then the chain: both refitted over the holdout, and their clipped combination, weighted by inverse error, over both spans as one run."""
    reg = Registry(t.spark, f"{checkpoint_dir(t.spark)}/chain-{uuid.uuid4().hex}")
    panel = cut_lineage(book_panel(t))
    folds = t.folds()
    validation, holdout = [f for f in folds if f.test_start < SPLIT], [f for f in folds if f.test_start >= SPLIT]
    members = {"day": Lagged("day", "da_l1", "da_l7"), "week": Lagged("week", "da_l7", "da_l1")}
    backtest.run_all(reg, list(members.values()), panel, validation)
    recipe = Clipped(Combined(tuple(Stored(n) for n in members), "inv_mae"))
    run_id = continue_over_holdout(reg, "mix", recipe, members, panel, validation, holdout, quantiles="model")["mix_holdout"]
    weight = reg.artifact(run_id, "weights_0").where("part = 0").select("fold", "market", "weight")
    span = F.when(F.col("delivery_date") < F.lit(SPLIT), "validation").otherwise("holdout")
    out = reg.predictions(run_id).join(weight, ["fold", "market"], "left")
    return rounded(out.select("fold", span.alias("span"), "delivery_date", "zone", "market", F.coalesce("weight", F.lit(0.5)).alias("weight"), "mean"))
