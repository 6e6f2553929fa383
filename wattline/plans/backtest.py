"""Run a model over the folds: predict, calibrate, join truth and reference, score, store."""

from __future__ import annotations

from contextlib import ExitStack
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.models.residuals import oos_quantiles
from wattline.operators.reshape import targets_long
from wattline.operators.scoring import score_table, scored_rows, zone_and_total_scores
from wattline.plans.folds import Fold
from wattline.plans.registry import Registry
from wattline.session import cut_lineage
from wattline.settings import EMBARGO_DAYS, QCOLS

MATCH = ["ts_utc", "zone", "market", "component"]


class Model(Protocol):
    """Anything with a name, a config and `fit_predict(panel, folds)` returning rows with fold, PRED_KEYS and mean."""

    name: str

    def config(self) -> dict: ...

    def fit_predict(self, panel: DataFrame, folds: list[Fold]) -> DataFrame: ...


def join_truth(pred: DataFrame, panel: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    truth = targets_long(panel).select(*MATCH, "y", "scored")
    out = pred.drop("y", "scored", "ref_mean").join(truth, MATCH)
    if reference is None:
        return out.withColumn("ref_mean", F.lit(None).cast("double"))
    return out.join(reference.select(*MATCH, F.col("mean").alias("ref_mean")), MATCH)


def run_folds(model: Model, panel: DataFrame, folds: list[Fold], reference: DataFrame | None = None, quantiles: str = "model",
              lookback_days: int = 365) -> DataFrame:
    """Predictions of all folds as one DataFrame.

    quantiles='oos_residual' replaces the model's quantiles by those of its own earlier out-of-sample errors.
    """
    out = join_truth(model.fit_predict(panel, folds), panel, reference)
    if quantiles == "oos_residual":
        out = oos_quantiles(out, folds, lookback_days)
    return out.withColumns({c: F.lit(None).cast("double") for c in QCOLS if c not in out.columns})


def fold_scores(pred: DataFrame) -> DataFrame:
    return zone_and_total_scores(pred, ["fold", "market", "component"], "ref_mean")


def pooled_summary(pred: DataFrame, by: list[str]) -> DataFrame:
    """Metrics over all folds from stored predictions (not averages of fold metrics)."""
    return score_table(scored_rows(pred), [*by, "market", "component"], "ref_mean")


def run(registry: Registry, model: Model, panel: DataFrame, folds: list[Fold], reference: DataFrame | None = None, quantiles: str = "model") -> str:
    """Logged run.  The predictions are checkpointed once, so scoring and storing do not refit."""
    return run_all(registry, [model], panel, folds, reference, quantiles)[0]


def run_all(registry: Registry, models: list[Model], panel: DataFrame, folds: list[Fold], reference: DataFrame | None = None, quantiles: str = "model") -> list[str]:
    """Logged runs of several models over the same folds: each has its own lines in the log and its own slots, but they share the checkpoint, the scoring and the writes.

    They are done or failed together."""
    rows = panel.count()
    shared = {"folds": len(folds), "embargo_days": EMBARGO_DAYS, "quantiles": quantiles, "first_fold": folds[0].name, "last_fold": folds[-1].name}
    with ExitStack() as open_runs:
        kept = registry.keep_panel(panel)
        ids = [open_runs.enter_context(registry.running(m.name, {**m.config(), **shared}, panel_rows=rows, panel_hash=kept)) for m in models]
        preds = [run_folds(m, panel, folds, reference, quantiles).withColumn("run_id", F.lit(i)) for m, i in zip(models, ids, strict=True)]
        pred = cut_lineage(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), preds))
        registry.save_predictions(None, pred)
        registry.save_scores(None, zone_and_total_scores(pred, ["run_id", "fold", "market", "component"], "ref_mean"))
    return ids
