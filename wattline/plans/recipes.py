"""Post-processing recipes as expressions over stored predictions.

A recipe is an object that knows its inputs, for example

    Adaptive(Clipped(Combined((Stored("lear_clip"), Stored("gbm_l1")))))

and `frame(source)` is its predictions for all folds.  Equal parts of a recipe are computed once.  `description()` is the recipe as plain data, which is what a run logs.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.models.residuals import oos_quantiles
from wattline.plans import postprocess as P
from wattline.plans.backtest import Model, fold_scores, run, run_all
from wattline.plans.folds import Fold, guard
from wattline.plans.registry import Registry
from wattline.session import cut_lineage
from wattline.settings import QCOLS


@dataclass
class Source:
    """What recipes draw on: stored predictions by name, the panel (for clipping) and the folds."""

    stored: dict[str, DataFrame]
    panel: DataFrame | None
    folds: list[Fold]
    made: dict[Recipe, DataFrame] = field(default_factory=dict)


@dataclass(frozen=True)
class Recipe:
    def inputs(self) -> Iterator[Recipe]:
        for f in fields(self):
            v = getattr(self, f.name)
            yield from (x for x in (v if isinstance(v, tuple) else (v,)) if isinstance(x, Recipe))

    def names(self) -> list[str]:
        """Stored predictions that the recipe needs."""
        return list(dict.fromkeys(n for part in self.inputs() for n in part.names()))

    def description(self) -> dict:
        return {"is": type(self).__name__.lower(), **asdict(self)}

    def frame(self, source: Source) -> DataFrame:
        if self not in source.made:
            out = self.made_of(source)
            source.made[self] = out.withColumns({c: F.lit(None).cast("double") for c in QCOLS if c not in out.columns})
        return source.made[self]

    def made_of(self, source: Source) -> DataFrame:
        raise NotImplementedError


@dataclass(frozen=True)
class Stored(Recipe):
    name: str

    def names(self) -> list[str]:
        return [self.name]

    def made_of(self, source: Source) -> DataFrame:
        if self.name not in source.stored:
            raise ValueError(f"no stored predictions {self.name}; there are {sorted(source.stored)}")
        return source.stored[self.name]


@dataclass(frozen=True)
class Combined(Recipe):
    """Point forecasts of several parts: equal weights, weights by inverse error (inv_mae) or the median."""

    parts: tuple[Recipe, ...]
    weights: str = "equal"

    def made_of(self, source: Source) -> DataFrame:
        return P.combine(self._frames(source), source.folds, self.weights)

    def _frames(self, source: Source) -> dict[str, DataFrame]:
        return {str(i): p.frame(source) for i, p in enumerate(self.parts)}

    def fold_weights(self, source: Source) -> DataFrame:
        """(fold, market, component, part, weight) of weights by inverse error."""
        n = len(self.parts)
        wide = P.inverse_mae_weights(P.align(self._frames(source)), n, source.folds)
        return wide.unpivot(["fold", "market", "component"], [f"w_{i}" for i in range(n)], "part", "weight").withColumn("part", F.substring("part", 3, 9).cast("int"))


@dataclass(frozen=True)
class Assembled(Recipe):
    """The three price parts from different predictions; the total is their sum."""

    energy: Recipe
    loss: Recipe
    congestion: Recipe

    def made_of(self, source: Source) -> DataFrame:
        parts = {f.name: getattr(self, f.name).frame(source) for f in fields(self)}
        return P.assemble(parts, {n: n for n in parts})


@dataclass(frozen=True)
class SpikeMixed(Recipe):
    base: Recipe
    spike: Recipe

    def made_of(self, source: Source) -> DataFrame:
        return P.spike_mixture(self.base.frame(source), self.spike.frame(source))


@dataclass(frozen=True)
class OfWindows(Recipe):
    """The mean of stored variants by training window."""

    of: Recipe
    windows: tuple[str, ...]

    def made_of(self, source: Source) -> DataFrame:
        return P.select_windows(self.of.frame(source), list(self.windows))


@dataclass(frozen=True)
class Clipped(Recipe):
    """Bounded by the history before each fold."""

    of: Recipe

    def made_of(self, source: Source) -> DataFrame:
        return P.clip_to_history(self.of.frame(source), source.panel, source.folds)


@dataclass(frozen=True)
class Residual(Recipe):
    """Quantiles from earlier out-of-sample errors."""

    of: Recipe

    def made_of(self, source: Source) -> DataFrame:
        return oos_quantiles(self.of.frame(source), source.folds)


@dataclass(frozen=True)
class Adaptive(Recipe):
    """Quantiles by adaptive conformal calibration; options are those of `postprocess.calibrate_aci`."""

    of: Recipe
    options: tuple[tuple[str, float], ...] = ()

    def made_of(self, source: Source) -> DataFrame:
        return P.calibrate_aci(self.of.frame(source), **dict(self.options))


#: The daily signal: equal weights of clipped LASSO fits and boosted trees, clipped and calibrated.
SIGNAL = "combo3_eq_aci"
SIGNAL_RECIPE = Adaptive(Clipped(Combined((Stored("lear_clip"), Stored("gbm_l1")))))
#: Its first part, as a run of its own.
LEAR_CLIP = Residual(Clipped(Stored("lear")))
MONTHLY_CHOICE = {"total": "m5_norm", "congestion": "m5_norm"}


def run_recipe(registry: Registry, name: str, recipe: Recipe, source: Source) -> str:
    """Logged run of a recipe: its predictions, the scores of each fold, the weights of its combinations, and the run row with the recipe as data."""
    folds = source.folds
    config = {"recipe": recipe.description(), "parents": recipe.names(), "folds": len(folds), "first_fold": folds[0].name, "last_fold": folds[-1].name}
    with registry.running(name, config) as run_id:
        pred = P.assign_test_fold(cut_lineage(recipe.frame(source)).drop("fold"), folds).drop("train_end")
        pred = cut_lineage(pred)
        registry.save_predictions(run_id, pred)
        registry.save_scores(run_id, fold_scores(pred))
        for i, part in enumerate(p for p in walk(recipe) if isinstance(p, Combined) and p.weights == "inv_mae"):
            registry.save_artifact(run_id, f"weights_{i}", part.fold_weights(source))
    return run_id


def continue_over_holdout(registry: Registry, name: str, recipe: Recipe, models: dict[str, Model], panel: DataFrame, validation: list[Fold], holdout: list[Fold],
                          reference: DataFrame | None = None, benchmarks: tuple[Model, ...] = (), quantiles: str = "oos_residual") -> dict[str, str]:
    """The one evaluation on the locked span: {what: run id}.

    Each stored part of the recipe keeps its latest finished validation run and is refitted on the holdout months alone (logged as <part>_holdout); the
    recipe then runs over both spans, so that calibration and weights go on from the validation months without a break (logged as <name>_holdout);
    benchmarks run on the holdout months.  The panel has to hold the days of both spans."""
    for f in holdout:
        guard(f.test_start)
    parts, tests = recipe.names(), [f.name for f in validation + holdout]
    lineage = {r["model"]: r["run_id"] for r in registry.latest_runs(parts).collect()}
    for part in parts:
        if part not in lineage:
            raise ValueError(f"{part} has no finished validation run")
    again = [copy(models[part]) for part in parts]
    for part, model in zip(parts, again, strict=True):
        model.name = f"{part}_holdout"
    lineage |= zip([m.name for m in again], run_all(registry, again, panel, holdout, reference, quantiles), strict=True)
    stored = {part: registry.predictions(lineage[part], lineage[f"{part}_holdout"]).where(F.col("fold").isin(tests)).drop("run_id", "fold") for part in parts}
    lineage[f"{name}_holdout"] = run_recipe(registry, f"{name}_holdout", recipe, Source(stored, panel, validation + holdout))
    for b in benchmarks:
        b = copy(b)
        b.name = f"{b.name}_holdout"
        lineage[b.name] = run(registry, b, panel, holdout, reference)
    return lineage


def walk(recipe: Recipe) -> Iterator[Recipe]:
    yield recipe
    for part in recipe.inputs():
        yield from walk(part)
