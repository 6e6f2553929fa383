"""Recipes as expressions, their logged runs and the continuation over the holdout."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.models.naive import NaiveModel
from wattline.plans import backtest, recipes
from wattline.plans.folds import Fold
from wattline.plans.postprocess import mixed_quantiles
from wattline.plans.registry import Registry
from wattline.settings import PRED_KEYS, QCOLS, QUANTILES
from tests.test_models import panel  # noqa: F401

DAYS = [date(2024, 8, 1) + timedelta(days=2 * i) for i in range(5)]
FOLDS = [Fold(f"f{i}", date(2024, 5, 1), a - timedelta(days=2), a, b) for i, (a, b) in enumerate(zip(DAYS, DAYS[1:], strict=False))]


def test_mixture_equals_a_row_by_row_one():
    rng = np.random.default_rng(2)
    base, spike = (np.sort(rng.normal(m, 10, (50, len(QUANTILES))), axis=1) for m in (30, 200))
    p, levels, points = rng.random(50), np.asarray(QUANTILES), 40
    u = (np.arange(points) + 0.5) / points
    want = []
    for b, s, w in zip(base, spike, p, strict=True):
        pairs = sorted([(v, (1 - w) / points) for v in np.interp(u, levels, b)] + [(v, w / points) for v in np.interp(u, levels, s)])
        reach = np.cumsum([m for _, m in pairs])
        want.append([pairs[min(int((reach < q).sum()), 2 * points - 1)][0] for q in levels])
    assert np.allclose(mixed_quantiles(base, spike, p, points), want)


def test_recipes_are_data_and_share_their_parts(spark):
    a, b = recipes.Stored("a"), recipes.Stored("b")
    twice = recipes.Combined((recipes.Clipped(a), b, recipes.Clipped(a)), "median")
    assert twice.names() == ["a", "b"] and [type(p).__name__ for p in recipes.walk(twice)] == ["Combined", "Clipped", "Stored", "Stored", "Clipped", "Stored"]
    assert recipes.Clipped(a) == recipes.Clipped(recipes.Stored("a")) and twice.description()["weights"] == "median"
    with pytest.raises(ValueError, match="no stored predictions a"):
        a.frame(recipes.Source({}, None, []))


def test_logged_recipe_and_holdout_chain(spark, panel, tmp_path):  # noqa: F811
    reg = Registry(spark, str(tmp_path / "r"))
    models = {"one": NaiveModel("persist_da_d1"), "two": NaiveModel("lago_naive")}
    for name, m in models.items():
        m.name = name
        backtest.run(reg, m, panel, FOLDS[:2], quantiles="oos_residual")
    recipe = recipes.Adaptive(recipes.Clipped(recipes.Combined((recipes.Stored("one"), recipes.Stored("two")), "inv_mae")), (("window_days", 50), ("min_obs", 2)))
    lineage = recipes.continue_over_holdout(reg, "mix", recipe, models, panel, FOLDS[:2], FOLDS[2:], benchmarks=(models["two"],))
    assert set(lineage) == {"one", "two", "one_holdout", "two_holdout", "mix_holdout"}
    chained = reg.predictions(lineage["mix_holdout"])
    # the same recipe over parts that ran over all folds without a break
    whole = {n: backtest.run_folds(m, panel, FOLDS) for n, m in models.items()}
    straight = recipe.frame(recipes.Source(whole, panel, FOLDS))
    cols = [*PRED_KEYS, *[F.round(c, 6).alias(c) for c in ("mean", *QCOLS)]]
    assert chained.count() == straight.count() > 0 and chained.select(cols).exceptAll(straight.select(cols)).count() == 0
    assert chained.where("q50 IS NOT NULL").count() > 0
    scores = reg.scores().where(F.col("run_id") == lineage["mix_holdout"])
    assert {r["fold"] for r in scores.select("fold").distinct().collect()} == {f.name for f in FOLDS}
    weights = reg.artifact(lineage["mix_holdout"], "weights_0")
    assert {r["part"] for r in weights.select("part").distinct().collect()} == {0, 1}
    logged = reg.runs().where(F.col("run_id") == lineage["mix_holdout"]).first()
    assert logged["status"] == "done" and '"inv_mae"' in logged["config_json"]
    with pytest.raises(ValueError, match="no finished validation run"):
        recipes.continue_over_holdout(reg, "x", recipes.Stored("three"), {"three": models["one"]}, panel, FOLDS[:1], FOLDS[1:])
