"""Pareto tails and logistic fits by merged sums, against fits of each group alone."""

import numpy as np
import pytest

from wattline.operators import kernels, logistic
from wattline.operators.tails import gpd_fits


def test_tails_equal_fits_of_each_group(spark):
    rng, rows = np.random.default_rng(4), []
    for fold, zone, xi, sigma, n in (("a", "x", 0.25, 3.0, 900), ("a", "y", -0.2, 1.0, 400), ("a", None, 0.0, 2.0, 1500), ("b", "x", 0.4, 10.0, 60), ("b", "one", 0.1, 1.0, 1), ("b", "none", 0.1, 1.0, 1)):
        u = rng.random(n)
        e = sigma / xi * ((1 - u) ** -xi - 1) if xi else -sigma * np.log(1 - u)
        rows += [(fold, zone, float(v)) for v in (-e if zone == "none" else e)]
    df = spark.createDataFrame(rows, "fold string, zone string, e double").repartition(7)
    got = {(r["fold"], r["zone"]): (r["xi"], r["sigma"], r["n"]) for r in gpd_fits(df, ["fold", "zone"], "e").collect()}
    for key in {(f, z) for f, z, _ in rows}:
        e = np.array([v for f, z, v in rows if (f, z) == key])
        xi, sigma = kernels.gpd_fit(e)
        assert got[key] == (pytest.approx(xi, abs=1e-7), pytest.approx(sigma, rel=1e-7), (e > 0).sum())


def test_logistic_fits_are_at_their_optimum(spark):
    rng, rows = np.random.default_rng(6), []
    for fold in ("a", "b"):
        x = rng.normal(size=(400, 4))
        y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(float)
        rows += [(fold, int(i // 100), [None if v > 2.2 else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "fold string, slot int, x array<double>, y double").repartition(5)
    fits = [logistic.Logit(g, k, w) for g in ("a", "b") for k, w in ((4, 1.0), (4, 60.0), (2, 5.0))] + [logistic.Logit("none", 4, 1.0)]
    beta = logistic.fit_logits(df, fits, 4)
    assert not beta[-1].any()
    for f, b in zip(fits[:-1], beta[:-1], strict=True):
        own = [(r, t) for g, s, r, t in rows if g == f.group and s < f.below]
        x = np.array([[1.0, *[0.0 if v is None else v for v in r]] for r, _ in own])
        grad = x.T @ (1 / (1 + np.exp(-(x @ b))) - np.array([t for _, t in own]))
        assert abs(grad[0]) < 1e-3
        for j in range(1, 5):                               # zero slopes: gradient within the penalty; others: gradient equals it
            assert abs(grad[j]) <= f.weight + 1e-3 if b[j] == 0 else grad[j] + f.weight * np.sign(b[j]) == pytest.approx(0, abs=1e-3)
    assert (beta[1][1:] == 0).sum() >= 1
    loss = logistic.next_slot_loss(df, fits, beta, 4)
    x = np.array([[1.0, *[0.0 if v is None else v for v in r]] for g, s, r, _ in rows if g == "a" and s == 2])
    y = np.array([t for g, s, _, t in rows if g == "a" and s == 2])
    p = np.clip(1 / (1 + np.exp(-(x @ beta[2]))), 1e-4, 1 - 1e-4)
    assert loss[2] == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))) and np.isnan(loss[0])
