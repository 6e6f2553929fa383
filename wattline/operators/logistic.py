"""L1-penalised logistic regressions of many fits at once: a pass over the rows sums the loss, gradient and Hessian of every fit, the driver solves the small quadratic
problems.  Newton steps with soft thresholds, halved where the penalised loss grew; a handful of passes serve all folds, penalties and training spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSES, DONE = 60, 1e-6


class Logit(NamedTuple):
    """Learned from the rows of a group with slot < below; weight: of the L1 norm of the slopes beside the summed loss (the intercept is free)."""

    group: str
    below: int
    weight: float


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column with an intercept before them; NULL is 0."""
    flat = column.flatten()
    x = np.nan_to_num(flat.to_numpy(zero_copy_only=False).astype(float)).reshape(-1, width)
    return np.concatenate((np.ones((len(x), 1)), x), axis=1)


def _summed(rows: DataFrame, task, size: int) -> dict[int, np.ndarray]:
    """Arrays of `size` numbers that tasks emit by fit, added up by Spark's second stage; a fit's array is all that reaches the driver."""
    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in it:
            for k, raw in zip(b.column("fit").to_pylist(), b.column("sums").to_pylist(), strict=True):
                v = np.frombuffer(raw, float)
                total[k] = total[k] + v if k in total else v.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["fit", "sums"])

    parts = rows.mapInArrow(task, "fit int, sums binary").repartition("fit").mapInArrow(add, "fit int, sums binary")
    return {r["fit"]: np.frombuffer(bytes(r["sums"]), float).reshape(size) for r in parts.collect()}


def _over(rows_of, fits: list[Logit], beta: np.ndarray, width: int, what):
    """A task that adds up what(x, y, beta) for each fit over the rows that rows_of(fit, slot) picks."""
    by_group: dict[str, list[int]] = {}
    for k, f in enumerate(fits):
        by_group.setdefault(f.group, []).append(k)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in it:
            x, y, slot, group = _matrix(b.column("x"), width), b.column("y").to_numpy(), b.column("slot").to_numpy(), np.array(b.column("fold").to_pylist(), object)
            for g in dict.fromkeys(group):
                own = group == g
                for k in by_group.get(g, ()):
                    at = own & rows_of(fits[k], slot)
                    if at.any():
                        v = what(x[at], y[at], beta[k])
                        total[k] = total[k] + v if k in total else v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["fit", "sums"])

    return run


def _second_order(x: np.ndarray, y: np.ndarray, beta: np.ndarray) -> np.ndarray:
    z = x @ beta
    p = 1 / (1 + np.exp(-z))
    loss = np.logaddexp(0, z) - y * z
    return np.concatenate(([loss.sum()], x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()))


def _solved(beta: np.ndarray, grad: np.ndarray, hess: np.ndarray, weight: float) -> np.ndarray:
    """Minimum of the quadratic model plus the L1 term, by coordinate descent."""
    hess = hess + 1e-9 * np.eye(len(beta))
    new = beta.copy()
    pull = hess @ beta - grad
    for _ in range(500):
        before = new.copy()
        for j in range(len(new)):
            r = pull[j] - hess[j] @ new + hess[j, j] * new[j]
            new[j] = r / hess[j, j] if j == 0 else np.sign(r) * max(abs(r) - weight, 0.0) / hess[j, j]
        if np.abs(new - before).max() < 1e-9:
            break
    return new


def fit_logits(rows: DataFrame, fits: list[Logit], width: int) -> np.ndarray:
    """Coefficients (intercept first), one row for each fit, from rows(fold, slot, x array<double>, y double).  Fits without rows stay zero."""
    n = width + 1
    beta, last = np.zeros((len(fits), n)), np.zeros((len(fits), n))
    best, moving = np.full(len(fits), np.inf), np.ones(len(fits), bool)
    inside = lambda f, slot: slot < f.below                                              # noqa: E731
    for _ in range(PASSES):
        live = np.flatnonzero(moving)
        if not len(live):
            return beta
        sums = _summed(rows, _over(inside, [fits[k] for k in live], beta[live], width, _second_order), 1 + n + n * n)
        for i, k in enumerate(live):
            v = sums.get(i)
            if v is None:
                moving[k] = False
                continue
            total = v[0] + fits[k].weight * np.abs(beta[k, 1:]).sum()
            if total > best[k] + 1e-10 * abs(best[k]):                                   # went too far
                beta[k] = (beta[k] + last[k]) / 2
                moving[k] = np.abs(beta[k] - last[k]).max() > DONE
                continue
            best[k], last[k] = total, beta[k].copy()
            beta[k] = _solved(beta[k], v[1:1 + n], v[1 + n:].reshape(n, n), fits[k].weight)
            moving[k] = np.abs(beta[k] - last[k]).max() > DONE * max(1.0, np.abs(beta[k]).max())
    raise RuntimeError(f"{int(moving.sum())} logistic fits did not settle in {PASSES} passes")


def next_slot_loss(rows: DataFrame, fits: list[Logit], beta: np.ndarray, width: int) -> np.ndarray:
    """Mean log loss of each fit on the slot after those it learned from; NaN without rows."""
    def what(x: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
        p = np.clip(1 / (1 + np.exp(-(x @ b))), 1e-4, 1 - 1e-4)         # as scoring.log_loss
        return np.array([-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum(), float(len(y))])

    sums = _summed(rows, _over(lambda f, slot: slot == f.below, fits, beta, width, what), 2)
    return np.array([sums[k][0] / sums[k][1] if k in sums else np.nan for k in range(len(fits))])
