"""Shrinkage and blend weights.

Grids are aggregates of one pass, so rows are never multiplied by the grid; weights of several models
are the minimum of a convex loss and come from Newton steps on the simplex, one aggregate a step.
"""

from __future__ import annotations

from collections.abc import Sequence as Seq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ..functions.scalars import blend_logit, log_loss, logit, num, shrink
from .ordered import aggregate

SHRINK_GRID = tuple(round(0.05 * i, 2) for i in range(1, 21))  # fixed values 0.05 .. 1.00
PROMOTE_GRID = tuple(round(0.05 * i, 2) for i in range(11))  # fixed values 0 .. 0.5


def unpivot_losses(wide: DataFrame, keys: Seq[str], labels: Seq[str], kinds: str) -> DataFrame:
    pairs = ", ".join(f"{label}, l{i}" for i, label in enumerate(labels))
    return wide.selectExpr(*keys, f"stack({len(labels)}, {pairs}) AS ({kinds}, logloss)")


def shrinkage_losses(df: DataFrame, keys: Seq[str] = (), label: str = "label", pred: str = "pred",
                     base: str = "base_rate", grid: Seq[float] = SHRINK_GRID) -> DataFrame:
    """Log loss for every shrinkage weight; ``base`` is a column (it may differ by draw)."""
    wide = aggregate(
        df, keys, *[f"avg({log_loss(label, shrink(pred, num(w), base))}) AS l{i}" for i, w in enumerate(grid)]
    )
    return unpivot_losses(wide, keys, [num(w) for w in grid], "weight")


def best_weight(losses: DataFrame, keys: Seq[str] = ()) -> DataFrame:
    """The weight with the least loss, ties to the smaller weight."""
    return aggregate(
        losses, keys, "min_by(weight, struct(logloss, weight)) AS weight", "min(logloss) AS logloss"
    )


def crossfit_shrinkage(draws: DataFrame, grid: Seq[float] = SHRINK_GRID) -> DataFrame:
    """Weight per evaluation draw, fitted on the other draws without the shared responses.

    ``draws(draw, response_id, label, pred, base_rate)``.  Each row lists the draws its
    response is in (a set as small as the number of draws) and is used for the others.
    """
    member = aggregate(draws, ["response_id"], "collect_set(draw) AS inside")
    every = aggregate(draws.select("draw").distinct(), [], "collect_set(draw) AS draws").scalar()
    fit = draws.join(member, "response_id").withColumn("_all", every).selectExpr(
        "explode(array_except(_all, inside)) AS eval_draw", "label", "pred", "base_rate"
    )
    return best_weight(shrinkage_losses(fit, ["eval_draw"], grid=grid), ["eval_draw"])


def simplex(models: int, steps: int) -> list[tuple[float, ...]]:
    """All weight vectors with entries ``i / steps`` that sum to one."""
    if models == 1:
        return [(1.0,)]
    def grow(left: int, parts: int):
        if parts == 1:
            return [(left,)]
        return [(i, *rest) for i in range(left + 1) for rest in grow(left - i, parts - 1)]
    return [tuple(i / steps for i in point) for point in grow(steps, models)]


def blend_losses(df: DataFrame, preds: Seq[str], points: Seq[Seq[float]], keys: Seq[str] = (),
                 label: str = "label") -> DataFrame:
    """Log loss of the logit blend at every weight vector: ``weights array, logloss``."""
    wide = aggregate(
        df, keys,
        *[
            f"avg({log_loss(label, blend_logit(preds, [num(w) for w in point]))}) AS l{i}"
            for i, point in enumerate(points)
        ],
    )
    arrays = ["array(" + ", ".join(num(w) for w in point) + ")" for point in points]
    return unpivot_losses(wide, keys, arrays, "weights")


def best_blend(losses: DataFrame, keys: Seq[str] = ()) -> DataFrame:
    return aggregate(
        losses, keys, "min_by(weights, struct(logloss, weights)) AS weights", "min(logloss) AS logloss"
    )


def on_simplex(point: np.ndarray) -> np.ndarray:
    """The nearest point with entries of zero or more that sum to one."""
    ordered = np.sort(point)[::-1]
    excess = (np.cumsum(ordered) - 1.0) / np.arange(1, len(point) + 1)
    return np.maximum(point - excess[np.flatnonzero(ordered > excess)[-1]], 0.0)


def _newton_point(at: np.ndarray, slope: np.ndarray, curve: np.ndarray, steps: int = 2000) -> np.ndarray:
    """Minimum over the simplex of the quadratic model around ``at``, by accelerated projection."""
    rate = 1.0 / max(float(np.linalg.eigvalsh(curve)[-1]), 1e-12)
    here = ahead = at
    age = 1.0
    for _ in range(steps):
        older, age = age, (1.0 + (1.0 + 4.0 * age * age) ** 0.5) / 2.0
        last, here = here, on_simplex(ahead - rate * (slope + curve @ (ahead - at)))
        if (ahead - here) @ (here - last) > 0:
            age = 1.0
        ahead = here + (older - 1.0) / age * (here - last)
        if np.abs(here - last).max() < 1e-14:
            break
    return here


@dataclass(frozen=True)
class Blend:
    """Simplex weights, their mean log loss, and a bound on how far that is above the least one."""

    weights: tuple[float, ...]
    logloss: float
    gap: float


def optimal_blend(df: DataFrame, preds: Seq[str], label: str = "label", steps: int = 30, tolerance: float = 1e-10) -> Blend:
    """Simplex weights of least log loss of the logit blend.

    The loss is convex in the weights.  A step is one aggregate (loss, gradient, Hessian) and the
    minimum over the simplex of the quadratic they define; a step that raises the loss is halved.  It
    ends when ``gradient . weights - min(gradient)``, which bounds the distance from the optimum, is
    below ``tolerance`` and the weights stand still.  Rows with a null prediction keep the first one.
    """
    m = len(preds)
    z = [f"z{i}" for i in range(m)]
    known = " AND ".join(f"{p} IS NOT NULL" for p in preds)
    rows = df.selectExpr(f"CAST({label} AS DOUBLE) AS y", f"{log_loss(label, preds[0])} AS first", f"{known} AS known",
                         *[f"{logit(p)} AS {n}" for p, n in zip(preds, z)])
    at = base = np.full(m, 1.0 / m)
    best = Blend(tuple(at), float("inf"), float("inf"))
    for _ in range(steps):
        total = "(" + " + ".join(f"{num(w)} * {n}" for w, n in zip(at, z)) + ")"
        q = f"(1D / (1D + exp(-{total})))"
        on = lambda e: f"sum(CASE WHEN known THEN {e} ELSE 0D END)"
        loss = f"sum(CASE WHEN known THEN greatest({total}, 0D) + log1p(exp(-abs({total}))) - y * {total} ELSE first END)"
        row = aggregate(rows, [], "count(1) AS n", f"{loss} AS l", *[f"{on(f'({q} - y) * {a}')} AS g{i}" for i, a in enumerate(z)],
                        *[f"{on(f'{q} * (1D - {q}) * {z[i]} * {z[j]}')} AS h{i}_{j}" for i in range(m) for j in range(i + 1)]).first()
        if not row["n"]:
            return best
        value = row["l"] / row["n"]
        if value > best.logloss + 1e-15:
            at = (base + at) / 2
            continue
        slope = np.array([row[f"g{i}"] for i in range(m)]) / row["n"]
        curve = np.array([[row[f"h{max(i, j)}_{min(i, j)}"] for j in range(m)] for i in range(m)]) / row["n"]
        best = Blend(tuple(float(w) for w in at), value, float(max(0.0, slope @ at - slope.min())))
        base, at = at, _newton_point(at, slope, curve)
        if best.gap <= tolerance and np.abs(at - base).max() <= 1e-9:
            break
    return best


def fold_weights(df: DataFrame, base: str, text: str, grid: Seq[float] = PROMOTE_GRID,
                 label: str = "label") -> DataFrame:
    """Per fold, the text weight with least loss on the *other* folds.

    Losses are summed per fold once; the training loss of a fold is the total minus its own.
    """
    losses = [
        f"sum({log_loss(label, blend_logit([base, text], [num(1.0 - w), num(w)]))}) AS l{i}"
        for i, w in enumerate(grid)
    ]
    wide = aggregate(df, ["fold"], *losses, "count(1) AS n")
    rest = wide.selectExpr(
        "fold", *[f"(sum(l{i}) OVER () - l{i}) / (sum(n) OVER () - n) AS l{i}" for i in range(len(grid))]
    )
    return best_weight(unpivot_losses(rest, ["fold"], [num(w) for w in grid], "weight"), ["fold"])


def promotion_gate(df: DataFrame, base: str, text: str, text_auc: DataFrame, least_gain: float = 3e-4,
                   label: str = "label") -> DataFrame:
    """Promote the blend only if fold-held-out weights beat the base by ``least_gain``."""
    weights = fold_weights(df, base, text, label=label)
    held = df.join(weights.select("fold", "weight"), "fold")
    honest = blend_logit([base, text], ["1D - weight", "weight"])
    scored = aggregate(
        held, [], f"avg({log_loss(label, base)}) AS base_logloss",
        f"avg({log_loss(label, honest)}) AS honest_logloss",
    )
    middle = aggregate(weights, [], "percentile(weight, 0.5) AS w").scalar()
    return (
        scored.withColumn("_w", middle)
        .withColumn("text_auc", text_auc.select("auc").scalar())
        .selectExpr("*", f"honest_logloss <= base_logloss - {num(least_gain)} AND text_auc > 0.5D AS promoted")
        .selectExpr(
            "base_logloss", "honest_logloss", "base_logloss - honest_logloss AS honest_gain", "text_auc",
            "promoted", "CASE WHEN promoted THEN _w ELSE 0D END AS deployment_weight",
        )
    )
