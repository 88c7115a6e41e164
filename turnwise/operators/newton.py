"""Logistic models with few features, all runs of a report fitted together.

A run is a predicate on the rows (the rows that train it).  Each step is one aggregate over the rows: it
sums loss, gradient and Hessian of every run at that run's own coefficients, and the small systems are
solved from the one row that comes back.  So a step costs one pass for any number of runs.
"""

from __future__ import annotations

from collections.abc import Mapping
from collections.abc import Sequence as Seq

import numpy as np
from pyspark.sql import DataFrame

from ..functions.scalars import num
from .ordered import aggregate

RIDGE = 1e-6  # keeps coefficients finite where the classes are separable


def linear(features: Seq[str], coefficients: Seq[float]) -> str:
    """The linear predictor as SQL; the intercept comes last."""
    terms = [f"{num(c)} * ({f})" for f, c in zip(features, coefficients)]
    return " + ".join([*terms, num(coefficients[-1])])


def _sums(runs: Mapping[str, str], at: Mapping[str, np.ndarray], features: Seq[str], label: str, weight: str) -> list[str]:
    parts = []
    inputs = [*[f"CAST({f} AS DOUBLE)" for f in features], "1D"]
    for i, (name, where) in enumerate(runs.items()):
        z = f"({linear(features, at[name])})"
        p = f"(1D / (1D + exp(-{z})))"
        on = lambda e: f"sum(CASE WHEN {where} THEN {weight} * ({e}) END)"  # noqa: E731, B023
        parts.append(f"{on(f'greatest({z}, 0D) + log1p(exp(-abs({z}))) - {label} * {z}')} AS l{i}")
        parts += [f"{on(f'({p} - {label}) * {x}')} AS g{i}_{j}" for j, x in enumerate(inputs)]
        parts += [f"{on(f'{p} * (1D - {p}) * {x} * {inputs[k]}')} AS h{i}_{j}_{k}"
                  for j, x in enumerate(inputs) for k in range(j + 1)]
    return parts


def fit_logistic(rows: DataFrame, runs: Mapping[str, str], features: Seq[str], label: str = "label",
                 weight: str = "1D", ridge: float = RIDGE, steps: int = 25,
                 tolerance: float = 1e-9) -> dict[str, np.ndarray]:
    """Coefficients of each run, the intercept last.

    Minimises the weighted log loss plus ``ridge / 2`` times the squared slopes.  A step that raises a
    run's loss is halved.  Labels may be fractions; a run without rows keeps zeros.  At most ``steps``
    passes, fewer once no run moves by more than ``tolerance``.
    """
    size = len(features) + 1
    at = {name: np.zeros(size) for name in runs}
    base, loss, moving = dict(at), dict.fromkeys(runs, np.inf), set(runs)
    penalty = np.array([ridge] * len(features) + [0.0])
    for _ in range(steps):
        open_runs = {name: runs[name] for name in runs if name in moving}
        if not open_runs:
            break
        row = aggregate(rows, [], *_sums(open_runs, at, features, label, weight)).first()
        for i, name in enumerate(open_runs):
            if row[f"l{i}"] is None:
                moving.discard(name)
                continue
            here = row[f"l{i}"] + 0.5 * float(penalty @ at[name] ** 2)
            if here > loss[name] + 1e-12 * abs(here):
                at[name] = (base[name] + at[name]) / 2
                continue
            gradient = np.array([row[f"g{i}_{j}"] for j in range(size)]) + penalty * at[name]
            hessian = np.diag(penalty + 1e-12)
            for j in range(size):
                for k in range(j + 1):
                    hessian[j, k] += row[f"h{i}_{j}_{k}"]
                    hessian[k, j] = hessian[j, k]
            step = np.linalg.solve(hessian, gradient)
            base[name], loss[name] = at[name], here
            at[name] = at[name] - step
            if np.abs(step).max() <= tolerance:
                moving.discard(name)
    return at
