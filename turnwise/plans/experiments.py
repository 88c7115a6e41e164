"""Reports over many experiments at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.scalars import log_loss, num
from ..operators.blend import optimal_blend
from ..operators.compare import projected_loss
from ..operators.joins import require_same_cohort
from ..operators.metrics import within_fold_auc
from ..operators.ordered import aggregate
from ..operators.stats import auc
from ..session import cut


def score_experiments(oof: DataFrame, folds: DataFrame, modes: DataFrame, c: float, k: float,
                      required: float = 0.99) -> DataFrame:
    """Rank every experiment by its mean AUC inside objective folds.

    ``oof(experiment, response_id, label, pred)`` is one long table, so all experiments are
    scored by the same grouped job; ``modes(experiment, split_mode)`` says how each was
    trained.  Experiments with too little fold coverage are left out.
    """
    sizes = aggregate(oof, ["experiment"], "count(1) AS n_all")
    merged = cut(oof.join(folds.select("response_id", "fold"), "response_id"))
    losses = aggregate(
        merged, ["experiment"], "count(1) AS n", f"avg({log_loss('label', 'pred')}) AS logloss"
    )
    ranked = (
        within_fold_auc(merged, ["experiment"]).join(losses, "experiment").join(sizes, "experiment")
        .join(modes, "experiment", "left")
        .where(f"n / n_all >= {required}")
    )
    return ranked.selectExpr(
        "*", f"{projected_loss('mean_auc', c, k)} AS projected",
        "CASE WHEN split_mode = 'objective' THEN 'honest' ELSE 'optimistic' END AS evidence",
        "rank() OVER (ORDER BY mean_auc DESC) AS place",
    )


def holdout_report(folds: DataFrame, rates: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Model against the fold's own training rate, per held-out fold."""
    scored = folds.join(rates.selectExpr("train_fold AS fold", "rate"), "fold")
    model, prior = (f"avg({log_loss(label, p)})" for p in (pred, "rate"))
    return aggregate(
        scored, ["fold"], "count(1) AS n", f"{model} AS model_logloss", f"{prior} AS prior_logloss",
        f"{model} < {prior} AS won",
    ).join(auc(folds, ["fold"], label, pred).selectExpr("fold", "auc AS model_auc"), "fold")


def blend_report(frames: dict[str, DataFrame], modes: dict[str, str], verify: bool = True) -> DataFrame:
    """Best logit blend of aligned prediction tables, with training provenance.

    ``optimality_gap`` bounds how far the loss is above the least one.  Cohorts are checked first; experiments trained under different split regimes are
    allowed but the result is marked ``mixed``.
    """
    names = list(frames)
    first = frames[names[0]]
    if verify:
        for other in names[1:]:
            require_same_cohort(first, frames[other])
    joined = first.selectExpr("response_id", "label", f"pred AS p_{names[0]}")
    for other in names[1:]:
        joined = joined.join(frames[other].selectExpr("response_id", f"pred AS p_{other}"), "response_id")
    preds = [f"p_{n}" for n in names]
    joined = cut(joined)
    alone = aggregate(
        joined, [], "count(1) AS n_common",
        *[f"avg({log_loss('label', p)}) AS logloss_{n}" for n, p in zip(names, preds)],
    )
    best = optimal_blend(joined, preds)
    regimes = set(modes.values())
    return alone.selectExpr(
        "n_common", *[f"{num(w)} AS weight_{n}" for n, w in zip(names, best.weights)], f"{num(best.logloss)} AS logloss",
        f"{num(best.gap)} AS optimality_gap", *[f"logloss_{n}" for n in names],
        f"'{regimes.pop() if len(regimes) == 1 else 'mixed'}' AS split_mode",
        f"{str(len(set(modes.values())) == 1).lower()} AS regime_consistent",
    )
