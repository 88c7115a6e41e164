"""Batch scoring: fold models, text blend, calibration, shrinkage, fallback, output order."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.scalars import blend_logit, num, shrink
from ..operators.ordered import aggregate, small_side
from ..operators.quality import prediction_sink
from .learning import FoldModels, with_calibration


def score_new(models: FoldModels, required: DataFrame, rows: DataFrame, fallback: float = 0.5, **settings) -> DataFrame:
    """Final probabilities of new rows from saved fold models.

    Each fold model reads its own objective map; their predictions go through ``score_batch``, and a
    response without features takes its objective's mean encoding over the fold models.
    """
    priors = models.priors
    if priors is None:
        priors = rows.sparkSession.createDataFrame([], "objective_id string, encoding double")
    means = aggregate(priors, ["objective_id"], "avg(encoding) AS encoding")
    return score_batch(required, models.score(rows), rows, means, fallback=fallback, **settings)


def score_batch(
    required: DataFrame,
    fold_predictions: DataFrame,
    objectives: DataFrame,
    priors: DataFrame,
    text: DataFrame | None = None,
    text_weight: float = 0.0,
    calibrator: dict | None = None,
    shrinkage: tuple[float, float] | None = None,
    fallback: float = 0.5,
) -> DataFrame:
    """Final probabilities in the required order.

    ``fold_predictions(response_id, pred)`` holds one row per fold model; the mean is
    blended with ``text(response_id, text_pred)`` in logit space, calibrated and shrunk.
    Responses without a usable prediction take their objective's prior
    (``priors(objective_id, encoding)``) or the fallback rate.
    """
    mean = aggregate(fold_predictions, ["response_id"], "avg(pred) AS pred")
    rows = objectives.select("response_id", "objective_id").join(mean, "response_id", "left")
    p = "pred"
    if text is not None:
        rows = rows.join(text.select("response_id", "text_pred"), "response_id", "left")
        p = blend_logit(["pred", "text_pred"], [num(1.0 - text_weight), num(text_weight)])
    rows = with_calibration(
        rows.selectExpr("response_id", "objective_id", f"{p} AS blended"), calibrator or {"method": "none"}, "blended", "_final")
    final = "_final"
    if shrinkage is not None:
        weight, base = shrinkage
        final = shrink(final, num(weight), num(base))
    usable = "blended IS NOT NULL AND NOT isnan(blended)"
    known = small_side(priors.selectExpr("objective_id", "encoding AS _prior"))
    filled = rows.join(known, "objective_id", "left").selectExpr(
        "response_id", f"CASE WHEN {usable} THEN {final} ELSE coalesce(_prior, {num(fallback)}) END AS probability"
    )
    return prediction_sink(required, filled, fallback)
