"""Scores of predictions: losses, ranking, calibration, slices."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import DataFrame

from ..functions.scalars import clip_probability, log_loss, num
from .ordered import aggregate
from .stats import CELLS, auc, auc_of_counts, histogram, quantile, ranked, score_counts

MIN_FOLD_ROWS = 200  # fixed value: smallest fold whose AUC is reported


def scores(df: DataFrame, keys: Seq[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """Rows, log loss, AUC and positive rate per group, all from the counts of its distinct scores."""
    counts = score_counts(df, keys, label, pred)
    losses = aggregate(
        counts, keys, "sum(n) AS n",
        f"sum(n_y * {log_loss('(pos / nullif(n_y, 0))', 'value')}) / sum(CASE WHEN value IS NOT NULL THEN n_y END) AS logloss",
        "sum(pos) / sum(n_y) AS pos_rate")
    ranking = auc_of_counts(counts, keys).drop("n_pos", "n_neg")
    if not keys:
        return losses.withColumn("auc", ranking.select("auc").scalar())
    return losses.join(ranking, list(keys))


def within_fold_auc(df: DataFrame, keys: Seq[str] = (), fold: str = "fold", label: str = "label",
                    pred: str = "pred", least: int = MIN_FOLD_ROWS) -> DataFrame:
    """AUC inside each fold, averaged; small or one-class folds are skipped and counted."""
    per_fold = auc(df, [*keys, fold], label, pred)
    usable = f"(n_pos + n_neg >= {least} AND auc IS NOT NULL)"
    return aggregate(
        per_fold, keys,
        f"avg(CASE WHEN {usable} THEN auc END) AS mean_auc",
        f"stddev_pop(CASE WHEN {usable} THEN auc END) AS sd_auc",
        f"count_if({usable}) AS n_folds",
        f"count_if(NOT {usable}) AS n_skipped",
    )


def fold_constant_auc(df: DataFrame, fold: str = "fold", label: str = "label") -> DataFrame:
    """Pooled AUC of predicting each fold's own rate: ranking made of fold differences only.

    The rate is constant in a fold, so the ranking needs one row per fold.
    """
    rates = aggregate(df, [fold], f"avg({label}) AS rate", f"sum({label}) AS p", f"sum(1 - {label}) AS q")
    per_rate = aggregate(rates, ["rate"], "sum(p) AS p", "sum(q) AS q")
    below = "coalesce(sum(q) OVER (ORDER BY rate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return aggregate(
        per_rate.selectExpr("*", f"{below} AS below"), [],
        "CASE WHEN sum(p) * sum(q) > 0 THEN sum(p * (below + q / 2)) / (sum(p) * sum(q)) END AS pooled_auc",
    )


def probability_bin(p: str, bins: int = 10) -> str:
    """Equal-width bin by explicit edges ``i * step``: an edge value goes to the upper bin."""
    step = 1.0 / bins
    edges = " + ".join(f"CASE WHEN {p} >= {num(i * step)} THEN 1 ELSE 0 END" for i in range(1, bins))
    return f"({edges})"


def reliability(df: DataFrame, keys: Seq[str] = (), label: str = "label", pred: str = "pred",
                bins: int = 10) -> DataFrame:
    """Mean prediction, observed rate and count per probability bin."""
    binned = df.selectExpr(
        *keys, f"CAST({label} AS DOUBLE) AS y", f"{clip_probability(pred)} AS p"
    ).selectExpr(*keys, "y", "p", f"{probability_bin('p', bins)} AS bin")
    return aggregate(
        binned, [*keys, "bin"], "avg(p) AS mean_pred", "avg(y) AS frac_positive", "count(1) AS n"
    )


def calibration_error(curve: DataFrame, keys: Seq[str] = ()) -> DataFrame:
    return aggregate(curve, keys, "sum(n * abs(mean_pred - frac_positive)) / sum(n) AS ece")


def quantile_edges(df: DataFrame, value: str, bins: int, cells: int):
    """Distinct quantile edges as a scalar array column."""
    rows = ranked(histogram(df, [], value), [], chunked=True, cells=cells)
    points = ", ".join(quantile(i / bins) for i in range(bins + 1))
    return aggregate(rows, [], f"array_distinct(array({points})) AS edges").scalar()


def quantile_bins(df: DataFrame, value: str, bins: int = 5, cells: int = CELLS,
                  name: str = "bin") -> DataFrame:
    """Right-closed quantile bins 1..k, the minimum included, repeated edges dropped."""
    return df.withColumn("_edges", quantile_edges(df, value, bins, cells)).selectExpr(
        *df.columns, f"greatest(size(filter(_edges, e -> e < {value})), 1) AS {name}",
        f"element_at(_edges, greatest(size(filter(_edges, e -> e < {value})), 1)) AS {name}_low",
        f"element_at(_edges, greatest(size(filter(_edges, e -> e < {value})), 1) + 1) AS {name}_high",
    )


def slice_report(df: DataFrame, slice_col: str, label: str = "label", pred: str = "pred",
                 min_n: int = 50) -> DataFrame:
    """Scores per slice with at least ``min_n`` rows, largest first."""
    return scores(df, [slice_col], label, pred).where(f"n >= {min_n}").orderBy("n", ascending=False)
