"""Paired and repeated comparisons of experiments."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import DataFrame

from ..functions.scalars import num
from .ordered import aggregate

Z95 = 1.96  # fixed value


def summarize(runs: DataFrame, keys: Seq[str] = ("name",), value: str = "value") -> DataFrame:
    """Mean, sample deviation, standard error, 95% interval and sign agreement over seeds."""
    means = aggregate(runs, keys, f"avg({value}) AS _mean").select(*keys, "_mean")
    rows = runs.join(means, list(keys)) if keys else runs.withColumn("_mean", means.scalar())
    base = aggregate(
        rows, keys,
        f"count({value}) AS n_seeds", f"avg({value}) AS mean",
        f"CASE WHEN count({value}) > 1 THEN stddev_samp({value}) END AS sd",
        f"count_if({value} <> 0 AND sign({value}) = sign(_mean)) AS n_same_sign",
    )
    half = f"{num(Z95)} * sd / sqrt(n_seeds)"
    return base.selectExpr(
        *keys, "n_seeds", "mean", "sd", "sd / sqrt(n_seeds) AS sem",
        f"mean - {half} AS ci95_low", f"mean + {half} AS ci95_high", "n_same_sign",
        f"coalesce(mean - {half} > 0 OR mean + {half} < 0, false) AS excludes_zero",
    )


def paired_delta(runs: DataFrame, baseline: str, keys: Seq[str] = ("name",), seed: str = "seed",
                 value: str = "value") -> DataFrame:
    """Variant minus baseline per shared seed, as ``name, seed, value``."""
    base = runs.where(f"name = '{baseline}'").selectExpr(seed, f"{value} AS _base")
    return runs.where(f"name <> '{baseline}'").join(base, seed).selectExpr(
        "name", seed, f"{value} - _base AS value"
    )


def promotion(summary: DataFrame, least_gain: float, sign: int = 1) -> DataFrame:
    """Whether a gain is large enough, clear of zero and agreed on by every seed."""
    gain, low = ("mean", "ci95_low") if sign > 0 else ("-mean", "-ci95_high")
    return summary.selectExpr(
        "*", f"coalesce({gain} >= {num(least_gain)} AND {low} > 0 AND n_same_sign = n_seeds, false) AS promoted"
    )


def fold_assignment_test(folds: DataFrame) -> DataFrame:
    """A/B over fold assignments: ``fold_seed, fold, baseline_auc, candidate_auc``.

    Folds of one assignment partition the same objectives, so they are averaged first and
    the error bar comes from the assignments.
    """
    per_seed = aggregate(
        folds, ["fold_seed"], "avg(candidate_auc - baseline_auc) AS delta",
        "avg(baseline_auc) AS b", "avg(candidate_auc) AS c",
    )
    total = aggregate(
        per_seed, [],
        "count(1) AS n_assignments", "avg(b) AS baseline_auc", "avg(c) AS candidate_auc",
        "avg(delta) AS mean_delta", "CASE WHEN count(1) > 1 THEN stddev_samp(delta) END AS sd_delta",
        "count_if(delta > 0) AS n_positive",
    )
    return total.selectExpr(
        "*", "sd_delta / sqrt(n_assignments) AS stderr",
        "coalesce(mean_delta > 2 * sd_delta / sqrt(n_assignments) "
        "AND n_positive >= greatest(4, n_assignments - 1), false) AS promotable",
    )


def gain_constant(scored: DataFrame, eps: float = 1e-6) -> DataFrame:
    """``k = (H(base) - logloss) / (AUC - 0.5)^2`` per experiment."""
    from ..functions.scalars import log_loss

    return scored.selectExpr(
        "*", f"{log_loss('pos_rate', 'pos_rate', eps)} - logloss AS gain"
    ).selectExpr("*", "gain / pow(auc - 0.5, 2) AS k")


def projected_loss(auc_value: str, c: float, k: float) -> str:
    """Projected log loss of a calibrated model at this AUC."""
    return f"({num(c)} - {num(k)} * pow({auc_value} - 0.5, 2))"


def leaderboard(runs: DataFrame, top: int = 60) -> DataFrame:
    """Best distinct ``(experiment, score)`` runs, full and subsampled kept apart.

    Repeats are collapsed by a map-side combined aggregate before ranking, and only the
    leading rows of each side are ranked.
    """
    kept = aggregate(
        runs.where("logloss IS NOT NULL").selectExpr(
            "*", "subsample IS NOT NULL AS subsampled", "round(logloss, 6) AS score"
        ),
        ["subsampled", "experiment", "score"], "min(ts) AS ts", "count(1) AS n_runs",
    )
    place = "row_number() OVER (PARTITION BY subsampled ORDER BY score, experiment)"
    return kept.selectExpr("*", f"{place} AS place").where(f"place <= {top}")


def noise_floor(per_seed: DataFrame) -> DataFrame:
    """How much one setting moves when only the fold seed changes: ``per_seed(seed, value)``.

    Neighbouring seeds are paired, so a gain below these differences cannot be told from a reshuffle.
    """
    moved = per_seed.selectExpr("value - lag(value) OVER (ORDER BY seed) AS delta")
    return aggregate(
        moved, [], "count(delta) AS n_pairs", "avg(abs(delta)) AS mean_move", "stddev_samp(delta) AS sd_move",
        "max(abs(delta)) AS largest_move",
    )
