"""Leakage-safe target encodings by subtraction.

Sums per (objective, fold) are taken once.  What a fold's training rows know about an
objective is the total minus the fold's share; for a training row of that fold's model its
own fold is subtracted as well.  No fold loop and no self join over rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.scalars import num
from .ordered import aggregate, small_side

SMOOTHING = 20.0  # fixed value: prior strength


def smoothed_means(rows: DataFrame, key: str = "objective_id", label: str = "label",
                   m: float = SMOOTHING) -> DataFrame:
    """``(sum + m * global) / (n + m)`` per key, with the global rate alongside."""
    per_key = aggregate(rows, [key], f"sum({label}) AS s", "count(1) AS n")
    rate = aggregate(per_key, [], "sum(s) / sum(n) AS g").scalar()
    return per_key.withColumn("global_rate", rate).selectExpr(
        key, "n", f"(s + {num(m)} * global_rate) / (n + {num(m)}) AS encoding", "global_rate"
    )


def apply_encoding(rows: DataFrame, means: DataFrame, fallback: float | str,
                   key: str = "objective_id", name: str = "encoding") -> DataFrame:
    """Look a fitted map up, with a fallback for unknown keys."""
    missing = num(fallback) if isinstance(fallback, float) else fallback
    return rows.join(small_side(means.selectExpr(key, "encoding AS _e")), key, "left").selectExpr(
        *rows.columns, f"coalesce(_e, {missing}) AS {name}"
    )


def objective_sums(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Per key: total sum and count, and a map fold -> (sum, count) with at most k entries."""
    cell = aggregate(rows, [key, "fold"], f"sum({label}) AS s", "count(1) AS n")
    return aggregate(
        cell, [key], "sum(s) AS s_all", "sum(n) AS n_all",
        "map_from_entries(collect_list(struct(CAST(fold AS INT) AS fold, struct(s, n) AS v))) AS by_fold",
    )


def fold_sums(rows: DataFrame, label: str) -> DataFrame:
    """One row: overall sum and count and the per-fold map."""
    per_fold = aggregate(rows, ["fold"], f"sum({label}) AS s", "count(1) AS n")
    return aggregate(
        per_fold, [],
        "struct(sum(s) AS s, sum(n) AS n, "
        "map_from_entries(collect_list(struct(CAST(fold AS INT) AS fold, struct(s, n) AS v))) AS by_fold) AS g",
    )


def outer_encoding(folds: DataFrame, m: float = SMOOTHING, key: str = "objective_id",
                   label: str = "label", name: str = "encoding") -> DataFrame:
    """Each row encoded from the training rows of its own fold; unseen keys get their rate."""
    overall = fold_sums(folds, label).scalar()
    at = lambda v, part: f"coalesce({v}[CAST(fold AS INT)].{part}, 0)"
    known = folds.join(small_side(objective_sums(folds, key, label)), key).withColumn("g", overall)
    rate = f"(g.s - {at('g.by_fold', 's')}) / (g.n - {at('g.by_fold', 'n')})"
    return known.selectExpr(
        *folds.columns, f"{rate} AS fold_rate",
        f"(s_all - {at('by_fold', 's')} + {num(m)} * ({rate})) "
        f"/ (n_all - {at('by_fold', 'n')} + {num(m)}) AS {name}",
    )


def encoding_for(outer: str, own: str, m: float = SMOOTHING) -> str:
    """SQL over ``s_all, n_all, by_fold, g``: what the model of fold ``outer`` may know of the objective
    of a row of fold ``own``.

    A validation row (own = outer) reads the outer training rows.  A training row leaves its own fold
    out as well: the inner folds are the remaining outer folds, which are group-disjoint already, so a
    row never sees its own group's labels.
    """
    less = lambda v, part: (
        f"coalesce({v}[{outer}].{part}, 0) "
        f"+ CASE WHEN {own} = {outer} THEN 0 ELSE coalesce({v}[{own}].{part}, 0) END"
    )
    rate = f"((g.s - ({less('g.by_fold', 's')})) / (g.n - ({less('g.by_fold', 'n')})))"
    return (f"(s_all - ({less('by_fold', 's')}) + {num(m)} * {rate}) "
            f"/ (n_all - ({less('by_fold', 'n')}) + {num(m)})")


def model_encodings(folds: DataFrame, k: int = 5, m: float = SMOOTHING, key: str = "objective_id",
                    label: str = "label") -> DataFrame:
    """The encoding of every row for every outer model: ``outer_fold, side, encoding``."""
    overall = fold_sums(folds, label).scalar()
    out = (
        folds.join(small_side(objective_sums(folds, key, label)), key)
        .withColumn("g", overall)
        .selectExpr("*", f"explode(sequence(0, {k - 1})) AS outer_fold")
    )
    own = "CAST(fold AS INT)"
    return out.selectExpr(
        *folds.columns, "outer_fold",
        f"CASE WHEN {own} = outer_fold THEN 'validation' ELSE 'train' END AS side",
        f"{encoding_for('outer_fold', own, m)} AS encoding",
    )


def purged_rates(purged: DataFrame, label: str = "label") -> DataFrame:
    """Training rate left after purging, per fold: the value an unseen objective gets."""
    return aggregate(purged, ["train_fold"], f"avg({label}) AS rate", "count(1) AS n_train")
