"""Deterministic samples and cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.scalars import seeded_hash
from .ordered import Sequence, aggregate, scan


def first_cohort(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first ``n`` distinct keys in file order, with the row that introduced them."""
    return aggregate(df.where(f"{key} IS NOT NULL"), [key], f"min({order}) AS first_at").orderBy(
        "first_at", key
    ).limit(n)


GROUP_LIMIT = 1_000  # rows per group up to which Spark trims partitions before the shuffle


def per_group_sample(df: DataFrame, group: str, row_id: str, n_sample: int, seed: int = 0) -> DataFrame:
    """``max(1, n_sample // groups)`` rows of every group in seeded hash order.

    A small share is a ranked limit, which Spark applies to each partition before the
    shuffle (window group limit).  A larger one ranks groups in hash-prefix chunks.
    """
    take = max(1, n_sample // max(1, df.select(group).distinct().count()))
    hashed = df.selectExpr("*", f"{seeded_hash(group, row_id, seed=seed)} AS _h")
    if take <= GROUP_LIMIT:
        ranked = hashed.selectExpr("*", f"row_number() OVER (PARTITION BY {group} ORDER BY _h) - 1 AS _rank")
    else:
        ranked = scan(hashed, Sequence((group,), ("_h",), ("substr(_h, 1, 3)",)), running={"_rank": "1L"})
    return ranked.where(f"_rank < {take}").drop("_rank", "_h")


def collapse_rare(df: DataFrame, column: str, keep: int = 10, other: str = "(other)") -> DataFrame:
    """Keep the most frequent values (ties by value), rename the rest."""
    top = aggregate(df, [column], "count(1) AS _n").orderBy("_n", column, ascending=[False, True]).limit(keep)
    known = top.selectExpr(column, f"{column} AS _kept")
    return df.join(known, column, "left").withColumn(column, known_or(other)).drop("_kept")


def known_or(other: str):
    from pyspark.sql.functions import expr

    return expr(f"coalesce(CAST(_kept AS STRING), '{other}')")
