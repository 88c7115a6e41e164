"""Joins with the checks that make a wrong cohort visible."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.scalars import num
from .ordered import aggregate


def unmatched(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """Left join plus the number of rows whose right side is missing."""
    return aggregate(
        left.join(right, key, "left"), [], "count(1) AS n_rows",
        f"count_if({column} IS NULL) AS n_missing",
    )


def block_join(base: DataFrame, block: DataFrame, key: str) -> DataFrame:
    """Many-to-one left join; columns the base already has are dropped from the block."""
    fresh = [c for c in block.columns if c == key or c not in base.columns]
    return base.join(block.select(*fresh), key, "left")


def block_audit(base: DataFrame, block: DataFrame, key: str) -> DataFrame:
    """The facts a safe block join needs, in one row.

    ``null_keys`` and ``repeated_keys`` concern the block; ``joined_rows`` must equal
    ``base_rows``; ``absent_rows`` are base rows for which every block column is null.
    """
    fresh = [c for c in block.columns if c != key and c not in base.columns]
    keys = aggregate(block, [key], "count(1) AS n")
    facts = aggregate(
        keys, [],
        f"coalesce(sum(CASE WHEN {key} IS NULL THEN n END), 0) AS null_keys",
        f"count_if({key} IS NOT NULL AND n > 1) AS repeated_keys",
    )
    joined = aggregate(
        block_join(base, block, key), [],
        "count(1) AS joined_rows",
        f"count_if(coalesce({', '.join(f'CAST({c} AS STRING)' for c in fresh)}) IS NULL) AS absent_rows",
    )
    size = aggregate(base, [], "count(1) AS n").scalar()
    column = lambda name: facts.select(name).scalar()
    return (
        joined.withColumn("base_rows", size)
        .withColumn("null_keys", column("null_keys"))
        .withColumn("repeated_keys", column("repeated_keys"))
        .selectExpr(
            "null_keys", "repeated_keys", "base_rows", "joined_rows", "absent_rows",
            "null_keys = 0 AND repeated_keys = 0 AND base_rows = joined_rows AND absent_rows = 0 AS safe",
        )
    )


def checked_block_join(base: DataFrame, block: DataFrame, key: str) -> DataFrame:
    """``block_join`` that first runs the audit and refuses an unsafe block."""
    if key not in block.columns:
        raise KeyError(f"block has no column {key!r}")
    facts = block_audit(base, block, key).first()
    if not facts["safe"]:
        raise ValueError(f"unsafe block join on {key!r}: {facts.asDict()}")
    return block_join(base, block, key)


def coverage(left: DataFrame, right: DataFrame, key: str, required: float = 0.99) -> DataFrame:
    """Share of left rows that a one-to-one join keeps, and whether it is enough."""
    total = aggregate(left, [], "count(1) AS n").scalar()
    return (
        aggregate(left.join(right.select(key), key), [], "count(1) AS n_joined")
        .withColumn("n_left", total)
        .selectExpr(
            "n_left", "n_joined", "n_joined / greatest(n_left, 1) AS coverage",
            f"n_joined / greatest(n_left, 1) >= {num(required)} AS sufficient",
        )
    )


def cohort_audit(reference: DataFrame, candidate: DataFrame, key: str = "response_id") -> DataFrame:
    """Whether two prediction tables describe the same responses, labels and sessions."""
    side = lambda df, p: aggregate(
        df, [key], f"count(1) AS {p}_n", f"min(label) AS {p}_label", f"min(session_id) AS {p}_session"
    )
    both = side(reference, "r").join(side(candidate, "c"), key, "full_outer")
    return aggregate(
        both, [],
        "count_if(c_n IS NULL) AS only_reference",
        "count_if(r_n IS NULL) AS only_candidate",
        "count_if(r_n > 1 OR c_n > 1) AS duplicated",
        f"count_if({key} IS NULL) AS null_ids",
        "count_if(r_label <> c_label) AS label_differs",
        "count_if(r_session <> c_session) AS session_differs",
    ).selectExpr(
        "*", "only_reference + only_candidate + duplicated + null_ids + label_differs "
        "+ session_differs = 0 AS comparable",
    )


def require_same_cohort(reference: DataFrame, candidate: DataFrame, key: str = "response_id") -> None:
    facts = cohort_audit(reference, candidate, key).first()
    if not facts["comparable"]:
        raise ValueError(f"prediction cohorts differ: {facts.asDict()}")


def long_values(df: DataFrame, key: str) -> DataFrame:
    """``key, feature, value`` rows of every numeric column but the key."""
    numeric = [c for c, t in df.dtypes if c != key and t in
               ("double", "float", "bigint", "int", "smallint", "tinyint")]
    pairs = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in numeric)
    return df.selectExpr(key, f"stack({len(numeric)}, {pairs}) AS (feature, value)")


def value_parity(left: DataFrame, right: DataFrame, key: str, rtol: float = 1e-9,
                 atol: float = 1e-9) -> DataFrame:
    """Cell-by-cell equality of two feature tables within a tolerance; nulls equal nulls."""
    a = long_values(left, key).withColumnRenamed("value", "a")
    b = long_values(right, key).withColumnRenamed("value", "b")
    both = a.join(b, [key, "feature"], "full_outer")
    same = f"(a <=> b) OR coalesce(abs(a - b) <= {num(atol)} + {num(rtol)} * abs(b), false)"
    per_feature = aggregate(
        both, ["feature"], "count(1) AS cells", f"count_if(NOT ({same})) AS bad",
        "max(abs(a - b)) AS delta",
    )
    return aggregate(
        per_feature, [], "sum(cells) AS n_cells", "sum(bad) AS n_bad_cells",
        "count_if(bad > 0) AS n_bad_columns", "coalesce(max(delta), 0D) AS max_abs_delta",
    )


def set_difference(expected: DataFrame, produced: DataFrame, key: str) -> DataFrame:
    """Missing and unexpected keys, each with its kind."""
    want, have = expected.select(key).distinct(), produced.select(key).distinct()
    return want.exceptAll(have).selectExpr(key, "'missing' AS kind").unionByName(
        have.exceptAll(want).selectExpr(key, "'unexpected' AS kind")
    )


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the smallest by ``order``, as a map-side combined aggregate."""
    rest = [c for c in df.columns if c != key]
    pick = aggregate(df, [key], f"min_by(struct({', '.join(rest)}), struct({order})) AS _row")
    return pick.select(key, "_row.*")


def guarded_block_join(base: DataFrame, block: DataFrame, key: str, name: str = "block") -> DataFrame:
    """Many-to-one left join that fails while running if the block is unsafe.

    The checks ride along: a key repeated in the block, or a base row without any block
    value, raises as soon as a block column is read.  One pass, no separate audit job.
    """
    if key not in block.columns:
        raise KeyError(f"{name} has no column {key!r}")
    fresh = [c for c in block.columns if c != key and c not in base.columns]
    packed = aggregate(
        block, [key], f"any_value(struct({', '.join(fresh)})) AS _b", "count(1) AS _n",
        f"bool_and(coalesce({', '.join(f'CAST({c} AS STRING)' for c in fresh)}) IS NULL) AS _void",
    )
    joined = base.join(packed, key, "left")
    safe = (
        f"CASE WHEN _n > 1 THEN raise_error('{name}: repeated {key}') "
        f"WHEN _b IS NULL OR _void THEN raise_error('{name}: absent for a row') ELSE _b END AS _b"
    )
    return joined.selectExpr(*base.columns, safe).select(*base.columns, "_b.*")
