"""Design-matrix assembly from feature blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.joins import guarded_block_join

# Columns computed from other responses of the session, and non-features.
CROSS_ROW = ("lopos_n_competing_los", "lopos_ordinal", "lopos_ordinal_frac", "lopos_overlap_with_others")
IDENTIFIERS = ("response_id", "session_id", "fold", "label", "objective_text", "objective_id")
NUMERIC = ("double", "float", "bigint", "int", "smallint", "tinyint")


def feature_columns(matrix: DataFrame, allow_cross_row: bool = False) -> list[str]:
    """Numeric columns that are neither identifiers nor (by default) cross-row aggregates."""
    return [
        c for c, t in matrix.dtypes
        if t in NUMERIC and c not in IDENTIFIERS and (allow_cross_row or c not in CROSS_ROW)
    ]


def build_matrix(
    base: DataFrame, blocks: Sequence[tuple[str, DataFrame, str]], allow_cross_row: bool = False
) -> tuple[DataFrame, list[str]]:
    """Join ``(name, block, key)`` blocks onto the responses; returns frame and features."""
    out = base
    for name, block, key in blocks:
        out = guarded_block_join(out, block, key, name)
    return out, feature_columns(out, allow_cross_row)
