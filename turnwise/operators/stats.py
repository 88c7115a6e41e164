"""Exact distribution statistics from value histograms.

A percentile needs the sorted values of a group.  Instead of gathering them, equal values
are counted first (map-side combined), and the running count over the distinct values is a
``scan``.  Every order statistic is then a conditional aggregate over those counts.
"""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import DataFrame

from ..functions.scalars import num
from ..session import cut
from .ordered import GROUP_ROWS, Sequence, aggregate, has_large_groups, scan

ROBUST = ("median", "trimmean", "iqr", "p90")


def histogram(df: DataFrame, keys: Seq[str], value: str) -> DataFrame:
    """Distinct finite values of each group with their counts."""
    return aggregate(
        df.selectExpr(*keys, f"CAST({value} AS DOUBLE) AS value")
        .where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('Infinity')"),
        [*keys, "value"],
        "count(1) AS cnt",
    )


CELLS = 128


def balanced(df: DataFrame, cells: int = CELLS) -> DataFrame:
    """Add ``_cell``, which never falls as ``value`` rises and holds about as many rows for each number.

    Borders come from a quantile sketch of the values, so values packed into a narrow range spread
    over as many cells as others; where a border falls changes no result.
    """
    points = ", ".join(f"{i / cells!r}D" for i in range(1, cells))
    borders = aggregate(df, [], f"percentile_approx(value, array({points}), 2000) AS b").scalar()
    return df.withColumn("_borders", borders).selectExpr(
        *df.columns, "aggregate(_borders, 0, (n, x) -> n + CASE WHEN value >= x THEN 1 ELSE 0 END) AS _cell")


def ranked(hist: DataFrame, keys: Seq[str], chunked: bool, cells: int = CELLS) -> DataFrame:
    """Add ``c0`` (rows below this value) and ``n`` (rows in the group).

    In chunked form values are sorted in ``cells`` parts of about equal size.
    """
    seq = Sequence(tuple(keys), ("value",), ("_cell",) if chunked else ())
    rows = balanced(hist, cells) if chunked else hist
    out = scan(rows, seq, running={"c0": "cnt"}, totals={"n": ("sum", "cnt")})
    return out.drop("_cell") if chunked else out


def quantile(q: float) -> str:
    """Linear-interpolated quantile, as an aggregate over ``ranked`` rows."""
    at = f"((n - 1) * {num(q)})"
    holds = lambda r: f"c0 <= {r} AND {r} < c0 + cnt"
    a = f"max(CASE WHEN {holds(f'floor{at}')} THEN value END)"
    b = f"max(CASE WHEN {holds(f'ceil{at}')} THEN value END)"
    top = f"((max(n) - 1) * {num(q)})"
    return f"({a} + ({b} - {a}) * ({top} - floor{top}))"


def robust_aggregates(trim: float = 0.1) -> list[str]:
    """Median, trimmed mean, interquartile range and 90th percentile over ranked rows."""
    inside = (
        f"c0 + cnt - 1 >= ceil((n - 1) * {num(trim)}) AND c0 <= floor((n - 1) * {num(1.0 - trim)})"
    )
    trimmed = (
        f"sum(CASE WHEN {inside} THEN cnt * value END) / sum(CASE WHEN {inside} THEN cnt END)"
    )
    return [
        f"{quantile(0.5)} AS median",
        f"coalesce({trimmed}, {quantile(0.5)}) AS trimmean",
        f"{quantile(0.75)} - {quantile(0.25)} AS iqr",
        f"{quantile(0.9)} AS p90",
    ]


def row_ranks(keys: Seq[str], value: str, tag: str, where: str) -> list[str]:
    """Per-row tie bounds and group size of ``value`` among the rows of a *small* group.

    Columns ``{tag}_c0, {tag}_c1, {tag}_n``; they share the exchange on the leading key with
    every other window of the group, so robust statistics cost a sort and no shuffle.
    """
    part = f"PARTITION BY {', '.join(keys)}, ({where})"
    return [
        f"rank() OVER ({part} ORDER BY {value}) - 1 AS {tag}_c0",
        f"count(1) OVER ({part} ORDER BY {value} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {tag}_c1",
        f"count(1) OVER ({part}) AS {tag}_n",
    ]


def robust_rows(value: str, tag: str, where: str, stem: str, trim: float = 0.1) -> list[str]:
    """The four robust statistics as aggregates over rows that carry ``row_ranks``."""
    c0, c1, n = f"{tag}_c0", f"{tag}_c1", f"{tag}_n"

    def at(q: float) -> str:
        spot, top = f"(({n} - 1) * {num(q)})", f"((max(CASE WHEN {where} THEN {n} END) - 1) * {num(q)})"
        pick = lambda r: f"max(CASE WHEN ({where}) AND {c0} <= {r} AND {r} < {c1} THEN {value} END)"
        low, high = pick(f"floor{spot}"), pick(f"ceil{spot}")
        return f"({low} + ({high} - {low}) * ({top} - floor{top}))"

    inside = (
        f"({where}) AND {c1} - 1 >= ceil(({n} - 1) * {num(trim)}) AND {c0} <= floor(({n} - 1) * {num(1.0 - trim)})"
    )
    return [
        f"coalesce({at(0.5)}, 0D) AS {stem}_median",
        f"coalesce(avg(CASE WHEN {inside} THEN {value} END), {at(0.5)}, 0D) AS {stem}_trimmean",
        f"coalesce({at(0.75)} - {at(0.25)}, 0D) AS {stem}_iqr",
        f"coalesce({at(0.9)}, 0D) AS {stem}_p90",
    ]


def robust_stats(hist: DataFrame, keys: Seq[str], chunked: bool = False, trim: float = 0.1,
                 cells: int = CELLS) -> DataFrame:
    """One row of robust statistics per group of a histogram."""
    return aggregate(ranked(hist, keys, chunked, cells), keys, *robust_aggregates(trim))


def robust_wide(hist: DataFrame, key: Seq[str], measure: str, names: dict[str, str],
                chunked: bool = False, cells: int = CELLS) -> DataFrame:
    """Robust statistics of several measures as columns of one row per key.

    ``names`` maps a value of the ``measure`` column to a column stem.
    """
    stats = robust_stats(hist, [*key, measure], chunked, cells=cells)
    return aggregate(
        stats,
        key,
        *[
            f"coalesce(max(CASE WHEN {measure} = '{m}' THEN {s} END), 0D) AS {stem}_{s}"
            for m, stem in names.items()
            for s in ROBUST
        ],
    )


DESCRIBE_PERCENTS = (0, 1, 5, 25, 50, 75, 90, 95, 99, 100)  # fixed values: reported percentiles


def describe(df: DataFrame, keys: Seq[str], value: str, chunked: bool = True,
             cells: int = CELLS) -> DataFrame:
    """Percentiles, mean, population deviation and count of the non-missing values."""
    rows = ranked(histogram(df, keys, value), keys, chunked, cells)
    mean = "sum(value * cnt) / sum(cnt)"
    return aggregate(
        rows,
        keys,
        *[f"{quantile(p / 100.0)} AS p{p}" for p in DESCRIBE_PERCENTS],
        f"{mean} AS mean",
        f"sqrt(greatest(sum(value * value * cnt) / sum(cnt) - ({mean}) * ({mean}), 0D)) AS std",
        "sum(cnt) AS n",
    )


def slope(y: str, index: str, minimum: int) -> tuple[str, str]:
    """Least-squares slope of y over its index scaled to 0..1, and R squared (aggregates).

    Both are 0 for fewer than ``minimum`` points; R squared of a constant series is 0.
    """
    value, i = f"CAST({y} AS DOUBLE)", f"CAST(CASE WHEN ({y}) IS NOT NULL THEN {index} END AS DOUBLE)"
    enough = f"count({y}) >= {minimum}"
    steep = f"CASE WHEN {enough} THEN coalesce(regr_slope({value}, {i}) * (count({y}) - 1), 0D) ELSE 0D END"
    fit = (
        f"CASE WHEN {enough} AND coalesce(var_pop({value}), 0D) <> 0 "
        f"THEN coalesce(regr_r2({value}, {i}), 0D) ELSE 0D END"
    )
    return steep, fit


def gini(hist: DataFrame, keys: Seq[str], size: str, chunked: bool = False,
         cells: int = CELLS) -> DataFrame:
    """Concentration of non-negative values; group members absent from ``hist`` are zeros.

    ``size`` is a column of ``hist`` with the full group size including those zeros.
    """
    clipped = aggregate(
        hist.selectExpr(*keys, "greatest(value, 0D) AS value", "cnt", size),
        [*keys, "value"], "sum(cnt) AS cnt", f"max({size}) AS {size}",
    )
    rows = ranked(clipped, keys, chunked, cells)
    total, whole = "sum(value * cnt)", f"max({size})"
    # ranks of a block of ties are c0+1 .. c0+cnt, shifted by the implicit zeros
    weighted = f"(sum(value * (cnt * c0 + cnt * (cnt + 1) / 2)) + ({whole} - max(n)) * {total})"
    return aggregate(
        rows,
        keys,
        f"CASE WHEN {total} <= 0 OR {whole} < 2 THEN 0D ELSE "
        f"2 * {weighted} / ({whole} * {total}) - ({whole} + 1) / {whole} END AS gini",
    )


def score_counts(df: DataFrame, keys: Seq[str], label: str, score: str) -> DataFrame:
    """Rows, labelled rows, positives and negatives of every distinct score of a group, written once."""
    return cut(aggregate(
        df.selectExpr(*keys, f"CAST({score} AS DOUBLE) AS value", f"CAST({label} AS DOUBLE) AS _y"),
        [*keys, "value"], "sum(_y) AS pos", "sum(1D - _y) AS neg", "count(1) AS n", "count(_y) AS n_y",
    ))


def auc_of_counts(counts: DataFrame, keys: Seq[str], cells: int = CELLS) -> DataFrame:
    """``auc`` of ``score_counts``: how many negatives lie below each value is a running sum over the
    values, cut into cells only where a group has more of them than one task may sort."""
    large = has_large_groups(counts, tuple(keys), GROUP_ROWS)
    seq = Sequence(tuple(keys), ("value",), ("_cell",) if large else ())
    below = scan(balanced(counts, cells) if large else counts, seq, running={"neg_below": "neg"})
    return aggregate(
        below,
        keys,
        "CASE WHEN sum(pos) * sum(neg) > 0 THEN sum(pos * (neg_below + neg / 2)) / (sum(pos) * sum(neg)) END AS auc",
        "sum(pos) AS n_pos",
        "sum(neg) AS n_neg",
    )


def auc(df: DataFrame, keys: Seq[str], label: str, score: str, cells: int = CELLS) -> DataFrame:
    """Tie-aware ROC AUC per group; null when a group has a single class."""
    return auc_of_counts(score_counts(df, keys, label, score), keys, cells)
