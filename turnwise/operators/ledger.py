"""Cost ledgers and importance summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.scalars import num
from ..functions.text import block_of
from .joins import long_values
from .ordered import Sequence, aggregate, scan


def with_units(runs: DataFrame, rates: dict[str, float]) -> DataFrame:
    """Units of a run: the tier's hourly rate times the hours connected."""
    rules = " ".join(f"WHEN tier = '{t}' THEN {num(r)}" for t, r in rates.items())
    return runs.selectExpr("*", f"(CASE {rules} ELSE 0D END) * wall_seconds / 3600D AS units")


def cost_rollup(runs: DataFrame, rates: dict[str, float], balance: float) -> DataFrame:
    """Units by task and by tier plus the total and what is left of the balance."""
    cell = aggregate(
        with_units(runs, rates), ["task", "tier"], "sum(units) AS units", "count(1) AS n_runs"
    )
    part = lambda kind, key: aggregate(
        cell, [key], "sum(units) AS units", "sum(n_runs) AS n_runs"
    ).selectExpr(f"'{kind}' AS kind", f"{key} AS key", "units", "n_runs")
    total = aggregate(cell, [], "sum(units) AS units", "sum(n_runs) AS n_runs")
    return (
        part("task", "task").unionByName(part("tier", "tier"))
        .unionByName(total.selectExpr("'total' AS kind", "'spent' AS key", "units", "n_runs"))
        .unionByName(total.selectExpr("'total' AS kind", "'left' AS key", f"{num(balance)} - units AS units", "n_runs"))
    )


def cumulative_units(runs: DataFrame, rates: dict[str, float], order: tuple[str, ...],
                     chunk: tuple[str, ...]) -> DataFrame:
    """Running units over time; ``chunk`` cuts the one global order, for example by day."""
    spent = scan(with_units(runs, rates), Sequence((), order, chunk), running={"_before": "units"})
    return spent.selectExpr(*runs.columns, "units", "_before + units AS cumulative_units")


def importance_summary(gains: DataFrame) -> DataFrame:
    """Gain per feature over the fold models, with its block: ``feature, fold, gain``."""
    return aggregate(
        gains, ["feature"], "avg(gain) AS gain_mean",
        "CASE WHEN count(gain) > 1 THEN stddev_samp(gain) END AS gain_std",
        "min(gain) AS gain_min", "max(gain) AS gain_max",
    ).selectExpr("*", f"{block_of('feature')} AS block").orderBy("gain_mean", ascending=False)


def importance_by_block(summary: DataFrame) -> DataFrame:
    return aggregate(summary, ["block"], "sum(gain_mean) AS gain").orderBy("gain", ascending=False)


def block_summary(features: DataFrame, key: str) -> DataFrame:
    """Features and missing share per block, with rows in the table."""
    cells = aggregate(
        long_values(features, key), ["feature"], "count(1) AS n_rows", "count_if(value IS NULL) AS n_missing"
    )
    return aggregate(
        cells.selectExpr("*", f"{block_of('feature')} AS block"), ["block"],
        "count(1) AS n_features", "max(n_rows) AS n_rows", "sum(n_missing) / sum(n_rows) AS missing_rate",
    )
