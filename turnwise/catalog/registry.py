"""Query registration and the shared output convention.

Doubles are rounded to six places on both sides, because the order of floating-point sums
differs between engines and between runs.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

PLACES = 6
MODULES = (
    "sessions", "dialogue", "retrieval", "responses", "evaluation", "tables", "learning",
)


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    def register(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir))

        build.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, build, sql, covers)
        return fn

    return register


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles, widen counts to bigint."""
    cols = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            cols.append(f"round(CAST({name} AS DOUBLE), {PLACES}) + 0D AS {name}")
        elif kind in ("int", "smallint", "tinyint"):
            cols.append(f"CAST({name} AS BIGINT) AS {name}")
        else:
            cols.append(name)
    return df.selectExpr(*cols)


def rounded(sql: str, doubles: str | list[str] | tuple[str, ...]) -> str:
    """The same rounding in SQL for the named columns."""
    names = doubles.split() if isinstance(doubles, str) else list(doubles)
    body = ", ".join(f"CAST(round({n}, {PLACES}) + 0.0 AS DOUBLE) AS {n}" for n in names)
    return f"SELECT * REPLACE ({body}) FROM ({sql}) AS _final"


def robust_sql(values: str, stem: str) -> str:
    """Four robust statistics of a list-valued SQL expression."""
    q = lambda p: f"list_aggregate({values}, 'quantile_cont', {p})"
    return (
        f"coalesce({q(0.5)}, 0.0) AS {stem}_median, "
        f"coalesce(list_avg(list_filter({values}, lambda v: v >= {q(0.1)} AND v <= {q(0.9)})), {q(0.5)}, 0.0)"
        f" AS {stem}_trimmean, "
        f"coalesce({q(0.75)} - {q(0.25)}, 0.0) AS {stem}_iqr, "
        f"coalesce({q(0.9)}, 0.0) AS {stem}_p90"
    )


def load_all() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"{__package__}.{module}")
    return REGISTRY
