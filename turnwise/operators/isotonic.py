"""Isotonic fits of any number of points, and their application, without a list of knots.

Points are pooled inside ranges of the score first.  What is left are blocks (a range, its sum and its
weight); pooling is associative, so blocks are pooled again in fewer, wider ranges until no border
between two ranges is out of order.  Fits of several keys (folds, methods) run in the same passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ordered import GROUP_ROWS, Sequence, aggregate, scan

#: Blocks that one task pools.
PER_TASK = 500_000
#: Cells a range of scores in [0, 1] is cut into where a key has more points than one task may sort.
CELLS = 4096
BLOCKS = "key long, lo double, hi double, total double, weight double"


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adjacent violators of a stream sorted by (key, lo), pooled key by key."""
    stack: list[list] = []

    def out() -> Iterator[pa.RecordBatch]:
        for at in range(0, len(stack), 65_536):
            columns = zip(*stack[at:at + 65_536], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.float64()) for i, c in enumerate(columns)],
                                             names=["key", "lo", "hi", "total", "weight"])
        stack.clear()

    for batch in batches:
        for key, lo, hi, total, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if stack and stack[-1][0] != key:
                yield from out()
            while stack and stack[-1][3] * weight > total * stack[-1][4]:
                _, lo, _, more, other = stack.pop()
                total, weight = total + more, weight + other
            stack.append([key, lo, hi, total, weight])
    yield from out()


def _out_of_order(blocks: DataFrame) -> bool:
    """Whether the last block of a range lies above the first one of the next range."""
    edges = aggregate(
        blocks, ["part", "key"], "min(lo) AS lo", "min_by(total / weight, lo) AS first", "max_by(total / weight, lo) AS last")
    return not edges.selectExpr("first", "lag(last) OVER (PARTITION BY key ORDER BY lo) AS before").where("before > first").isEmpty()


def isotonic_blocks(points: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """Blocks ``key, lo, hi, value, weight`` of the non-decreasing least-squares fit of each key.

    ``points(key long, x, y, weight)``: equal ``x`` of a key are merged first; nulls take no part, nor
    do weights of zero.  Two or more passes over tables that shrink; the number of ranges falls from
    pass to pass, so the passes end.
    """
    merged = aggregate(points.where("x IS NOT NULL AND y IS NOT NULL AND weight > 0"), ["key", "x"],
                       "sum(y * weight) AS total", "sum(weight) AS weight")
    blocks = cut(merged.selectExpr("CAST(key AS BIGINT) AS key", "CAST(x AS DOUBLE) AS lo", "CAST(x AS DOUBLE) AS hi",
                                   "CAST(total AS DOUBLE) AS total", "CAST(weight AS DOUBLE) AS weight"))
    ranges = None
    while ranges != 1:
        needed = max(1, -(-blocks.count() // per_task))
        ranges = needed if ranges is None else min(needed, ranges - 1)
        dealt = blocks.repartitionByRange(ranges, "key", "lo") if ranges > 1 else blocks.coalesce(1)
        pooled = cut(dealt.sortWithinPartitions("key", "lo").mapInArrow(_pool, BLOCKS).withColumn("part", F.spark_partition_id()))
        blocks = pooled.drop("part")
        if ranges > 1 and not _out_of_order(pooled):
            break
    return blocks.selectExpr("key", "lo", "hi", "total / weight AS value", "weight")


def _along(chunked: bool, order: tuple[str, ...]) -> Sequence:
    return Sequence(("key",), order, (f"CAST(floor({order[0]} * {CELLS}) AS BIGINT)",) if chunked else ())


def interpolated(points: DataFrame, blocks: DataFrame, x: str = "x", name: str = "fitted") -> DataFrame:
    """``points`` with the fit of their ``key`` at ``x``: constant inside a block, linear between
    blocks, the end values outside; null where the key has no blocks or ``x`` is null.

    One ordered scan over blocks and points together, cut by score where a key holds many of them.
    """
    own = points.columns
    chunked = not aggregate(points.select("key").unionAll(blocks.select("key")), ["key"], "count(1) AS n").where(
        f"n > {GROUP_ROWS}").isEmpty()
    ahead = scan(blocks.selectExpr("key", "lo", "hi", "value", "-lo AS _down"), _along(chunked, ("_down",)),
                 prev={"next_lo": "lo", "next_value": "value"})
    knots = ahead.selectExpr("key", "lo AS _x", "0 AS _kind", "named_struct('lo', lo, 'hi', hi, 'value', value, "
                             "'next_lo', next_lo, 'next_value', next_value) AS _knot")
    asked = points.where(f"{x} IS NOT NULL").selectExpr("key", f"CAST({x} AS DOUBLE) AS _x", "1 AS _kind", "struct(*) AS _row")
    both = knots.unionByName(asked, allowMissingColumns=True)
    found = scan(both, _along(chunked, ("_x", "_kind")), peak={"_below": "_knot"}, totals={"_first": ("min", "_knot")})
    value = (
        "CASE WHEN _below IS NULL THEN _first.value WHEN _x <= _below.hi OR _below.next_lo IS NULL THEN _below.value "
        "ELSE _below.value + (_x - _below.hi) * (_below.next_value - _below.value) / (_below.next_lo - _below.hi) END"
    )
    known = found.where("_kind = 1").selectExpr(*[f"_row.{c} AS {c}" for c in own], f"{value} AS {name}")
    return known.unionByName(points.where(f"{x} IS NULL").withColumn(name, F.lit(None).cast("double")))
