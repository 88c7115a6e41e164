"""Connected components of a link table by alternating stars, on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

MOST_ROUNDS = 60


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one partition reduced to (node, smallest node reachable by them)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = parent[min(a, b)] = min(a, b)
    links = [(x, root(x)) for x in list(parent)]
    links = [(x, r) for x, r in links if x != r]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([r for _, r in links], pa.int64())],
                                     names=["a", "b"])


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour (or itself)."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").selectExpr("b AS a", "m AS b").where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    down = links.selectExpr("greatest(a, b) AS a", "least(a, b) AS b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").selectExpr("b AS a", "m AS b")
    return moved.union(least.selectExpr("a", "m AS b")).where("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node reachable.

    Self-links and repeated links are allowed; a node without links does not appear.  Each round is
    written, so no lineage grows and nothing but two numbers a round reaches the driver.
    """
    clean = links.selectExpr("CAST(a AS BIGINT) AS a", "CAST(b AS BIGINT) AS b").where("a <> b")
    current, before = written(clean.mapInArrow(_local_forest, "a long, b long"), "links"), None
    for _ in range(MOST_ROUNDS):
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not state[0] or state == before:
            break
        before = state
        current = written(_small_star(_large_star(current)), "links")
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.selectExpr("a AS node", "b AS component").union(roots.selectExpr("node", "node AS component"))
