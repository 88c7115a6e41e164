"""Nearest neighbours by inner product with vantage-point trees, one tree per shard.

Shards hold vectors of one length and one band of norms (a power of two), so that a single long vector
changes no other band.  Inside a shard vectors are scaled by a power of two and get one more component
that makes them equally long, which turns the largest inner product into the smallest distance to the
query's unit vector.  A node keeps a vantage vector and the median distance to it; a query goes to its
own side first and to the other side only where the triangle inequality, relaxed by ``factor``, lets a
nearer vector be.  Factor one is exact, ties included; larger factors prune more.

Shards hold a bounded number of vectors and queries go in blocks, so a task's memory does not grow
with the tables.  Equal vectors of a shard are one point of its tree with their smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, written

SHARD, QUERY_BLOCK, LEAF = 8192, 2048, 64
#: So many blocks of queries share one copy of a shard.
STRIPE = 16
FACTOR = 1.05
#: The audit lowers the factor until it measures this share of the true neighbours.
RECALL = 0.9
FOUND = "query_id long, vec_id long, score double"


def sound(name: str) -> Column:
    """Whether an array of doubles is not zero and finite throughout."""
    finite = F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return finite & F.exists(name, lambda x: x != 0)


def usable(vectors: DataFrame, id_name: str = "vec_id", vector_name: str = "embedding") -> DataFrame:
    """(vec_id, vector) of rows whose vector is neither null, empty nor zero and is finite throughout.

    Rows without an id take no part; of rows that share an id all stay.
    """
    v = F.transform(F.col(vector_name), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_name).cast("long").alias("vec_id"), v.alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    return rows.where(sound("vector"))


def band(name: str) -> Column:
    """Whole binary logarithm of a vector's norm; neither squares nor the norm itself can overflow."""
    largest = F.array_max(F.transform(name, F.abs))
    squares = F.aggregate(name, F.lit(0.0), lambda a, x: a + (x / largest) * (x / largest))
    return F.floor(F.log2(largest) + F.log2(squares) / 2).cast("int")


class Tree:
    """A vantage-point tree over vectors of like norm, asked for largest inner products.

    ``points`` are scaled to norms of about one at most; ``ids`` decide between equal scores.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, exponent: int, seed: int = 5):
        self.vectors, self.ids, self.rng = np.asfortranarray(vectors), ids, np.random.default_rng(seed)
        # halves first: one step could pass the range of powers of two
        scaled = np.ldexp(np.ldexp(vectors, -(exponent // 2)), -(exponent - exponent // 2))
        squares = (scaled ** 2).sum(axis=1)
        self.points = np.column_stack([scaled, np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))])
        self.length = squares.max(initial=0)
        self.slack = 1e-14 * max(self.points.shape[1], 64)
        self.root = self._build(np.arange(len(vectors)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        vantage = int(rows[self.rng.integers(len(rows))])
        distance = np.sqrt(((self.points[rows] - self.points[vantage]) ** 2).sum(axis=1))
        radius = float(np.median(distance))
        near = distance <= radius
        if near.all():
            return rows
        return vantage, radius, self._build(rows[near]), self._build(rows[~near])

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the ``k`` points of largest product with each query and the products; -1 where there are fewer."""
        n, asked = len(queries), np.asfortranarray(queries)
        largest = np.abs(queries).max(axis=1, keepdims=True)
        units = queries / largest
        units = np.column_stack([units / np.sqrt((units ** 2).sum(axis=1, keepdims=True)), np.zeros(n)])
        best, rows = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)
        scores, ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

        def compare(who: np.ndarray, part: np.ndarray) -> None:
            squared = np.maximum(self.length + 1 - 2 * units[who] @ self.points[part].T, 0)
            bound = np.partition(np.concatenate([best[who] ** 2, squared], axis=1), k - 1, axis=1)[:, k - 1]
            q, p = np.nonzero(squared <= bound[:, None] + self.slack)
            place = np.arange(len(q)) - np.searchsorted(q, q)
            shape = (len(who), int(place.max(initial=-1)) + 1)
            found = [np.full(shape, x) for x in (np.inf, -1, -np.inf, np.iinfo(np.int64).max)]
            products = _products(asked, self.vectors, who[q], part[p])
            for table, values in zip(found, (np.sqrt(squared[q, p]), part[p], products, self.ids[part[p]]), strict=True):
                table[q, place] = values
            held = [np.concatenate([old[who], new], axis=1) for old, new in zip((best, rows, scores, ids), found, strict=True)]
            pick = np.lexsort((held[3], -held[2], held[1] < 0), axis=1)[:, :k]
            for old, new in zip((best, rows, scores, ids), held, strict=True):
                old[who] = np.take_along_axis(new, pick, axis=1)

        def visit(node, who: np.ndarray) -> None:
            if not len(who):
                return
            if isinstance(node, np.ndarray):
                for at in range(0, len(node), 1024):
                    compare(who, node[at:at + 1024])
                return
            vantage, radius, inner, outer = node
            d = np.sqrt(((units[who] - self.points[vantage]) ** 2).sum(axis=1))
            inside = d <= radius
            visit(inner, who[inside])
            visit(outer, who[~inside])
            reach = best[who].max(axis=1) / factor + self.slack ** 0.5
            visit(outer, who[inside & (radius - d <= reach)])
            visit(inner, who[~inside & (d - radius <= reach)])

        with np.errstate(over="ignore", invalid="ignore"):
            visit(self.root, np.arange(n))
        return rows, scores


def _products(a: np.ndarray, b: np.ndarray, rows_a=slice(None), rows_b=slice(None)) -> np.ndarray:
    """Inner products of paired rows, summed component by component in order."""
    total = np.zeros(len(a[rows_a, 0]))
    for k in range(a.shape[1]):
        total += a[rows_a, k] * b[rows_b, k]
    return total


def _stack(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, factor: float = FACTOR, shard_rows: int = SHARD,
            block_rows: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product for each row of ``queries``.

    Both are (vec_id, vector) as ``usable`` gives them; only vectors of one length are compared.  A query's own id is no
    candidate.  Equal scores are ordered by smaller id.  A product beyond the range of doubles is infinite or not a
    number in ``score``; which of such rows are found follows from the scaled vectors.  Returns query_id, rank,
    vec_id, score.
    """
    points = written(vectors.withColumn("width", F.size("vector")).withColumn("band", band("vector")), "vectors")
    asked = written(queries, "queries")
    blocks = max(1, -(-asked.count() // block_rows))
    counts = points.groupBy("width", "band").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    parts = counts.agg(F.sum("shards")).first()[0]
    if not parts:
        return points.selectExpr("vec_id AS query_id", "0 AS rank", "vec_id", "0D AS score")
    stripes = -(-blocks // STRIPE)

    stored = points.join(counts, ["width", "band"]).withColumn("shard", F.expr("CAST(pmod(xxhash64(vec_id), shards) AS INT)"))
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    sent = asked.select("*", F.size("vector").alias("width"), block.alias("block"))

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("vec_id").to_numpy(), kind="stable")
        ids, rows = table.column("vec_id").to_numpy()[order], _stack(table.column("vector"))[order]
        return pa.table([*(pa.array([x.as_py()], pa.int32()) for x in key), pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                         pa.array([rows.astype("<f8").tobytes()], pa.binary())], names=[*names[len(key)], "ids", "rows"])

    names = {3: ["width", "band", "shard"], 2: ["width", "block"]}
    trees = written(stored.select(*names[3], "vec_id", "vector").groupBy(*names[3]).applyInArrow(
        pack, "width int, band int, shard int, ids binary, rows binary"), "shards")
    asks = written(sent.groupBy("width", "block").applyInArrow(pack, "width int, block int, ids binary, rows binary"), "asks")
    shards = counts.selectExpr("width", "band", "explode(sequence(0, shards - 1)) AS shard")
    # a shard travels once for each stripe of blocks, a block once for each shard
    keys, tasks = ["width", "band", "shard", "stripe"], parts * stripes
    copies = trees.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).repartition(tasks, *keys)
    spread = asks.join(shards, "width").selectExpr(*keys[:3], f"block div {STRIPE} AS stripe", "ids AS query_ids", "rows AS query_rows")
    spread = spread.withColumn("stripe", F.col("stripe").cast("int")).repartition(tasks, *keys)
    pairs = copies.hint("shuffle_hash").join(spread, keys).select("width", "band", "ids", "rows", "query_ids", "query_rows")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for batch in batches:
            for at in range(batch.num_rows):
                width, exponent, ids, rows, query_ids, query_rows = (c[at].as_py() for c in batch.columns)
                if held[0] != (ids, rows):
                    held = ((ids, rows), _indexed(np.frombuffer(ids, "<i8"), np.frombuffer(rows, "<f8").reshape(-1, width), exponent, k))
                yield _answers(held[1], np.frombuffer(query_ids, "<i8"), np.frombuffer(query_rows, "<f8").reshape(-1, width), k, factor)

    found = pairs.mapInArrow(search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _indexed(ids: np.ndarray, rows: np.ndarray, exponent: int, k: int):
    """Tree over a shard's distinct vectors; each with its k + 1 smallest ids, as no answer needs more."""
    distinct, where = np.unique(rows, axis=0, return_inverse=True)
    order = np.lexsort((ids, where.ravel()))
    starts = np.searchsorted(where.ravel()[order], np.arange(len(distinct)))
    ends = np.append(starts[1:], len(ids))
    own = [ids[order[a:min(b, a + k + 1)]] for a, b in zip(starts, ends, strict=True)]
    return Tree(distinct, ids[order[starts]], exponent + 1), own


def _answers(index, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> pa.RecordBatch:
    tree, own = index
    rows, scores = tree.search(queries, min(k + 1, len(own)), factor)
    asked, hit = np.nonzero(rows >= 0)
    point = rows[asked, hit]
    sizes = np.array([len(own[p]) for p in point], np.int64)
    q, s = np.repeat(asked, sizes), np.repeat(scores[asked, hit], sizes)
    v = np.concatenate([np.zeros(0, np.int64), *(own[p] for p in point)])
    keep = v != query_ids[q]
    q, s, v = q[keep], s[keep], v[keep]
    order = np.lexsort((v, -s, q))
    q, s, v = q[order], s[order], v[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return pa.RecordBatch.from_arrays([pa.array(query_ids[q[first]]), pa.array(v[first]), pa.array(s[first])],
                                      names=["query_id", "vec_id", "score"])


def audited_nearest(vectors: DataFrame, queries: DataFrame, k: int, factor: float = FACTOR, least: float = RECALL,
                    shard_rows: int = SHARD, block_rows: int = QUERY_BLOCK) -> DataFrame:
    """``nearest`` with a factor that ``recall`` has measured to find at least this share; one, if no other does."""
    while True:
        answers = written(nearest(vectors, queries, k, factor, shard_rows, block_rows), "answers")
        if factor <= 1 or recall(answers, vectors, queries, k) >= least:
            return answers
        discard(answers)
        factor = 1 + (factor - 1) / 4 if factor > 1.01 else 1.0


def recall(answers: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, block: int = 256) -> float:
    """Share of the true ``k`` nearest that ``answers`` holds, for a bounded sample of queries.

    The sample is the ``block`` queries of smallest hash; every vector is compared with them.
    """
    chosen = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(block).collect()
    if not chosen:
        return 1.0
    all_ids, chosen_rows = np.array([r.vec_id for r in chosen]), [r.vector for r in chosen]
    widths = np.array([len(r) for r in chosen_rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for width in np.unique(lengths).tolist():
                part, same = batch.filter(pa.array(lengths == width)), np.flatnonzero(widths == width)
                if not len(same):
                    continue
                own, ids = part.column(0).to_numpy(), all_ids[same]
                with np.errstate(over="ignore", invalid="ignore"):
                    scores = _stack(pa.chunked_array([part.column(1)])) @ np.array([chosen_rows[j] for j in same]).T
                scores[own[:, None] == ids[None, :]] = -np.inf
                top = np.argpartition(-scores, min(k, len(own)) - 1, axis=0)[:k]
                for j, q in enumerate(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), q)), pa.array(own[top[:, j]]), pa.array(scores[top[:, j], j])],
                                                     names=["query_id", "vec_id", "score"])

    truth = vectors.select("vec_id", "vector").mapInArrow(run, FOUND).where("score > double('-infinity')")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    truth = truth.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vec_id")
    both = truth.join(answers.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    total, hit = both.agg(F.count("*"), F.count("hit")).first()
    return hit / max(total, 1)
