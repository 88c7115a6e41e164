"""Near-duplicate vectors by navigable small-world graphs, one graph per shard.

Equal vectors of a label are one class.  The classes of a label are dealt into shards of bounded
size and each shard gets a hierarchical graph.  Every class then searches every shard of its label:
a beam walks down the layers and is widened while its last entry is still a link, and for all while
an audit against brute force on a bounded sample misses links.  Cosines of what was found are
checked in double precision, and links become components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import written
from .vptree import _stack, sound

SHARD, QUERY_BLOCK = 16_384, 4096
NEIGHBOURS, BUILD_BEAM, BEAM, STEP = 12, 48, 32, 4
#: Queries of a block that are compared with the whole shard, and the share of links they must find.
AUDITED, RECALL = 64, 1.0
SHARDS = "label string, width int, shard int, ids binary, counts binary, rows binary, graph binary"
BLOCKS = "label string, width int, block int, query_ids binary, query_rows binary"
FOUND = "vec_id long, n_links long, root long"


class Graph:
    """Layered neighbour lists over unit vectors; -1 fills unused places."""

    def __init__(self, points: np.ndarray, seed: int = 11):
        self.points, n = points, len(points)
        rng = np.random.default_rng(seed)
        heights = np.minimum((-np.log(rng.random(n)) / np.log(NEIGHBOURS)).astype(int), 6) if n else np.zeros(0, int)
        order = rng.permutation(n)
        order = order[np.argsort(-heights[order], kind="stable")] if n else order
        self.heights, self.entry = heights, int(order[0]) if n else -1
        self.layers = [np.full((n, NEIGHBOURS * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(heights.max(initial=0)) + 1)]
        self.present = np.zeros(n, bool)
        done = 0
        while done < n:
            batch = order[done:done + min(256, max(1, done))]
            self._insert(batch)
            done += len(batch)

    def _insert(self, batch: np.ndarray) -> None:
        points = self.points[batch]
        start = np.full((len(batch), 1), self.entry)
        for layer in range(len(self.layers) - 1, -1, -1):
            own = self.heights[batch] >= layer
            known = self.present & (self.heights >= layer)
            if known.any():
                near, _ = self._beam(points, start, layer, BUILD_BEAM if own.any() else STEP)
            else:
                near = np.full((len(batch), 1), -1)
            if own.any():
                mates = np.broadcast_to(batch[own], (own.sum(), own.sum()))
                candidates = np.concatenate([near[own], mates], axis=1)
                self._link(batch[own], candidates, layer)
            start = np.where(near[:, :STEP] >= 0, near[:, :STEP], start[:, :1])
        self.present[batch] = True

    def _link(self, rows: np.ndarray, candidates: np.ndarray, layer: int) -> None:
        lists = self.layers[layer]
        chosen = self._select(rows, candidates, NEIGHBOURS)
        lists[rows, :NEIGHBOURS] = chosen
        source, target = np.repeat(rows, NEIGHBOURS), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        touched, starts, sizes = np.unique(target, return_index=True, return_counts=True)
        extra = np.full((len(touched), int(sizes.max(initial=0))), -1)
        extra[np.repeat(np.arange(len(touched)), sizes), np.arange(len(target)) - np.repeat(starts, sizes)] = source
        for at in range(0, len(touched), 256):
            some = touched[at:at + 256]
            lists[some] = self._select(some, np.concatenate([lists[some], extra[at:at + 256]], axis=1), lists.shape[1])

    def _select(self, rows: np.ndarray, candidates: np.ndarray, k: int) -> np.ndarray:
        """Near and mutually distant neighbours; free places go to the nearest of the others."""
        candidates = np.sort(np.where(candidates == rows[:, None], -1, candidates), axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        sims = np.einsum("bd,bkd->bk", self.points[rows], self.points[candidates])
        sims[candidates < 0] = -np.inf
        order = np.argsort(-sims, axis=1, kind="stable")[:, :3 * k]
        candidates, sims = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(sims, order, axis=1)
        vectors = self.points[candidates]
        between = np.einsum("bid,bjd->bij", vectors, vectors)
        taken, blocked = np.zeros(candidates.shape, bool), sims == -np.inf
        for i in range(candidates.shape[1]):
            free = ~blocked[:, i] & (taken.sum(axis=1) < k)
            taken[:, i] = free
            blocked |= free[:, None] & (between[:, i] >= sims)
        rank = np.where(taken, 0, np.where(sims > -np.inf, 1, 2))
        pick = np.argsort(rank, axis=1, kind="stable")[:, :k]
        out = np.take_along_axis(np.where(sims > -np.inf, candidates, -1), pick, axis=1)
        if out.shape[1] < k:
            out = np.pad(out, ((0, 0), (0, k - out.shape[1])), constant_values=-1)
        return out

    def _beam(self, queries: np.ndarray, start: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest points that a best-first walk from ``start`` meets, nearest first."""
        lists, b, n = self.layers[layer], len(queries), len(self.points)
        seen = np.zeros((b, n + 1), bool)
        ids, sims = np.full((b, width), -1), np.full((b, width), -np.inf)
        fresh = start
        open_ = np.zeros((b, width), bool)
        active = np.arange(b)
        while len(active):
            fresh = np.sort(np.where(seen[active[:, None], fresh], -1, fresh), axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            seen[active[:, None], fresh] = True
            seen[:, -1] = False
            found = np.einsum("bd,bkd->bk", queries[active], self.points[fresh])
            found[fresh < 0] = -np.inf
            all_ids = np.concatenate([ids[active], fresh], axis=1)
            all_sims = np.concatenate([sims[active], found], axis=1)
            all_open = np.concatenate([open_[active], fresh >= 0], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids[active] = np.take_along_axis(all_ids, order, axis=1)
            sims[active] = np.take_along_axis(all_sims, order, axis=1)
            now_open = np.take_along_axis(all_open, order, axis=1) & (ids[active] >= 0)
            step = np.cumsum(now_open, axis=1)
            expand = now_open & (step <= STEP)
            open_[active] = now_open & ~expand
            going = expand.any(axis=1)
            active, expand = active[going], expand[going]
            if not len(active):
                break
            pick = np.argsort(~expand, axis=1, kind="stable")[:, :STEP]
            nodes = np.where(np.take_along_axis(expand, pick, axis=1), np.take_along_axis(ids[active], pick, axis=1), -1)
            fresh = np.where(nodes[:, :, None] >= 0, lists[nodes], -1).reshape(len(active), -1)
        return ids, sims

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.full((len(queries), 1), self.entry)
        for layer in range(len(self.layers) - 1, 0, -1):
            near, _ = self._beam(queries, start, layer, STEP)
            start = np.where(near >= 0, near, start[:, :1])
        return self._beam(queries, start, 0, width)

    def saved(self) -> bytes:
        head = np.array([len(self.layers), self.entry], "<i4").tobytes()
        return zstandard.compress(head + b"".join(x.astype("<i4").tobytes() for x in self.layers), 1)

    @classmethod
    def loaded(cls, points: np.ndarray, raw: bytes) -> Graph:
        graph, flat = cls.__new__(cls), np.frombuffer(zstandard.decompress(raw), "<i4")
        graph.points, graph.entry, at, graph.layers = points, int(flat[1]), 2, []
        for k in range(int(flat[0])):
            wide = NEIGHBOURS * (2 if k == 0 else 1)
            graph.layers.append(flat[at:at + len(points) * wide].reshape(-1, wide))
            at += len(points) * wide
        return graph


def links(graph: Graph, queries: np.ndarray, least: float, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) of every pair with a cosine of at least ``least`` that the beams find."""
    width, n = BEAM, len(graph.points)
    audit = np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(int)
    truth = [np.flatnonzero(graph.points @ queries[i] >= least) for i in audit]
    while True:
        pairs = [_widened(graph, queries[at:at + block], least, min(width, n), at) for at in range(0, len(queries), block)]
        q, p = (np.concatenate(x) for x in zip(*pairs, strict=True))
        order = np.argsort(q, kind="stable")
        q, p = q[order], p[order]
        held = [len(np.intersect1d(t, p[np.searchsorted(q, i):np.searchsorted(q, i, side="right")])) for i, t in zip(audit, truth, strict=True)]
        if sum(held) >= RECALL * sum(map(len, truth)) or width >= n:
            return q, p
        width *= 2


def _widened(graph: Graph, queries: np.ndarray, least: float, width: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one block; a query whose whole beam links searches again with a wider one, at last all points."""
    n, todo, found = len(graph.points), np.arange(len(queries)), []
    while len(todo):
        if width * 2 >= n:
            for at in range(0, len(todo), 256):
                some = todo[at:at + 256]
                a, b = np.nonzero(queries[some] @ graph.points.T >= least)
                found.append((some[a], b))
            break
        ids, sims = graph.search(queries[todo], width)
        more = sims[:, -1] >= least
        a, b = np.nonzero((sims >= least) & ~more[:, None])
        found.append((todo[a], ids[a, b]))
        todo, width = todo[more], width * 2
    q = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    p = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    return q + offset, p


def _unit(rows: np.ndarray) -> np.ndarray:
    largest = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / largest
    return rows / np.sqrt((rows ** 2).sum(axis=1, keepdims=True))


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.98, shard_rows: int = SHARD, block_rows: int = QUERY_BLOCK) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): n_links, component_id and kept.

    Rows of equal labels are linked by a cosine of at least ``least``.  A row with a null id or label,
    or a vector that is null, empty, zero or not finite throughout, links with nothing; without an id
    it has no component.  Vectors of different length link with nothing.  Rows that repeat an id are
    vectors of their own.
    """
    everything = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    vector = F.transform("embedding", lambda x: x.cast("double"))
    marked = everything.withColumn("vector", vector).withColumn("takes_part", F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & sound("vector"), F.lit(False)))
    taking = written(marked.where("takes_part").select(
        "vec_id", "label", "vector", F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(1), "vector").alias("k2")), "vectors")
    keys = ["label", "k1", "k2"]
    classes = written(taking.groupBy(*keys).agg(
        F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.min("vector").alias("vector")).withColumn("width", F.size("vector")), "classes")
    sizes = classes.groupBy("label", "width").agg(F.count("*").alias("total"))
    counted = classes.join(sizes, ["label", "width"])

    def dealt(name: str, size: int) -> DataFrame:
        return counted.withColumn(name, F.pmod(F.xxhash64("k1", F.lit(name)), F.ceil(F.col("total") / size)).cast("int"))

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        data = _stack(table.column("vector"))
        graph = Graph(_unit(data))
        return pa.table({
            "label": pa.array([key[0].as_py()]), "width": pa.array([key[1].as_py()], pa.int32()), "shard": pa.array([key[2].as_py()], pa.int32()),
            "ids": pa.array([_bytes(table, "first_id")]), "counts": pa.array([_bytes(table, "n")]),
            "rows": pa.array([data.astype("<f8").tobytes()]), "graph": pa.array([graph.saved()])})

    def block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.table({
            "label": pa.array([key[0].as_py()]), "width": pa.array([key[1].as_py()], pa.int32()), "block": pa.array([key[2].as_py()], pa.int32()),
            "query_ids": pa.array([_bytes(table, "first_id")]), "query_rows": pa.array([_stack(table.column("vector")).astype("<f8").tobytes()])})

    graphs = written(dealt("shard", shard_rows).groupBy("label", "width", "shard").applyInArrow(build, SHARDS), "graphs")
    asks = written(dealt("block", block_rows).groupBy("label", "width", "block").applyInArrow(block, BLOCKS), "asks")

    def query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, ids, counts, data, raw, query_ids, query_rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, counts, asked = (np.frombuffer(x, "<i8") for x in (ids, counts, query_ids))
                graph = Graph.loaded(_unit(np.frombuffer(data, "<f8").reshape(-1, width)), raw)
                q, p = links(graph, _unit(np.frombuffer(query_rows, "<f8").reshape(-1, width)), least)
                other = asked[q] != ids[p]
                q, p = q[other], p[other]
                yield _found(asked, np.bincount(q, weights=counts[p], minlength=len(asked)).astype(np.int64), asked[q], ids[p])

    pairs = graphs.join(asks, ["label", "width"]).repartition(F.col("label"), F.col("shard"), F.col("block"))
    met = written(pairs.select("width", "ids", "counts", "rows", "graph", "query_ids", "query_rows").mapInArrow(query, FOUND), "found")
    counts = met.where("n_links IS NOT NULL").groupBy("vec_id").agg(F.sum("n_links").alias("linked"))
    components = connected_components(met.where("root IS NOT NULL").selectExpr("vec_id AS a", "root AS b"))

    judged = (classes.select(*keys, "first_id", "n").join(counts.withColumnRenamed("vec_id", "first_id"), "first_id", "left")
              .join(components.withColumnRenamed("node", "first_id"), "first_id", "left")
              .select(*keys, (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                      F.coalesce("component", "first_id").alias("component_id")))
    linked = taking.select("vec_id", *keys).join(judged, keys).select("vec_id", "n_links", "component_id")
    alone = marked.where("NOT takes_part").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _bytes(table: pa.Table, name: str) -> bytes:
    return table.column(name).to_numpy().astype("<i8").tobytes()


def _found(asked: np.ndarray, n_links: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Counts of every query, and for every vector with links the smallest one reachable by these links."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = flat[:len(a)], flat[len(a):]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, left, label[right])
        np.minimum.at(new, right, label[left])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    n, m = len(asked), len(nodes)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([asked, nodes])),
        pa.array(np.concatenate([n_links, np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n),
        pa.array(np.concatenate([np.zeros(n, np.int64), nodes[label] if m else nodes]), mask=np.arange(n + m) < n),
    ], names=["vec_id", "n_links", "root"])
