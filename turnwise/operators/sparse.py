"""Linear models over sparse rows, the models of all folds (or classes) in one fit.

Rows are sparse (``buckets`` and ``values`` arrays), packed once into blocks of many rows, and never move: in a
step each task reads its blocks once, takes every row's residual under every model and sums residual times value by bucket.  What
crosses the network is a sum for each bucket and model, and back come the coefficients, as a broadcast.
Both are buckets x models numbers whatever the data; ``MODEL_BYTES`` bounds them.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from collections.abc import Sequence as Seq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, discard
from .ordered import aggregate

#: Most bytes of coefficients of all models together.
MODEL_BYTES = 64 << 20
#: Most bytes of sums that the driver adds up itself; more are added up in tasks.
DIRECT_BYTES = 64 << 20
#: Buckets whose sums travel together.
STRETCH = 4096


#: Entries of a block; a longer row is a block of its own.
BLOCK_ENTRIES = 1 << 16
#: Bytes of a row group of blocks, which a reader holds at once.
GROUP_BYTES = 32 << 20
#: Values are numbers into the block's distinct values; a pass is bound by the bytes it reads.
PARTS = {"fold": "<i4", "label": "<f8", "weight": "<f8", "sizes": "<i4", "buckets": "<i4", "codes": "<u2", "values": "<f8"}


@dataclass
class Block:
    """Rows with ``sizes`` entries each, and the entries' buckets and values one row after another."""

    fold: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    sizes: np.ndarray
    buckets: np.ndarray
    values: np.ndarray

    def by_row(self, entries: np.ndarray) -> np.ndarray:
        """Sums of entries for every row."""
        return sums_of(entries, self.sizes)

    def margins(self, weights: np.ndarray, scale: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray]]:
        return _margins(self, weights, scale)

    def add(self, sums: np.ndarray, own: np.ndarray, held: list[np.ndarray]) -> None:
        """Add each model's residuals (rows x models) times the rows to ``sums``, models x buckets."""
        for k in range(len(sums)):
            sums[k] += np.bincount(self.buckets, held[k] * np.repeat(own[:, k], self.sizes), sums.shape[1])


def sums_of(entries: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of stretches of ``sizes`` entries, one after another."""
    out, held = np.zeros(len(sizes)), np.flatnonzero(sizes)
    if len(held):
        out[held] = np.add.reduceat(entries, (sizes.cumsum() - sizes)[held])
    return out


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of entries of each row of the batch, and all buckets and values."""
    buckets, values = batch.column("buckets"), batch.column("values")
    return np.diff(buckets.offsets.to_numpy()).astype(np.int64), buckets.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy()


def packed(rows: DataFrame) -> DataFrame:
    """``rows(fold, label, weight, buckets, values)`` as blocks, written once; a column for each part, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, buckets, values = _flat(batch)
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "label", "weight")]
            ends, start = sizes.cumsum(), 0
            while start < len(sizes):
                before = ends[start] - sizes[start]
                end = max(start + 1, min(start + BLOCK_ENTRIES, int(np.searchsorted(ends, before + BLOCK_ENTRIES, "right"))))
                distinct, codes = np.unique(values[before:ends[end - 1]], return_inverse=True)
                kinds = PARTS | {"codes": "<u2" if len(distinct) <= 1 << 16 else "<u4"}
                parts = [*(c[start:end] for c in own), sizes[start:end], buckets[before:ends[end - 1]], codes, distinct]
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip(parts, kinds.values(), strict=True)],
                                                 names=list(PARTS))
                start = end

    chosen = rows.select("fold", "label", "weight", "buckets", "values")
    return cut(chosen.mapInArrow(run, ", ".join(f"{c} binary" for c in PARTS)), **{"parquet.block.size": str(GROUP_BYTES)})


def _blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    for i in range(batch.num_rows):
        raw = {c: batch.column(c)[i].as_buffer() for c in PARTS}
        kinds = PARTS | {"codes": "<u2" if 2 * len(raw["codes"]) == len(raw["buckets"]) else "<u4"}
        own = {c: np.frombuffer(raw[c], kind) for c, kind in kinds.items()}
        yield Block(own["fold"], own["label"], own["weight"], own["sizes"].astype(np.int64), own["buckets"].astype(np.int64), own["values"][own["codes"]])


def _margins(block: Block, weights: np.ndarray, scale: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Linear predictors, rows x models, and each model's entry values; ``weights`` has a row for each model, the intercept last.

    With ``scale`` (models x buckets) an entry is its value times the model's scale, over the row's length.
    """
    held, out = [], []
    for k, at in enumerate(weights):
        own = block.values
        if scale is not None:
            own = own * scale[k][block.buckets]
            length = np.sqrt(block.by_row(own * own))
            own = own / np.repeat(np.where(length > 0, length, 1.0), block.sizes)
        held.append(own)
        out.append(block.by_row(own * at[block.buckets]) + at[-1])
    return np.stack(out, axis=1), held


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


Residual = Callable[[np.ndarray, Block], np.ndarray]
#: Blocks of a batch; besides ``Block`` any that has fold, label, weight, ``margins`` and ``add``.
Opened = Callable[[pa.RecordBatch], Iterator[Block]]


def outside_folds(folds: Seq[int]) -> Residual:
    """(probability - label) of a logistic model for each fold; a row's own fold does not see it."""
    codes = np.array(folds)

    def residual(z: np.ndarray, block: Block) -> np.ndarray:
        out = (_sigmoid(z) - block.label[:, None]) * block.weight[:, None]
        out[block.fold[:, None] == codes[None, :]] = 0.0
        return out

    return residual


def of_classes(z: np.ndarray, block: Block) -> np.ndarray:
    """(share - 1 for the row's class) of a model that shares one among the columns; ``label`` is the class."""
    share = np.exp(z - z.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    share[np.arange(len(z)), block.label.astype(int)] -= 1.0
    return share * block.weight[:, None]


def gradients(blocks: DataFrame, residual: Residual, weights: np.ndarray, scale: np.ndarray | None = None, opened: Opened = _blocks) -> np.ndarray:
    """Sum over rows of each model's residual times the row: buckets + 1 x models.

    Sums travel as packed stretches of ``STRETCH`` buckets, added up stretch by stretch, from as many tasks as there are cores.
    """
    context, shape = blocks.sparkSession.sparkContext, weights.shape
    sent = context.broadcast(tuple(None if x is None else np.ascontiguousarray(x.T) for x in (weights, scale)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (at, scales), sums = sent.value, np.zeros(shape[::-1])
        for batch in batches:
            for block in opened(batch):
                z, held = block.margins(at, scales)
                own = residual(z, block)
                block.add(sums[:, :-1], own, held)
                sums[:, -1] += own.sum(axis=0)
        sums = np.ascontiguousarray(sums.T)
        for start in range(0, len(sums), STRETCH):
            part = sums[start:start + STRETCH]
            if part.any():
                yield _stretch(start, part)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for start, own in itertools.groupby(cells, key=lambda c: c[0]):
            yield _stretch(start, sum(np.frombuffer(payload) for _, payload in own))

    kinds = "start long, sums binary"
    parts = blocks.coalesce(context.defaultParallelism).mapInArrow(partial, kinds)
    few = context.defaultParallelism * weights.nbytes <= DIRECT_BYTES
    whole = (parts if few else parts.repartition("start").sortWithinPartitions("start").mapInArrow(added, kinds)).toArrow()
    out = np.zeros(shape)
    for start, payload in zip(whole.column("start").to_pylist(), whole.column("sums").to_pylist(), strict=True):
        own = np.frombuffer(payload).reshape(-1, shape[1])
        out[start:start + len(own)] += own
    sent.destroy()
    return out


def _stretch(start: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([start]), pa.array([sums.tobytes()], pa.binary())], names=["start", "sums"])


def bounded(size: int, models: int) -> None:
    if size * models * 8 > MODEL_BYTES:
        raise ValueError(f"{size} buckets for {models} models exceed {MODEL_BYTES} bytes")


def descend(blocks: DataFrame, residual: Residual, total: np.ndarray, size: int, reg: np.ndarray, elastic: float, steps: int,
            tolerance: float, square: float, curvature: float, scale: np.ndarray | None = None, opened: Opened = _blocks) -> np.ndarray:
    """Accelerated proximal steps for all models (columns): one pass over the rows a step.

    Minimises the residuals' loss over ``total`` plus ``reg * (elastic * |w| + (1 - elastic) / 2 * w^2)``,
    intercept (last row) free.  ``square`` bounds a row's squared length and ``curvature`` the loss's
    second derivative, and so the step.  A model whose steps turn against its descent starts over; one that moves by
    no more than ``tolerance`` is done, so no model depends on how the others fare.
    """
    models = len(total)
    rate = 1.0 / (curvature * (square + 1.0) + reg * (1.0 - elastic))
    free = np.ones((size + 1, 1))
    free[-1] = 0.0
    weights = before = np.zeros((size + 1, models))
    age, moving = np.ones(models), np.ones(models, bool)
    for _ in range(steps):
        older, age = age, (1.0 + np.sqrt(1.0 + 4.0 * age * age)) / 2.0
        ahead = weights + (older - 1.0) / age * (weights - before)
        slope = gradients(blocks, residual, ahead, scale, opened) / total + reg * (1.0 - elastic) * free * ahead
        moved = ahead - rate * slope
        fresh = np.sign(moved) * np.maximum(np.abs(moved) - rate * reg * elastic * free, 0.0)
        before, weights = weights, np.where(moving, fresh, weights)
        age[((ahead - weights) * (weights - before)).sum(axis=0) > 0] = 1.0
        moving &= np.abs(weights - before).max(axis=0) > tolerance
        if not moving.any():
            break
    return weights


def fit_elastic(rows: DataFrame, folds: Seq[int], size: int, reg: float | None = 1e-3, elastic: float = 0.05, steps: int = 60,
                tolerance: float = 1e-4, square: float = 2.0, scale: np.ndarray | None = None) -> np.ndarray:
    """For each fold (column) the logistic model of the rows outside it; the last row is the intercept.

    ``rows(fold, label, buckets, values)``, buckets below ``size``, and ``weight`` where rows count
    otherwise than one.  ``reg`` None: one over the weight of the rows outside.
    """
    bounded(size, len(folds))
    ready = rows if "weight" in rows.columns else rows.withColumn("weight", F.lit(1.0))
    held = {r["fold"]: r["w"] for r in aggregate(ready, ["fold"], "sum(weight) AS w").collect()}
    blocks = packed(ready)
    weights = fit_folds(blocks, _blocks, held, folds, size, reg, elastic, steps, tolerance, square, scale)
    discard(blocks)
    return weights


def fit_folds(blocks: DataFrame, opened: Opened, held: dict[int, float], folds: Seq[int], size: int, reg: float | None = 1e-3, elastic: float = 0.05,
              steps: int = 60, tolerance: float = 1e-4, square: float = 2.0, scale: np.ndarray | None = None) -> np.ndarray:
    """``fit_elastic`` over ready blocks; ``held`` is the weight of each fold's rows."""
    bounded(size, len(folds))
    total = np.array([max(1e-9, sum(held.values()) - held.get(f, 0.0)) for f in folds], float)
    strength = 1.0 / total if reg is None else np.full(len(folds), reg)
    return descend(blocks, outside_folds(folds), total, size, strength, elastic, steps, tolerance, square, 0.25, scale, opened)


def fit_classes(rows: DataFrame, classes: int, size: int, reg: float, steps: int = 60, tolerance: float = 1e-3,
                square: float = 1.0, scale: np.ndarray | None = None) -> np.ndarray:
    """One ridge model of ``classes`` columns over ``rows(label, buckets, values)``; intercepts last."""
    bounded(size, classes)
    ready = rows.selectExpr("0 AS fold", "CAST(label AS DOUBLE) AS label", "1D AS weight", "buckets", "values")
    total = np.full(classes, float(max(1, ready.count())))
    blocks = packed(ready)
    weights = descend(blocks, of_classes, total, size, np.full(classes, reg), 0.0, steps, tolerance, square, 0.5, scale)
    discard(blocks)
    return weights


def score_elastic(rows: DataFrame, weights: np.ndarray, folds: Seq[int], name: str = "pred") -> DataFrame:
    """Each row's probability under the model that did not see its fold (rows of other folds: null)."""
    sent, place = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(weights.T)), {f: k for k, f in enumerate(folds)}
    kept = [c for c in rows.columns if c not in ("buckets", "values")]
    out = rows.select(*kept).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _sigmoid(_margins(Block(None, None, None, *_flat(batch)), sent.value, None)[0])
            own = [place.get(f) for f in batch.column("fold").to_pylist()]
            pred = pa.array([None if k is None else z[i, k] for i, k in enumerate(own)], pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pred], names=[*kept, name])

    return rows.mapInArrow(run, out)


def score_blocks(blocks: DataFrame, opened: Opened, weights: np.ndarray, folds: Seq[int], kept: T.StructType, name: str = "pred") -> DataFrame:
    """``score_elastic`` of the rows in blocks, whose columns ``kept`` a block tells as ``rows``; rows of other folds are left out."""
    sent, place = blocks.sparkSession.sparkContext.broadcast(np.ascontiguousarray(weights.T)), {f: k for k, f in enumerate(folds)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (b for batch in batches for b in opened(batch)):
            z = _sigmoid(block.margins(sent.value, None)[0])
            own = np.array([place.get(f, -1) for f in block.fold.tolist()])
            mine = np.flatnonzero(own >= 0)
            rows = block.rows.take(pa.array(mine))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(z[mine, own[mine]])], names=[*kept.names, name])

    return blocks.mapInArrow(run, T.StructType([*kept.fields, T.StructField(name, T.DoubleType())]))
