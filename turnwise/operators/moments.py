"""Covariances and principal components of every fold's training rows, from one pass.

Each fold's counts, sums and products are summed once; what a fold may train on is the total minus the
fold.  Values are shifted by one row's values first, so the subtraction keeps its digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from collections.abc import Sequence as Seq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .ordered import aggregate


def _matrix(batch: pa.RecordBatch, columns: Seq[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)


def fold_moments(rows: DataFrame, columns: Seq[str], shift: np.ndarray) -> DataFrame:
    """``fold, i, j, s``: sums of products of shifted columns i <= j; i = -1 stands for the constant 1."""
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x, fold = _matrix(batch, names) - shift, batch.column("fold").to_numpy()
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            for f in np.unique(fold).tolist():
                own = x[fold == f]
                sums[f] = sums.get(f, 0.0) + own.T @ own
        for f, s in sums.items():
            i, j = np.triu_indices(len(s))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), f)), pa.array(i - 1), pa.array(j - 1), pa.array(s[i, j])],
                                             names=["fold", "i", "j", "s"])

    picked = rows.selectExpr("CAST(fold AS BIGINT) AS fold", *[f"CAST({c} AS DOUBLE) AS {c}" for c in names])
    return aggregate(picked.mapInArrow(run, "fold long, i long, j long, s double"), ["fold", "i", "j"], "sum(s) AS s")


def fold_covariance(rows: DataFrame, columns: Seq[str], shift: np.ndarray | None = None) -> DataFrame:
    """``model_fold, n, i, j, mean_i, mean_j, covariance`` (i <= j) of the rows outside each fold.

    ``rows(fold, ...)`` without nulls in ``columns``; an empty complement gives null.
    """
    shift = _shift(rows, columns) if shift is None else shift
    sums = fold_moments(rows, columns, shift)
    total = aggregate(sums, ["i", "j"], "sum(s) AS t")
    rest = sums.join(total, ["i", "j"]).selectExpr("fold AS model_fold", "i", "j", "t - s AS r")
    counts = rest.where("i = -1 AND j = -1").selectExpr("model_fold", "r AS n")
    means = rest.where("i = -1 AND j >= 0").selectExpr("model_fold", "j AS c", "r AS m")
    products = rest.where("i >= 0").join(counts, "model_fold")
    both = products.join(means.selectExpr("model_fold", "c AS i", "m AS mi"), ["model_fold", "i"]).join(
        means.selectExpr("model_fold", "c AS j", "m AS mj"), ["model_fold", "j"])
    back = "element_at(array(" + ", ".join(f"{float(v)!r}D" for v in shift) + "), CAST({} AS INT) + 1)"
    return both.selectExpr(
        "model_fold", "CAST(n AS BIGINT) AS n", "i", "j", f"mi / nullif(n, 0) + {back.format('i')} AS mean_i",
        f"mj / nullif(n, 0) + {back.format('j')} AS mean_j", "(r - mi * mj / nullif(n, 0)) / nullif(n - 1, 0) AS covariance")


def _shift(rows: DataFrame, columns: Seq[str]) -> np.ndarray:
    first = rows.selectExpr(*[f"CAST({c} AS DOUBLE) AS {c}" for c in columns]).first()
    return np.zeros(len(columns)) if first is None else np.array([first[c] or 0.0 for c in columns])


def fold_components(rows: DataFrame, columns: Seq[str], components: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each fold the mean, the leading components (columns) and their variances outside it.

    Of a component's two signs the one is taken whose largest entry is positive.  Columns x columns
    numbers for each fold reach the driver, whatever the rows.
    """
    d, out = len(columns), {}
    found = fold_covariance(rows, columns).toArrow()
    cells = {c: found.column(c).to_numpy() for c in ("model_fold", "i", "j", "mean_i", "covariance")}
    for f in np.unique(cells["model_fold"]).tolist():
        own = cells["model_fold"] == f
        i, j = cells["i"][own], cells["j"][own]
        matrix, mean = np.zeros((d, d)), np.zeros(d)
        matrix[i, j] = matrix[j, i] = cells["covariance"][own]
        mean[i] = cells["mean_i"][own]
        values, vectors = np.linalg.eigh(matrix)
        vectors = vectors[:, ::-1][:, :components]
        lead = np.abs(vectors).argmax(axis=0)
        out[f] = mean, vectors * np.sign(vectors[lead, np.arange(vectors.shape[1])]), values[::-1][:components]
    return out


def projected(rows: DataFrame, columns: Seq[str], found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], folds: Seq[int],
              prefix: str) -> DataFrame:
    """Every row under the components of each of ``folds``: ``model_fold`` and one column a component."""
    kept, names = [c for c in rows.columns if c not in columns], list(columns)
    size = next(iter(found.values()))[1].shape[1]
    schema = T.StructType([*rows.select(*kept).schema.fields, T.StructField("model_fold", T.IntegerType()),
                           *[T.StructField(f"{prefix}{k:02d}", T.DoubleType()) for k in range(size)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, names)
            for f in folds:
                mean, vectors, _ = found[f]
                scores = (x - mean) @ vectors
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in kept], pa.array(np.full(len(x), f, np.int32)), *[pa.array(scores[:, k]) for k in range(size)]],
                    names=schema.fieldNames())

    picked = rows.select(*kept, *names)
    return picked.mapInArrow(run, schema)
