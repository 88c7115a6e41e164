"""Exact term weights over a bounded vocabulary, and the linear models that read them.

The vocabulary is the ``MOST_TERMS`` most frequent terms (ties in code-point order), numbered in
code-point order; a term's weight in a text is ``1 + ln(count)`` times ``ln((1 + n) / (1 + df)) + 1``,
and a text has unit length.  A model is a table of terms, so scoring is a join on the term.
"""

from __future__ import annotations

import json
from collections.abc import Sequence as Seq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .ordered import aggregate, small_side
from .sparse import fit_classes, fit_elastic

MOST_TERMS = 200_000


def term_counts(texts: DataFrame, keys: Seq[str], terms: str = "grams") -> DataFrame:
    """``keys, term, tf``: how often each text holds each term of its array ``terms``."""
    return aggregate(texts.selectExpr(*keys, f"explode({terms}) AS term"), [*keys, "term"], "count(1) AS tf")


def dictionary(counts: DataFrame, least_docs: float = 1, most: int = MOST_TERMS, by: dict[str, str] | None = None) -> DataFrame:
    """``term, id, df, n``: terms in at least ``least_docs`` texts, the ``most`` frequent ones.

    ``by`` names further counts of texts (name: predicate).  At most ``most`` rows, which one task
    ranks and numbers.
    """
    extra = {name: f"count_if({where}) AS {name}" for name, where in (by or {}).items()}
    per = aggregate(counts, ["term"], "count(1) AS df", "sum(tf) AS n", *extra.values()).where(f"df >= {least_docs}")
    top = per.orderBy(F.desc("n"), "term").limit(most)
    return top.selectExpr("term", "row_number() OVER (ORDER BY term) - 1 AS id", "df", "n", *extra)


def term_weights(counts: DataFrame, terms: DataFrame, n_texts: int, keys: Seq[str]) -> DataFrame:
    """``keys, term, weight`` of every text that holds a term of the dictionary."""
    raw = counts.join(small_side(terms.select("term", "df")), "term").selectExpr(
        *keys, "term", f"(1D + ln(tf)) * (ln((1D + {n_texts}) / (1D + df)) + 1D) AS w")
    lengths = aggregate(raw, keys, "sqrt(sum(w * w)) AS _length")
    return raw.join(lengths, list(keys)).selectExpr(*keys, "term", "w / _length AS weight")


def sparse_rows(texts: DataFrame, counts: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """``texts`` with ``buckets`` (term numbers) and ``values`` (1 + ln count)."""
    cells = counts.join(small_side(terms.selectExpr("term", "CAST(id AS INT) AS _id")), "term").selectExpr(key, "_id", "1D + ln(tf) AS _v")
    rows = aggregate(cells, [key], "sort_array(collect_list(struct(_id, _v))) AS _cells")
    return texts.join(rows, key, "left").selectExpr(
        *texts.columns, "coalesce(transform(_cells, x -> x._id), CAST(array() AS array<int>)) AS buckets",
        "coalesce(transform(_cells, x -> x._v), CAST(array() AS array<double>)) AS values")


@dataclass
class TermModel:
    """``terms(term, scale array, w array)``, an intercept for each model, and the models' names."""

    terms: DataFrame
    intercepts: list[float]
    names: list[str]

    def margins(self, texts: DataFrame, key: str, terms: str = "grams") -> DataFrame:
        """``key, z array``: every model's linear predictor; the intercept where no term is known."""
        known = term_counts(texts, [key], terms).join(small_side(self.terms), "term")
        each = range(len(self.names))
        sums = aggregate(known.selectExpr(key, "1D + ln(tf) AS v", "scale", "w"), [key],
                         *[f"sum(v * scale[{k}] * w[{k}]) AS d{k}" for k in each],
                         *[f"sqrt(sum(v * scale[{k}] * v * scale[{k}])) AS l{k}" for k in each])
        z = ", ".join(f"coalesce(CASE WHEN l{k} > 0 THEN d{k} / l{k} END, 0D) + {b!r}D" for k, b in enumerate(self.intercepts))
        return texts.select(key).distinct().join(sums, key, "left").selectExpr(key, f"array({z}) AS z")

    def save(self, path: str) -> None:
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        facts = json.dumps({"intercepts": self.intercepts, "names": self.names})
        SparkSession.active().createDataFrame([(facts,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TermModel:
        facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
        return cls(spark.read.parquet(f"{path}/terms"), facts["intercepts"], facts["names"])


def _as_model(spark: SparkSession, terms: list, scale: np.ndarray, weights: np.ndarray, names: Seq[str]) -> TermModel:
    """The table of a fitted model; at most ``MOST_TERMS`` rows, so it may pass the driver."""
    rows = [(t, s, w) for t, s, w in zip(terms, scale.tolist(), weights[:-1].tolist(), strict=True)]
    table = cut(spark.createDataFrame(rows, "term string, scale array<double>, w array<double>"))
    return TermModel(table, [float(b) for b in weights[-1]], list(names))


def fit_class_terms(texts: DataFrame, key: str, label: str, terms: str = "grams", c: float = 4.0, least_docs: float = 2,
                    steps: int = 60) -> TermModel:
    """One model for all values of ``label``; ``c`` is the weight of the loss against the ridge."""
    ready = cut(texts.selectExpr(key, f"{label} AS _class", terms))
    names = sorted(r[0] for r in ready.select("_class").distinct().collect())
    n = ready.count()
    counts = cut(term_counts(ready, [key], terms))
    found = cut(dictionary(counts, least_docs))
    listed = found.orderBy("id").toArrow()
    scale = np.log((1.0 + n) / (1.0 + listed.column("df").to_numpy())) + 1.0
    numbers = F.create_map(*[x for i, v in enumerate(names) for x in (F.lit(v), F.lit(float(i)))])
    rows = cut(sparse_rows(ready.select(key, numbers[F.col("_class")].alias("label")), counts, found, key).select("label", "buckets", "values"))
    scales = np.repeat(scale[:, None], len(names), axis=1)
    weights = fit_classes(rows, len(names), len(scale), 1.0 / (c * max(1, n)), steps, scale=scales)
    return _as_model(texts.sparkSession, listed.column("term").to_pylist(), scales, weights, names)


def fit_fold_terms(texts: DataFrame, key: str, folds: Seq[int], least_docs: Seq[float], terms: str = "grams", steps: int = 60,
                   tolerance: float = 1e-3) -> TermModel:
    """A logistic model for each fold of ``texts(key, fold, label, weight, terms)``, all in one fit.

    Each fold's weights of terms and its least number of texts (``least_docs``) count only the texts
    outside it.  A fold that holds no text leaves nothing out.
    """
    ready = cut(texts.selectExpr(key, "CAST(fold AS INT) AS fold", "CAST(label AS DOUBLE) AS label", "CAST(weight AS DOUBLE) AS weight", terms))
    sizes = {r["fold"]: r["n"] for r in aggregate(ready, ["fold"], "count(1) AS n").collect()}
    counts = cut(term_counts(ready, [key, "fold"], terms))
    found = cut(dictionary(counts, 1, by={f"d{k}": f"fold <> {f}" for k, f in enumerate(folds)}))
    listed = found.orderBy("id").toArrow()
    scale = np.zeros((listed.num_rows, len(folds)))
    for k, f in enumerate(folds):
        df, n = listed.column(f"d{k}").to_numpy(), sum(sizes.values()) - sizes.get(f, 0)
        scale[:, k] = np.where(df >= least_docs[k], np.log((1.0 + n) / (1.0 + df)) + 1.0, 0.0)
    rows = sparse_rows(ready.select(key, "fold", "label", "weight"), counts.drop("fold"), found, key)
    rows = cut(rows.select("fold", "label", "weight", "buckets", "values"))
    weights = fit_elastic(rows, folds, len(scale), None, 0.0, steps, tolerance, 1.0, scale)
    return _as_model(texts.sparkSession, listed.column("term").to_pylist(), scale, weights, [str(f) for f in folds])
