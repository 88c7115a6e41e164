"""Model training and scoring on Spark ML.

Fits loop over folds on the driver; rows stay distributed.  Frames that are read by several
fits are written to the reliable checkpoint folder once (``cut``), so neither an executor
loss nor the next fit replays the feature lineage.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (
    PCA, Imputer, ImputerModel, RobustScaler, StandardScaler, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import calibrated, clip_probability, lit, log_loss, logit, num, sigmoid
from ..functions.text import with_bigrams
from ..operators.boosting import Forest, Run, Trees, boost
from ..operators.compare import paired_delta, summarize
from ..operators.encoding import encoding_for, fold_sums, objective_sums
from ..operators.grams import PARTS, gram_blocks, gram_cells, opened_grams
from ..operators.isotonic import PER_TASK, interpolated, isotonic_blocks
from ..operators.metrics import probability_bin
from ..operators.moments import fold_components, projected
from ..operators.newton import fit_logistic
from ..operators.folds import deal, purged_training, session_folds
from ..operators.ordered import aggregate, small_side
from ..operators.sparse import fit_folds, score_blocks
from ..operators.vocabulary import TermModel, fit_class_terms, fit_fold_terms
from ..session import cut

Learner = Callable[[], object]


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def boosted_trees(iterations: int = 200, depth: int = 4, seed: int = 0, early_stop: bool = True) -> Learner:
    """Trees are added until the validation rows stop improving; ``iterations`` only bounds them."""
    def make():
        model = GBTClassifier(
            labelCol="label", featuresCol="features", maxIter=iterations, maxDepth=depth, seed=seed,
            subsamplingRate=0.8, stepSize=0.1, cacheNodeIds=False,
        )
        return model.setValidationIndicatorCol("is_validation") if early_stop else model
    return make


def logistic(reg: float = 1e-3, elastic: float = 0.0, iterations: int = 50, scale: bool = True) -> Learner:
    return lambda: LogisticRegression(
        labelCol="label", featuresCol="features", regParam=reg, elasticNetParam=elastic, maxIter=iterations,
        standardization=scale,
    )


def probability(scored: DataFrame, name: str = "pred") -> DataFrame:
    return scored.withColumn(name, vector_to_array("probability")[1])


def assembled(features: Sequence[str], pca: tuple[Sequence[str], int] | None = None) -> Pipeline:
    """Median-filled, assembled features; the fitted pipeline fixes the feature order.

    ``pca`` names further columns and how many of their principal components join the features.
    """
    filled = [f"_f_{c}" for c in features]
    stages, inputs = [Imputer(strategy="median", inputCols=list(features), outputCols=filled)], list(filled)
    if pca:
        stages += [
            VectorAssembler(inputCols=list(pca[0]), outputCol="_raw", handleInvalid="keep"),
            StandardScaler(inputCol="_raw", outputCol="_centred", withMean=True, withStd=False),
            PCA(inputCol="_centred", outputCol="_pca", k=pca[1]),
        ]
        inputs.append("_pca")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="features")])


@dataclass
class FoldModels:
    """One fitted model per fold, the feature order they expect, and what each knows of objectives."""

    features: tuple[str, ...]
    mode: str
    models: dict[int, PipelineModel]
    rates: dict[int, float]
    priors: DataFrame | None = None  # fold, objective_id, encoding
    texts: dict[int, TermModel] = field(default_factory=dict)

    def prepared(self, rows: DataFrame, fold: int) -> DataFrame:
        """Rows with the fold's own encoding and text difficulty, as its model was trained to see them."""
        rate = self.rates[fold]
        if self.priors is not None:
            known = small_side(self.priors.where(f"fold = {fold}").select("objective_id", "encoding"))
            rows = rows.join(known.withColumnRenamed("encoding", "_e"), "objective_id", "left").selectExpr(
                *rows.columns, f"coalesce(_e, {rate!r}D) AS {ENCODED}")
        return apply_text_difficulty(self.texts[fold], rate, rows) if self.texts else rows

    def score(self, rows: DataFrame, folds: Sequence[int] | None = None) -> DataFrame:
        """``response_id, model_fold, pred`` of every row under every fold model (or those named)."""
        missing = [c for c in self.features if c not in rows.columns and c not in (ENCODED, DIFFICULTY)]
        if missing:
            raise ValueError(f"features absent from the rows: {missing}")
        parts = [
            probability(self.models[f].transform(self.prepared(rows, f))).selectExpr("response_id", f"{f} AS model_fold", "pred")
            for f in (folds if folds is not None else self.models)
        ]
        return union(parts)

    def save(self, path: str) -> None:
        for fold, model in self.models.items():
            model.write().overwrite().save(f"{path}/model-{fold}")
        for fold, model in self.texts.items():
            model.save(f"{path}/text-{fold}")
        spark = SparkSession.active()
        if self.priors is not None:
            self.priors.write.mode("overwrite").parquet(f"{path}/priors")
        facts = {"features": list(self.features), "mode": self.mode, "rates": self.rates,
                 "priors": self.priors is not None, "texts": bool(self.texts)}
        spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FoldModels:
        """Read models back; refused if a model was assembled from other features or another order."""
        facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
        folds = [int(f) for f in facts["rates"]]
        models = {f: PipelineModel.load(f"{path}/model-{f}") for f in folds}
        for fold, model in models.items():
            order = [c for stage in model.stages if isinstance(stage, Imputer | ImputerModel) for c in stage.getInputCols()]
            if order != facts["features"]:
                raise ValueError(f"model of fold {fold} expects {order}, the list says {facts['features']}")
        return cls(
            tuple(facts["features"]), facts["mode"], models, {int(f): r for f, r in facts["rates"].items()},
            spark.read.parquet(f"{path}/priors") if facts["priors"] else None,
            {f: TermModel.load(spark, f"{path}/text-{f}") for f in folds} if facts["texts"] else {})


ENCODED, DIFFICULTY = "lo_prior_enc", "lo_text_difficulty"


def fit_fold_models(
    matrix: DataFrame, features: Sequence[str], learner: Learner, folds: Sequence[int], mode: str = "session",
    encode: bool = True, k: int = 5, pca: tuple[Sequence[str], int] | None = None, text: bool = False,
) -> tuple[FoldModels, DataFrame]:
    """Models of the named folds, and the validation rows' predictions.

    ``mode`` ``session`` trains on all other folds; ``objective`` leaves out rows that share a session
    or an objective with the held-out fold, and then an objective encoding is refused, because no
    objective of the validation rows was seen.  ``encode`` adds the leakage-safe encoding, ``pca``
    components fitted on the training rows, ``text`` a difficulty read off the objective's text
    (training rows out of objective-grouped folds).
    """
    if mode not in ("session", "objective"):
        raise ValueError(f"unknown split mode {mode!r}")
    if mode == "objective" and encode:
        raise ValueError("objective folds hold unseen objectives out: an objective encoding would be constant there")
    raw = list(pca[0]) if pca else []
    doubles = matrix.selectExpr(
        "response_id", "session_id", "objective_id", "fold", "CAST(label AS DOUBLE) AS label",
        *(["objective_text"] if text else []), *[f"CAST({c} AS DOUBLE) AS {c}" for c in dict.fromkeys([*features, *raw])],
    )
    # rows are ordered by id inside each part, so that subsampling draws the same rows in every run
    ready = cut(doubles.repartition("response_id").sortWithinPartitions("response_id"))
    columns = [*features, *([ENCODED] if encode else []), *([DIFFICULTY] if text else [])]
    priors = None
    if encode:
        sums = small_side(objective_sums(ready, "objective_id", "label"))
        overall = fold_sums(ready, "label").scalar()
        priors = cut(union([sums.withColumn("g", overall).selectExpr(
            f"{f} AS fold", "objective_id", f"{encoding_for(str(f), str(f))} AS encoding") for f in folds]))
        known = ready.join(sums, "objective_id").withColumn("g", overall)
    fitted, texts, rates, scored = {}, {}, {}, []
    allowed = cut(purged_training(ready, k).select("response_id", "train_fold")) if mode == "objective" else None
    for fold in folds:
        rows = ready
        if encode:
            rows = known.selectExpr(*ready.columns, f"{encoding_for(str(fold), 'CAST(fold AS INT)')} AS {ENCODED}")
        held, train = rows.where(f"fold = {fold}"), rows.where(f"fold <> {fold}")
        if allowed is not None:
            train = train.join(allowed.where(f"train_fold = {fold}").drop("train_fold"), "response_id")
        rates[fold] = float(aggregate(train, [], "avg(label) AS r").first()["r"])
        if text:
            difficulty = difficulty_models(train, inner=k)
            texts[fold] = difficulty[0]
            train, held = train_difficulty(train, difficulty), apply_text_difficulty(texts[fold], rates[fold], held)
        seen = cut(train.withColumn("is_validation", F.lit(False)).unionByName(held.withColumn("is_validation", F.lit(True))))
        shape = assembled(columns, pca).fit(seen.where("NOT is_validation"))
        vectors = shape.transform(seen).select("response_id", "session_id", "fold", "label", "is_validation", "features")
        estimator = learner()
        uses_validation = estimator.hasParam("validationIndicatorCol") and estimator.isSet("validationIndicatorCol")
        model = estimator.fit(vectors if uses_validation else vectors.where("NOT is_validation"))
        fitted[fold] = PipelineModel(stages=[*shape.stages, model])
        held_out = model.transform(vectors.where("is_validation"))
        scored.append(probability(held_out).select("response_id", "session_id", "fold", "label", "pred"))
    return FoldModels(tuple(columns), mode, fitted, rates, priors, texts), union(scored)


def gains(models: FoldModels) -> DataFrame | None:
    """``feature, fold, gain`` of tree models; principal components are numbered after the features."""
    rows = []
    for fold, model in models.models.items():
        last = model.stages[-1]
        if hasattr(last, "featureImportances"):
            values = last.featureImportances.toArray().tolist()
            names = [*models.features, *[f"pca_{i}" for i in range(len(values) - len(models.features))]]
            rows += [(c, int(fold), float(v)) for c, v in zip(names, values)]
    return SparkSession.active().createDataFrame(rows, "feature string, fold int, gain double") if rows else None


def out_of_fold(
    matrix: DataFrame, features: Sequence[str], learner: Learner, folds: Sequence[int],
    encode: bool = True, importance: bool = False, k: int = 5, mode: str = "session",
) -> tuple[DataFrame, DataFrame | None]:
    """Out-of-fold predictions ``response_id, session_id, fold, label, pred``, and gains when asked."""
    models, scored = fit_fold_models(matrix, features, learner, folds, mode, encode, k)
    return scored, gains(models) if importance else None


# --- text features ---------------------------------------------------------------------
# Accented Latin letters and their plain forms.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
TOKEN = r"[\p{L}\p{N}_]{2,}"  # words of two characters and more


def hashed_grams(texts: DataFrame, column: str = "text", buckets: int = 2**16) -> DataFrame:
    """``buckets, values``: word 1-2 grams and padded character 3-5 grams, each hashed and of unit length.

    Character grams take the second ``buckets`` numbers.  Rows move once, before they are taken apart; a
    word's character grams are hashed once for each batch of rows, and a row's grams are counted where it is.
    """
    words = f"split(_low, {lit(chr(92) + 's+')})"
    parts = word_numbers(texts, column, buckets).selectExpr(
        *texts.columns, "_numbers", f"transform(filter({words}, w -> w <> ''), w -> concat(' ', w, ' ')) AS _words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, rows, cells, values in gram_cells(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), buckets):
                yield pa.RecordBatch.from_arrays([*(c.slice(start, rows) for c in batch.columns[:-2]), cells, values],
                                                 names=[*batch.schema.names[:-2], "buckets", "values"])

    kinds = [T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))]
    return parts.mapInArrow(run, T.StructType([*texts.schema.fields, *kinds]))


def word_numbers(texts: DataFrame, column: str, buckets: int) -> DataFrame:
    """Rows, moved once, with the hashed word 1-2 grams (``_numbers``) and the text in lower case (``_low``)."""
    low = f"translate(lower({column}), '{ACCENTED}', '{PLAIN}')"
    tokens = f"regexp_extract_all({low}, {lit(TOKEN)}, 0)"
    spark = texts.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    placed = texts.repartition(tasks, "response_id").selectExpr("*", f"coalesce({tokens}, array()) AS _tokens")
    number = f"CAST(pmod(hash(g), {buckets}) AS INT)"
    return placed.selectExpr(*texts.columns, f"transform({with_bigrams('_tokens')}, g -> {number}) AS _numbers", f"coalesce(lower({column}), '') AS _low")


def packed_grams(texts: DataFrame, column: str, buckets: int, **limits: int) -> DataFrame:
    """Blocks of texts (``grams.PARTS``) with the grams of ``hashed_grams``, written once; the text itself is left out."""
    parts = word_numbers(texts, column, buckets).drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_arrays(batch.columns[:-2], names=batch.schema.names[:-2])
            yield from gram_blocks(rows, batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), buckets, **limits)

    kinds = "kinds string, " + ", ".join(f"{c} binary" for c in PARTS)
    # read in every pass, so in a form that is quick to read
    return cut(parts.mapInArrow(run, kinds), **{"compression": "snappy", "parquet.block.row.count.limit": "2"})


def text_out_of_fold(texts: DataFrame, folds: Sequence[int], column: str = "text", reg: float = 1e-3, elastic: float = 0.05,
                     steps: int = 60, buckets: int = 2**16) -> DataFrame:
    """Hashed text model of every fold, fitted together; each row is scored by the model that did not see its fold."""
    rows = texts.select("response_id", "session_id", "fold", "label", column)
    blocks = packed_grams(rows, column, buckets)
    held = {r["fold"]: r["n"] for r in aggregate(rows, ["fold"], "count(1) AS n").collect()}
    read = blocks.drop("rows").selectExpr("*", "CAST(NULL AS BINARY) AS rows")
    weights = fit_folds(read, opened_grams(buckets), held, folds, 2 * buckets, reg, elastic, steps)
    return score_blocks(blocks, opened_grams(buckets, True), weights, folds, rows.drop(column).schema)


def word_grams(texts: DataFrame, column: str, name: str = "grams") -> DataFrame:
    low = f"translate(lower(coalesce({column}, '')), '{ACCENTED}', '{PLAIN}')"
    tokens = f"regexp_extract_all({low}, {lit(TOKEN)}, 0)"
    return texts.selectExpr("*", f"{tokens} AS _t").selectExpr(*texts.columns, f"{with_bigrams('_t')} AS {name}")


def said(turns: DataFrame) -> DataFrame:
    """Turns with their role-prefixed text's digest (``_said``) and grams; equal texts share a digest."""
    return word_grams(turns.selectExpr("*", "concat(coalesce(role, ''), ' || ', coalesce(content, '')) AS _text").selectExpr("*", "md5(_text) AS _said"), "_text").drop("_text")


def fit_move_classifier(turns: DataFrame, least_docs: float = 2) -> TermModel:
    """Role-prefixed text to move: one model serves both role vocabularies.  Every turn counts once."""
    rows = said(turns.selectExpr("role", "content", "move")).drop("_said").withColumn("_key", F.expr("uuid()"))
    return fit_class_terms(cut(rows.select("_key", "move", "grams")), "_key", "move", least_docs=least_docs)


def predict_moves(model: TermModel, turns: DataFrame) -> DataFrame:
    """The predicted move of every utterance; a text is scored once, however often it is said."""
    rows = said(turns)
    distinct = rows.select("_said", "grams").dropDuplicates(["_said"])
    names = "array(" + ", ".join(lit(n) for n in model.names) + ")"
    best = model.margins(distinct, "_said").selectExpr("_said", f"get({names}, array_position(z, array_max(z)) - 1) AS predicted_move")
    return rows.drop("grams").join(best, "_said", "left").drop("_said")


def classification_report(scored: DataFrame, label: str = "move", predicted: str = "predicted_move") -> DataFrame:
    """Precision, recall, F1 and support per class plus accuracy and macro F1 rows."""
    cells = aggregate(scored, [label, predicted], "count(1) AS n")
    per_true = aggregate(cells, [label], f"sum(n) AS support", f"sum(CASE WHEN {label} <=> {predicted} THEN n ELSE 0 END) AS hit")
    per_pred = aggregate(cells, [predicted], "sum(n) AS guessed").withColumnRenamed(predicted, label)
    joined = per_true.join(per_pred, label, "full_outer").fillna(0, subset=["support", "hit", "guessed"])
    classes = joined.selectExpr(
        f"{label} AS class", "support",
        "CASE WHEN guessed = 0 THEN 0D ELSE hit / guessed END AS precision",
        "CASE WHEN support = 0 THEN 0D ELSE hit / support END AS recall", "hit",
    ).selectExpr("*", "CASE WHEN precision + recall = 0 THEN 0D ELSE 2 * precision * recall / (precision + recall) END AS f1")
    overall = aggregate(
        classes, [], "'(all)' AS class", "sum(support) AS support", "avg(precision) AS precision",
        "sum(hit) / sum(support) AS recall", "avg(f1) AS f1",
    )
    return classes.select("class", "support", "precision", "recall", "f1").unionByName(
        overall.select("class", "support", "precision", "recall", "f1")
    )


# --- objective text difficulty ---------------------------------------------------------
def two_class_rows(responses: DataFrame, order: str, key: str = "objective_id",
                   text: str = "objective_text", label: str = "label") -> DataFrame:
    """Each objective once per outcome, weighted by how often it was seen.

    Regressing a rate as a weighted two-class problem: ``n * rate`` positive weight and
    ``n * (1 - rate)`` negative weight; zero weights are left out.
    """
    per = aggregate(
        responses, [key], f"min_by({text}, {order}) AS {text}", f"avg({label}) AS rate", "count(1) AS n"
    )
    return per.selectExpr(
        key, text, "stack(2, 1L, n * rate, 0L, n * (1D - rate)) AS (y, weight)"
    ).where("weight > 0")


INNER_ALL = -1  # the fold that leaves nothing out


def fit_text_difficulty(responses: DataFrame, order: str = "response_id", inner: DataFrame | None = None,
                        folds: Sequence[int] = ()) -> tuple[TermModel, float]:
    """Objective description to difficulty: models and the base rate used for blank texts.

    The first model knows all objectives; ``inner(objective_id, fold)`` adds one for each of ``folds``
    that does not know the fold's objectives.  All are fitted together.
    """
    facts = aggregate(responses, [], "avg(label) AS rate").first()
    rows = two_class_rows(responses, order)
    placed = rows.withColumn("fold", F.lit(0)) if inner is None else rows.join(inner, "objective_id")
    held = {r["fold"]: r["n"] for r in aggregate(placed.select("objective_id", "fold").distinct(), ["fold"], "count(1) AS n").collect()}
    every = [INNER_ALL, *folds]
    least = [min(2, max(1, (sum(held.values()) - held.get(f, 0)) // 10)) for f in every]
    texts = word_grams(placed.selectExpr("concat_ws('|', y, objective_id) AS _key", "fold", "y AS label", "weight", "objective_text"), "objective_text")
    return fit_fold_terms(texts.drop("objective_text"), "_key", every, least), float(facts["rate"])


def apply_text_difficulty(model: TermModel, base_rate: float, rows: DataFrame, name: str = "lo_text_difficulty",
                          inner: str = str(INNER_ALL)) -> DataFrame:
    """Scored per distinct objective text, then joined back; ``inner`` is SQL for the model's name."""
    texts = rows.selectExpr("objective_text", "md5(objective_text) AS _text").where("_text IS NOT NULL").dropDuplicates(["_text"])
    scored = model.margins(word_grams(texts, "objective_text"), "_text")
    names = "array(" + ", ".join(lit(n) for n in model.names) + ")"
    joined = rows.selectExpr("*", "md5(objective_text) AS _text").join(scored, "_text", "left")
    z = f"get(z, CAST(array_position({names}, CAST({inner} AS STRING)) - 1 AS INT))"
    blank = "trim(coalesce(objective_text, '')) = ''"
    return joined.selectExpr(*rows.columns, f"CASE WHEN {blank} OR {z} IS NULL THEN {base_rate!r}D ELSE {sigmoid(z)} END AS {name}")


def difficulty_models(train: DataFrame, seed: int = 0, inner: int = 5) -> tuple[TermModel, float, DataFrame | None]:
    """The models of ``fit_text_difficulty`` and the inner folds of objectives.

    With fewer than ``2 * inner`` training objectives there are no inner folds.
    """
    groups = aggregate(train, ["objective_id"], "count(1) AS n")
    if groups.count() < 2 * inner:
        return *fit_text_difficulty(train), None
    folds = cut(deal(groups, (), inner, seed, "objective_id").selectExpr("objective_id", "CAST(fold AS INT) AS fold"))
    return *fit_text_difficulty(train, inner=folds, folds=range(inner)), folds


def train_difficulty(train: DataFrame, models: tuple[TermModel, float, DataFrame | None], name: str = "lo_text_difficulty") -> DataFrame:
    """Training rows, each scored by the model that does not know its objective; without inner folds the base rate."""
    model, rate, folds = models
    if folds is None:
        return train.withColumn(name, F.lit(rate))
    placed = train.join(folds.withColumnRenamed("fold", "_inner"), "objective_id", "left")
    return apply_text_difficulty(model, rate, placed, name, "_inner").select(*train.columns, name)


def text_difficulty(train: DataFrame, valid: DataFrame, seed: int = 0, inner: int = 5) -> DataFrame:
    """Validation rows from the training model, training rows out of objective-grouped folds."""
    models = difficulty_models(train, seed, inner)
    whole = apply_text_difficulty(models[0], models[1], valid)
    return whole.unionByName(train_difficulty(train, models).select(*whole.columns))


# --- fold-safe PCA and domains ---------------------------------------------------------
def pca_by_fold(rows: DataFrame, columns: Sequence[str], folds: Sequence[int], components: int, prefix: str = "cont_") -> DataFrame:
    """Every row under every fold's own components: ``model_fold`` names the fold held out.

    Components come from the training rows of each fold, all folds from one pass over the rows.
    """
    return projected(rows, columns, fold_components(rows, columns, components), folds, prefix)


def fold_safe_pca(rows: DataFrame, columns: Sequence[str], fold: int, components: int, prefix: str = "cont_") -> DataFrame:
    """Principal components fitted on the fold's training rows, applied to all rows."""
    return pca_by_fold(rows, columns, [fold], components, prefix).drop("model_fold")


def session_domains(sessions: DataFrame, features: Sequence[str], domains: int = 20, seed: int = 0) -> DataFrame:
    """``session_id, domain_id``: median fill, 10-90 robust scaling, k-means."""
    doubles = cut(sessions.selectExpr("session_id", *[f"CAST({c} AS DOUBLE) AS {c}" for c in features]))
    filled = [f"_f_{c}" for c in features]
    model = Pipeline(stages=[
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
        RobustScaler(inputCol="_raw", outputCol="features", lower=0.1, upper=0.9, withCentering=True),
        KMeans(k=domains, seed=seed, maxIter=20),
    ]).fit(doubles)
    return model.transform(doubles).selectExpr("session_id", "CAST(prediction AS BIGINT) AS domain_id")


def domain_folds(responses: DataFrame, domains: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """Whole domains per fold, largest first."""
    rows = responses.join(domains, "session_id")
    sizes = aggregate(rows, ["domain_id"], "count(1) AS n", "sum(label) AS n_pos")
    return rows.join(deal(sizes, ("n", "n_pos"), k, seed, "domain_id").select("domain_id", "fold"), "domain_id")


# --- calibration -----------------------------------------------------------------------
def score_cells(oof: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Rows and positives of every (fold, distinct prediction): all that calibration needs to know."""
    return aggregate(oof.selectExpr("fold", f"CAST({pred} AS DOUBLE) AS pred", f"CAST({label} AS DOUBLE) AS y").where("pred IS NOT NULL"),
                     ["fold", "pred"], "count(1) AS n", "sum(y) AS n_pos")


def fit_platt(cells: DataFrame, runs: dict[str, str]) -> dict[str, dict]:
    """Logistic regression on logit(p), all but unregularised: plain numbers for every run."""
    fitted = fit_logistic(cells.selectExpr("*", f"{logit('pred')} AS z"), runs, ["z"], "(n_pos / n)", "CAST(n AS DOUBLE)")
    return {name: {"method": "platt", "coef": float(c[0]), "intercept": float(c[1])} for name, c in fitted.items()}


def fit_isotonic(cells: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """Isotonic blocks by ``key``: those without fold ``key``, and of all rows under key -1."""
    folds = aggregate(cells, [], "collect_set(fold) AS all").scalar()
    points = cells.withColumn("_all", folds).selectExpr(
        "explode(concat(array(-1L), transform(filter(_all, k -> k <> fold), k -> CAST(k AS BIGINT)))) AS key",
        "pred AS x", "n_pos / n AS y", "CAST(n AS DOUBLE) AS weight")
    return isotonic_blocks(points, per_task)


def apply_isotonic(rows: DataFrame, blocks: DataFrame, pred: str = "pred", name: str = "calibrated") -> DataFrame:
    """``rows`` with the fit of all rows; looked up once for each distinct prediction."""
    asked = rows.select(F.col(pred).cast("double").alias("_p")).distinct().selectExpr("-1L AS key", "_p")
    known = interpolated(asked, blocks.where("key = -1"), "_p", "_fit").drop("key")
    return rows.join(known, F.col(pred).cast("double") == F.col("_p"), "left").selectExpr(
        *rows.columns, f"least(1D, greatest(0D, _fit)) AS {name}")


def calibration_losses(oof: DataFrame, folds: Sequence[int], per_task: int = PER_TASK) -> DataFrame:
    """Cross-fitted log loss and calibration error of each method: ``method, logloss, ece, n``.

    A fold is scored by the fit of the others.  Platt fits of all folds share each Newton pass, isotonic
    fits share each pooling pass; rows are read once, for the distinct predictions of each fold.
    """
    cells = cut(score_cells(oof.where(f"fold IN ({', '.join(map(str, folds))})")))
    platt = fit_platt(cells, {str(f): f"fold <> {f}" for f in folds})
    by_fold = " ".join(f"WHEN {f} THEN {calibrated('pred', platt[str(f)])}" for f in folds)
    isotonic = interpolated(cells.withColumn("key", F.col("fold").cast("long")), fit_isotonic(cells, per_task), "pred", "p")
    scored = union([
        cells.selectExpr("'none' AS method", "n", "n_pos", "pred AS p"),
        cells.selectExpr("'platt' AS method", "n", "n_pos", f"CASE fold {by_fold} END AS p"),
        isotonic.selectExpr("'isotonic' AS method", "n", "n_pos", "p"),
    ]).selectExpr("method", "n", "n_pos", f"{clip_probability('p')} AS p")
    bins = aggregate(scored.selectExpr("*", f"{probability_bin('p')} AS bin"), ["method", "bin"],
                     f"sum(n * {log_loss('n_pos / n', 'p')}) AS loss", "abs(sum(n * p) - sum(n_pos)) AS gap", "sum(n) AS n")
    return aggregate(bins, ["method"], "sum(loss) / sum(n) AS logloss", "sum(gap) / sum(n) AS ece", "sum(n) AS n")


def choose_calibrator(oof: DataFrame, folds: Sequence[int]) -> tuple[dict, DataFrame]:
    """The method with least cross-fitted loss, refitted on all rows, and the losses.

    A Platt fit is two numbers; an isotonic fit stays a table (``blocks``).
    """
    losses = calibration_losses(oof, folds)
    best = losses.orderBy("logloss", "method").first()["method"]
    cells = score_cells(oof)
    if best == "platt":
        return fit_platt(cut(cells), {"all": "true"})["all"], losses
    if best == "isotonic":
        return {"method": "isotonic", "blocks": fit_isotonic(cut(cells))}, losses
    return {"method": "none"}, losses


def with_calibration(rows: DataFrame, calibrator: dict, pred: str = "pred", name: str = "calibrated") -> DataFrame:
    """``rows`` with their calibrated prediction, from plain numbers or from a table of blocks."""
    if "blocks" in calibrator:
        return apply_isotonic(rows, calibrator["blocks"], pred, name)
    return rows.selectExpr(*rows.columns, f"{calibrated(pred, calibrator)} AS {name}")


# --- repeated evaluation ---------------------------------------------------------------
def run_loss(oof: DataFrame, name: str, seed: int) -> DataFrame:
    return aggregate(oof, [], f"'{name}' AS name", f"{seed}L AS seed", f"avg({log_loss('label', 'pred')}) AS value")


def repeated_scores(matrix: DataFrame, variants: dict[str, Sequence[str]], learner: Learner,
                    seeds: Sequence[int], k: int = 5, encode: bool = False) -> DataFrame:
    """Log loss of each feature set under each fold assignment: ``name, seed, value``."""
    base = cut(matrix)
    runs = []
    for seed in seeds:
        folds = cut(session_folds(base, k, seed))
        for name, features in variants.items():
            oof, _ = out_of_fold(folds, features, learner, range(k), encode, k=k)
            runs.append(run_loss(oof, name, seed))
    return union(runs)


def ablation(matrix: DataFrame, blocks: dict[str, Sequence[str]], learner: Learner,
             seeds: Sequence[int], k: int = 5) -> DataFrame:
    """Paired leave-one-block-out: positive means the removed block was contributing."""
    everything = [c for cols in blocks.values() for c in cols]
    variants = {"full": everything} | {
        f"without_{b}": [c for c in everything if c not in cols] for b, cols in blocks.items()
    }
    runs = cut(repeated_scores(matrix, variants, learner, seeds, k))
    return summarize(paired_delta(runs, "full"))


def unseen_stress_test(matrix: DataFrame, features: Sequence[str], learner: Learner, draws: int = 5,
                       fraction: float = 0.25) -> DataFrame:
    """Model against prior on objectives absent from training, over several draws."""
    from ..operators.folds import unseen_split

    base = cut(matrix)
    runs = []
    for draw in range(draws):
        split = cut(unseen_split(base, fraction, seed=draw).where("side = 'train' OR scored"))
        shape = assembled(features).fit(split.where("side = 'train'"))
        vectors = shape.transform(split)
        model = learner().fit(vectors.where("side = 'train'"))
        held = probability(model.transform(vectors.where("side <> 'train'"))).select("label", "pred")
        rate = aggregate(split.where("side = 'train'"), [], "avg(label) AS r").scalar()
        prior = held.withColumn("pred", rate)
        runs += [run_loss(held, "model", draw), run_loss(prior, "prior", draw)]
    return _with_gain(cut(union(runs)))


def _with_gain(runs: DataFrame) -> DataFrame:
    return summarize(runs.unionByName(paired_delta(runs, "prior").withColumn("name", F.lit("gain"))))


# --- trees of all runs in shared passes ------------------------------------------------
def tree_out_of_fold(folds: DataFrame, features: Sequence[str], k: int = 5, how: Trees = Trees(),
                     encode: bool = True) -> tuple[DataFrame, Forest]:
    """``response_id, fold, label, pred`` of held-out rows and the forest; all folds grow together.

    Each fold's model reads an objective encoding of its own, as in ``fit_fold_models``.
    """
    rows = folds
    if encode:
        known = folds.join(small_side(objective_sums(folds, "objective_id", "label")), "objective_id")
        known = known.withColumn("g", fold_sums(folds, "label").scalar())
        rows = known.selectExpr(*folds.columns, *[f"{encoding_for(str(f), 'CAST(fold AS INT)')} AS {ENCODED}_{f}" for f in range(k)])
    runs = [Run(str(f), "fold", f, (*features, *([f"{ENCODED}_{f}"] if encode else []))) for f in range(k)]
    out, forest = boost(cut(rows), "response_id", runs, how)
    return out.selectExpr("response_id", "CAST(run AS INT) AS fold", "label", "pred"), forest


def tree_gains(forest: Forest) -> DataFrame:
    """``feature, fold, gain`` of the kept trees; the encodings of all folds are one feature."""
    rows = [(ENCODED if c.startswith(ENCODED) else c, int(run), gain) for run, c, gain, _ in forest.gains()]
    return SparkSession.active().createDataFrame(rows, "feature string, fold int, gain double")


def tree_ablation(matrix: DataFrame, blocks: dict[str, Sequence[str]], seeds: Sequence[int], k: int = 5, how: Trees = Trees()) -> DataFrame:
    """``ablation`` with every variant, seed and fold as a run of one training job."""
    everything = [c for cols in blocks.values() for c in cols]
    variants = {"full": everything} | {f"without_{b}": [c for c in everything if c not in cols] for b, cols in blocks.items()}
    rows = cut(matrix)
    for seed in seeds:
        rows = session_folds(rows, k, seed).withColumnRenamed("fold", f"fold_{seed}")
    runs = [Run(f"{v}|{seed}", f"fold_{seed}", f, tuple(columns)) for v, columns in variants.items() for seed in seeds for f in range(k)]
    out, _ = boost(cut(rows), "response_id", runs, how)
    losses = aggregate(out, ["run"], f"avg({log_loss('label', 'pred')}) AS value").selectExpr(
        "substring_index(run, '|', 1) AS name", "CAST(substring_index(run, '|', -1) AS BIGINT) AS seed", "value")
    return summarize(paired_delta(cut(losses), "full"))


def tree_stress_test(matrix: DataFrame, features: Sequence[str], draws: int = 5, fraction: float = 0.25,
                     how: Trees = Trees(rounds=25, rate=0.2, patience=None)) -> DataFrame:
    """``unseen_stress_test`` with trees, every draw a run of one training job.

    The number of trees is fixed: rows of unseen objectives judge the model and may not choose it.
    """
    from ..operators.folds import unseen_split

    rows, columns = cut(matrix), matrix.columns
    for draw in range(draws):
        rows = unseen_split(rows, fraction, seed=draw).selectExpr(
            *columns, f"CASE WHEN side = 'train' THEN 1 WHEN scored THEN 0 ELSE -1 END AS draw_{draw}")
        columns = rows.columns
    out, forest = boost(cut(rows), "response_id", [Run(str(d), f"draw_{d}", 0, tuple(features)) for d in range(draws)], how)
    prior = " ".join(f"WHEN '{d}' THEN {num(1 / (1 + np.exp(-b)))}" for d, b in enumerate(forest.base))
    both = aggregate(out, ["run"], f"avg({log_loss('label', 'pred')}) AS model", f"avg({log_loss('label', f'CASE run {prior} END')}) AS prior")
    return _with_gain(cut(both.selectExpr("CAST(run AS BIGINT) AS seed", "stack(2, 'model', model, 'prior', prior) AS (name, value)").select("name", "seed", "value")))
