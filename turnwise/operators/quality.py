"""Gates on produced predictions: one result row per rule."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.scalars import log_loss, num
from .ordered import aggregate
from .stats import auc

COIN_FLIP = 0.6931  # fixed value: log loss of a constant one half
MAX_KNOWN_LOSS = 0.60  # fixed value
MIN_KNOWN_AUC = 0.70  # fixed value
MEAN_BAND = 0.10  # fixed value


def rules(facts: DataFrame, tests: dict[str, str]) -> DataFrame:
    """``rule, passed`` rows from a one-row table of facts."""
    pairs = ", ".join(f"'{name}', coalesce({test}, false)" for name, test in tests.items())
    return facts.selectExpr(f"stack({len(tests)}, {pairs}) AS (rule, passed)")


def output_contract(produced: DataFrame, expected: DataFrame,
                    columns: tuple[str, ...] = ("response_id", "probability")) -> DataFrame:
    """Columns, counts, id set, id order, nulls, finiteness and range of a prediction file.

    Both tables carry ``pos``, the row's place in its file, because rows have no order.
    """
    exact = [c for c in produced.columns if c != "pos"] == list(columns)
    probability = "try_cast(probability AS DOUBLE)" if "probability" in produced.columns else "CAST(NULL AS DOUBLE)"
    have = aggregate(
        produced.selectExpr("response_id", "pos", f"{probability} AS p"), ["response_id"],
        "count(1) AS h_n", "min(pos) AS h_pos", "min(p) AS low", "max(p) AS high",
        "count_if(p IS NULL OR isnan(p) OR abs(p) = double('Infinity')) AS odd",
    )
    want = aggregate(expected, ["response_id"], "count(1) AS w_n", "min(pos) AS w_pos")
    both = have.join(want, have["response_id"].eqNullSafe(want["response_id"]), "full_outer").select(
        have["response_id"], "h_n", "h_pos", "low", "high", "odd", "w_n", "w_pos"
    )
    facts = aggregate(
        both, [],
        "coalesce(sum(h_n), 0) AS h", "coalesce(sum(w_n), 0) AS w",
        "count_if(h_n IS NOT NULL AND response_id IS NULL) AS null_ids",
        "count_if(h_n IS NULL OR w_n IS NULL) AS strangers",
        "count_if(NOT (h_pos <=> w_pos) OR h_n > 1) AS misplaced",
        "coalesce(sum(odd), 0) AS odd", "min(low) AS low", "max(high) AS high",
    )
    return rules(facts, {
        "columns_exact": str(exact).lower(),
        "row_count_matches": "h = w",
        "no_missing_response_id": "null_ids = 0",
        "row_set_matches": "strangers = 0",
        "row_order_matches": "h = w AND misplaced = 0",
        "no_nan_probabilities": "odd = 0",
        "probabilities_in_unit_interval": "odd = 0 AND low >= 0 AND high <= 1",
        "probabilities_clipped_off_0_and_1": "odd = 0 AND low > 0 AND high < 1",
    })


def prediction_sanity(scored: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Integrity thresholds on rows whose labels are known."""
    ranking = auc(scored, [], label, pred).select("auc").scalar()
    facts = aggregate(
        scored, [], "count(1) AS n", f"avg({log_loss(label, pred)}) AS loss",
        f"avg({pred}) AS mean_pred", f"avg({label}) AS base",
    ).withColumn("auc", ranking)
    return rules(facts, {
        "enough_rows": "n >= 50",
        "beats_coin_flip": f"loss < {num(COIN_FLIP)}",
        "prediction_sanity": f"loss <= {num(MAX_KNOWN_LOSS)} AND auc >= {num(MIN_KNOWN_AUC)}",
        "prediction_mean_near_base_rate": f"abs(mean_pred - base) < {num(MEAN_BAND)}",
    })


def replay(produced: DataFrame, stored: DataFrame, key: str = "response_id", tolerance: float = 1e-12) -> DataFrame:
    """Recomputed predictions against the stored ones."""
    both = produced.selectExpr(key, "pred AS a").join(stored.selectExpr(key, "pred AS b"), key, "full_outer")
    same = f"coalesce(abs(a - b) <= {num(tolerance)} + {num(tolerance)} * abs(b), false)"
    return aggregate(
        both, [], "count(1) AS n_rows", f"count_if(NOT {same}) AS n_different",
        "coalesce(max(abs(a - b)), 0D) AS max_abs_delta",
    )


def prediction_sink(required: DataFrame, predictions: DataFrame, prior: float, eps: float = 1e-6) -> DataFrame:
    """Predictions for exactly the required rows, gaps filled with the prior, clipped, in order."""
    joined = required.select("response_id", "pos").join(
        predictions.select("response_id", "probability"), "response_id", "left"
    )
    clipped = f"greatest(least(coalesce(probability, {num(prior)}), {num(1 - eps)}), {num(eps)})"
    return joined.selectExpr("pos", "response_id", f"{clipped} AS probability").orderBy("pos")
