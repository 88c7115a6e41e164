"""Scores, calibration, blending, comparisons, gates and ledgers."""

from __future__ import annotations

from ..functions import scalars as S
from ..operators import blend as BL
from ..operators import compare as CO
from ..operators import folds as FO
from ..operators import ledger as LE
from ..operators import metrics as ME
from ..operators import quality as QU
from ..operators.ordered import aggregate
from ..operators.stats import auc, auc_of_counts, histogram, quantile, ranked
from ..plans.scoring import score_batch
from ..session import cut
from .inputs import responses, table
from .registry import query, rounded
from .responses import (
    LL, OBJECTIVE_FOLDS, OUTER, PURGED, R, SESSION_FOLDS, folds_sql, objective_folds, order_folds, purged,
    session_folds,
)


def loss_sql(p: str) -> str:
    return LL.format(p=p)


def auc_sql(keys: str, source: str, name: str, label: str = "label", pred: str = "pred") -> str:
    """CTE ``name(keys, auc, n_pos, n_neg)`` from average ranks."""
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""
    {name}_r AS (SELECT {lead}{label} AS y,
                   rank() OVER ({part} ORDER BY {pred}) + (count(*) OVER (PARTITION BY {lead}{pred}) - 1) / 2.0::DOUBLE AS rk
            FROM {source}),
    {name} AS (SELECT {lead}CASE WHEN sum(y) > 0 AND sum(1 - y) > 0
                   THEN (sum(rk * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) END AS auc,
                   sum(y) AS n_pos, sum(1 - y) AS n_neg FROM {name}_r {group})"""


EXPERIMENTS = "stack(3, 'exp_a', pred, 'exp_b', pred_b, 'exp_c', (pred + pred_b) / 2)"


def experiments(spark, sf_dir, rows=None):
    rows = responses(spark, sf_dir) if rows is None else rows
    rest = [c for c in rows.columns if c not in ("pred", "pred_b")]
    return rows.selectExpr(*rest, f"{EXPERIMENTS} AS (experiment, pred)")


def exps_sql(source: str = "r") -> str:
    return f"""
    x AS MATERIALIZED (SELECT * EXCLUDE (pred, pred_b), 'exp_a' AS experiment, pred FROM {source}
          UNION ALL SELECT * EXCLUDE (pred, pred_b), 'exp_b', pred_b FROM {source}
          UNION ALL SELECT * EXCLUDE (pred, pred_b), 'exp_c', (pred + pred_b) / 2 FROM {source})"""


# --- scalar expressions ----------------------------------------------------------------
@query("probability_arithmetic", "P1 P2 P3 E1 M13", rounded(f"""
    WITH {R} SELECT response_id, CASE WHEN response_id % 3 = 0 THEN 0.0 ELSE price / (response_id % 3) END AS ratio,
           greatest(least(pred * 1.4 - 0.2, 0.999999), 0.000001) AS clipped, ln(pred / (1 - pred)) AS z,
           1 / (1 + exp(-(price / 1e5 - 2))) AS s, {loss_sql('pred')} AS loss,
           1 / (1 + exp(-(0.7 * ln(pred / (1 - pred)) + 0.3 * ln(pred_b / (1 - pred_b))))) AS blend FROM r""",
    "ratio clipped z s loss blend"))
def _arithmetic(spark, sf_dir):
    return responses(spark, sf_dir).selectExpr(
        "response_id", f"{S.safe_div('price', 'response_id % 3')} AS ratio",
        f"{S.clip_probability('(pred * 1.4D - 0.2D)')} AS clipped", f"{S.logit('pred')} AS z",
        f"{S.sigmoid('price / 1e5D - 2D')} AS s", f"{S.log_loss('label', 'pred')} AS loss",
        f"{S.blend_logit(['pred', 'pred_b'], ['0.7D', '0.3D'])} AS blend",
    )


CAL_X, CAL_Y = (0.1, 0.3, 0.5, 0.75), (0.08, 0.35, 0.4, 0.9)


@query("calibrated_predictions", "M9", rounded(f"""
    WITH {R} SELECT response_id, 1 / (1 + exp(-(0.8 * ln(pred / (1 - pred)) - 0.1))) AS platt,
           CASE WHEN pred <= 0.1 THEN 0.08 WHEN pred <= 0.3 THEN 0.08 + (pred - 0.1) * 0.27 / 0.2
                WHEN pred <= 0.5 THEN 0.35 + (pred - 0.3) * 0.05 / 0.2
                WHEN pred <= 0.75 THEN 0.4 + (pred - 0.5) * 0.5 / 0.25 ELSE 0.9 END AS isotonic FROM r""", "platt isotonic"))
def _calibrated(spark, sf_dir):
    platt = {"method": "platt", "coef": 0.8, "intercept": -0.1}
    iso = {"method": "isotonic", "x": CAL_X, "y": CAL_Y}
    return responses(spark, sf_dir).selectExpr(
        "response_id", f"{S.calibrated('pred', platt)} AS platt", f"{S.calibrated('pred', iso)} AS isotonic"
    )


# --- scores ----------------------------------------------------------------------------
@query("experiment_scores", "E1 E2", rounded(f"""
    WITH {R}, {exps_sql()}, {auc_sql('experiment', 'x', 'au')}
    SELECT experiment, count(*) AS n, avg({loss_sql('pred')}) AS logloss, avg(label) AS pos_rate, any_value(au.auc) AS auc
    FROM x JOIN au USING (experiment) GROUP BY experiment""", "logloss pos_rate auc"))
def _scores(spark, sf_dir):
    return ME.scores(experiments(spark, sf_dir), ["experiment"])


@query("auc_by_fold", "E2 E3", rounded(f"""
    WITH {SESSION_FOLDS}, {auc_sql('fold', 'f', 'au')} SELECT fold, auc, n_pos, n_neg FROM au""", "auc n_pos n_neg"))
def _auc_by_fold(spark, sf_dir):
    return auc(session_folds(spark, sf_dir), ["fold"], "label", "pred")


@query("within_fold_auc", "E3", rounded(f"""
    WITH {OBJECTIVE_FOLDS}, {auc_sql('fold', 'f', 'au')},
    u AS (SELECT *, n_pos + n_neg >= 200 AND auc IS NOT NULL AS ok FROM au)
    SELECT avg(auc) FILTER (ok) AS mean_auc, stddev_pop(auc) FILTER (ok) AS sd_auc, count(*) FILTER (ok) AS n_folds,
           count(*) FILTER (NOT ok) AS n_skipped FROM u""", "mean_auc sd_auc"))
def _within(spark, sf_dir):
    return ME.within_fold_auc(objective_folds(spark, sf_dir))


@query("fold_constant_auc", "E4 W19", rounded(f"""
    WITH {OBJECTIVE_FOLDS}, c AS (SELECT label, avg(label) OVER (PARTITION BY fold) AS pred FROM f),
    {auc_sql('', 'c', 'au')} SELECT auc AS pooled_auc FROM au""", "pooled_auc"))
def _constant(spark, sf_dir):
    return ME.fold_constant_auc(objective_folds(spark, sf_dir))


BIN = " + ".join(f"CASE WHEN greatest(least(pred, 0.999999), 0.000001) >= {i * 0.1!r}::DOUBLE THEN 1 ELSE 0 END"
                 for i in range(1, 10))
CURVE = f"""
    SELECT experiment, {BIN} AS bin, avg(greatest(least(pred, 0.999999), 0.000001)) AS mean_pred,
           avg(label) AS frac_positive, count(*) AS n FROM x GROUP BY ALL"""


@query("reliability", "E5", rounded(f"WITH {R}, {exps_sql()} SELECT * REPLACE (CAST(bin AS BIGINT) AS bin) FROM ({CURVE})",
                                    "mean_pred frac_positive"))
def _reliability(spark, sf_dir):
    return ME.reliability(experiments(spark, sf_dir), ["experiment"])


@query("calibration_error", "E5", rounded(f"""
    WITH {R}, {exps_sql()} SELECT experiment, sum(n * abs(mean_pred - frac_positive)) / sum(n) AS ece
    FROM ({CURVE}) GROUP BY experiment""", "ece"))
def _ece(spark, sf_dir):
    return ME.calibration_error(ME.reliability(experiments(spark, sf_dir), ["experiment"]), ["experiment"])


@query("quantile_bins", "E6", rounded(f"""
    WITH {R}, e AS (SELECT list_distinct([quantile_cont(price, 0), quantile_cont(price, 0.2), quantile_cont(price, 0.4),
             quantile_cont(price, 0.6), quantile_cont(price, 0.8), quantile_cont(price, 1)]) AS u FROM r),
    s AS (SELECT list_sort(u) AS edges FROM e),
    b AS (SELECT r.*, edges, greatest(len(list_filter(edges, lambda v: v < price)), 1) AS bin FROM r, s)
    SELECT bin, edges[bin] AS low, edges[bin + 1] AS high, count(*) AS n, avg(label) AS pos_rate
    FROM b GROUP BY ALL""", "low high pos_rate"))
def _quantiles(spark, sf_dir):
    binned = ME.quantile_bins(responses(spark, sf_dir), "price", 5)
    return aggregate(binned, ["bin", "bin_low", "bin_high"], "count(1) AS n", "avg(label) AS pos_rate") \
        .withColumnsRenamed({"bin_low": "low", "bin_high": "high"})


@query("slice_report", "E7 P8", rounded(f"""
    WITH {R}, {auc_sql('objective_id', 'r', 'au')}
    SELECT objective_id, count(*) AS n, avg({loss_sql('pred')}) AS logloss, avg(label) AS pos_rate, any_value(au.auc) AS auc
    FROM r JOIN au USING (objective_id) GROUP BY objective_id HAVING count(*) >= 50""", "logloss pos_rate auc"))
def _slices(spark, sf_dir):
    return ME.slice_report(responses(spark, sf_dir), "objective_id")


@query("objective_baseline_oof", "F1 F7 M2 E1 E8 J10", rounded(f"""
    WITH {OUTER}, s AS (SELECT m2.*, f.pred FROM m2 JOIN f USING (response_id)), {auc_sql('', 's', 'au', pred='encoding')}
    SELECT count(*) AS n, avg({loss_sql('fold_rate')}) AS prior_logloss, avg({loss_sql('encoding')}) AS baseline_logloss,
           any_value(au.auc) AS baseline_auc, avg({loss_sql('pred')}) AS model_logloss,
           avg({loss_sql('pred')}) - avg({loss_sql('encoding')}) AS delta_vs_baseline,
           avg({loss_sql('pred')}) < avg({loss_sql('encoding')}) AS beats_baseline FROM s, au""",
    "prior_logloss baseline_logloss baseline_auc model_logloss delta_vs_baseline"))
def _baseline(spark, sf_dir):
    from ..operators.encoding import outer_encoding

    scored = cut(outer_encoding(session_folds(spark, sf_dir)))
    base, model = (f"avg({S.log_loss('label', p)})" for p in ("encoding", "pred"))
    return aggregate(
        scored, [], "count(1) AS n", f"avg({S.log_loss('label', 'fold_rate')}) AS prior_logloss",
        f"{base} AS baseline_logloss", f"{model} AS model_logloss", f"{model} - {base} AS delta_vs_baseline",
        f"{model} < {base} AS beats_baseline",
    ).withColumn("baseline_auc", auc(scored, [], "label", "encoding").select("auc").scalar())


@query("gain_constant", "E10", rounded(f"""
    WITH {R}, {exps_sql()}, {auc_sql('experiment', 'x', 'au')},
    s AS (SELECT experiment, avg({loss_sql('pred')}) AS ll, avg(label) AS p, any_value(au.auc) AS auc FROM x JOIN au USING (experiment) GROUP BY 1)
    SELECT experiment, (-(p * ln(p) + (1 - p) * ln(1 - p)) - ll) AS gain,
           (-(p * ln(p) + (1 - p) * ln(1 - p)) - ll) / pow(auc - 0.5, 2) AS k,
           avg((-(p * ln(p) + (1 - p) * ln(1 - p)) - ll) / pow(auc - 0.5, 2)) OVER () AS k_mean FROM s""", "gain k k_mean"))
def _gain(spark, sf_dir):
    fitted = cut(CO.gain_constant(ME.scores(experiments(spark, sf_dir), ["experiment"])))
    return fitted.select("experiment", "gain", "k").withColumn(
        "k_mean", aggregate(fitted, [], "avg(k) AS k").scalar()
    )


@query("experiments_by_objective_fold", "E11 E3 J5", rounded(f"""
    WITH {OBJECTIVE_FOLDS}, {exps_sql('f')}, {auc_sql('experiment, fold', 'x', 'au')},
    u AS (SELECT experiment, avg(auc) FILTER (n_pos + n_neg >= 200) AS mean_auc, stddev_pop(auc) FILTER (n_pos + n_neg >= 200) AS sd_auc,
                 count(*) FILTER (NOT (n_pos + n_neg >= 200 AND auc IS NOT NULL)) AS n_skipped FROM au GROUP BY experiment),
    l AS (SELECT experiment, count(*) AS n, avg({loss_sql('pred')}) AS logloss FROM x GROUP BY experiment)
    SELECT experiment, n, mean_auc, sd_auc, n_skipped, logloss, 0.62::DOUBLE - 1.5::DOUBLE * pow(mean_auc - 0.5, 2) AS projected,
           CASE WHEN experiment = 'exp_a' THEN 'honest' ELSE 'optimistic' END AS evidence,
           rank() OVER (ORDER BY mean_auc DESC) AS place FROM u JOIN l USING (experiment)""", "mean_auc sd_auc logloss projected"))
def _by_fold(spark, sf_dir):
    from ..plans.experiments import score_experiments

    modes = table(spark, sf_dir, "region").where("r_regionkey = 0").selectExpr(
        "'exp_a' AS experiment", "'objective' AS split_mode"
    )
    rows = experiments(spark, sf_dir)
    folds = objective_folds(spark, sf_dir).select("response_id", "fold")
    return score_experiments(rows, folds, modes, c=0.62, k=1.5).select(
        "experiment", "n", "mean_auc", "sd_auc", "n_skipped", "logloss", "projected", "evidence", "place"
    )


# --- repeated and paired comparisons ---------------------------------------------------
RUNS = f"runs AS (SELECT experiment AS name, response_id % 5 AS seed, avg({loss_sql('pred')}) AS value FROM x GROUP BY ALL)"
SUMMARY_SQL = """
    SELECT name, count(*) AS n_seeds, avg(value) AS mean, stddev_samp(value) AS sd, stddev_samp(value) / sqrt(count(*)) AS sem,
           avg(value) - 1.96 * stddev_samp(value) / sqrt(count(*)) AS ci95_low, avg(value) + 1.96 * stddev_samp(value) / sqrt(count(*)) AS ci95_high,
           count(*) FILTER (value <> 0 AND sign(value) = (SELECT sign(avg(value)) FROM {t} AS i WHERE i.name = o.name)) AS n_same_sign,
           avg(value) - 1.96 * stddev_samp(value) / sqrt(count(*)) > 0 OR avg(value) + 1.96 * stddev_samp(value) / sqrt(count(*)) < 0 AS excludes_zero
    FROM {t} AS o GROUP BY name"""
SUMMARY_COLS = "mean sd sem ci95_low ci95_high"


def runs(spark, sf_dir):
    return aggregate(
        experiments(spark, sf_dir).selectExpr("experiment AS name", "response_id % 5 AS seed", "label", "pred"),
        ["name", "seed"], f"avg({S.log_loss('label', 'pred')}) AS value",
    )


@query("repeated_summary", "E12", rounded(f"WITH {R}, {exps_sql()}, {RUNS} {SUMMARY_SQL.format(t='runs')}", SUMMARY_COLS))
def _repeated(spark, sf_dir):
    return CO.summarize(runs(spark, sf_dir))


DELTAS = ("dl AS (SELECT v.name, v.seed, v.value - b.value AS value FROM runs AS v JOIN runs AS b "
          "ON b.seed = v.seed AND b.name = 'exp_b' WHERE v.name <> 'exp_b')")


@query("paired_comparison", "E13 E19 U3", rounded(f"""
    WITH {R}, {exps_sql()}, {RUNS}, {DELTAS}, s AS ({SUMMARY_SQL.format(t='dl')})
    SELECT *, -mean >= 0.001 AND -ci95_high > 0 AND n_same_sign = n_seeds AS promoted FROM s""", SUMMARY_COLS))
def _paired(spark, sf_dir):
    return CO.promotion(CO.summarize(CO.paired_delta(runs(spark, sf_dir), "exp_b")), 0.001, sign=-1)


SEEDS = (0, 1, 2, 3)
ASSIGNED = ", ".join(folds_sql("objective_id", "n DESC, np DESC", s, name=f"s{s}") for s in SEEDS)
ALL_SEEDS = " UNION ALL ".join(f"SELECT {s} AS fold_seed, fold, label, pred, pred_b FROM s{s}" for s in SEEDS)


@query("fold_assignment_test", "E16", rounded(f"""
    WITH {R}, {ASSIGNED}, z AS MATERIALIZED ({ALL_SEEDS}), {auc_sql('fold_seed, fold', 'z', 'ab', pred='pred_b')},
    {auc_sql('fold_seed, fold', 'z', 'ac')},
    ps AS (SELECT fold_seed, avg(ac.auc - ab.auc) AS delta, avg(ab.auc) AS b, avg(ac.auc) AS c FROM ab JOIN ac USING (fold_seed, fold) GROUP BY 1)
    SELECT count(*) AS n_assignments, avg(b) AS baseline_auc, avg(c) AS candidate_auc, avg(delta) AS mean_delta,
           stddev_samp(delta) AS sd_delta, count(*) FILTER (delta > 0) AS n_positive, stddev_samp(delta) / sqrt(count(*)) AS stderr,
           avg(delta) > 2 * stddev_samp(delta) / sqrt(count(*)) AND count(*) FILTER (delta > 0) >= greatest(4, count(*) - 1) AS promotable
    FROM ps""", "baseline_auc candidate_auc mean_delta sd_delta stderr"))
def _assignment_test(spark, sf_dir):
    counts = FO.objective_scores(responses(spark, sf_dir), SEEDS, {"b": "pred_b", "c": "pred"})
    per_fold = aggregate(
        auc_of_counts(counts, ["fold_seed", "fold", "arm"]), ["fold_seed", "fold"],
        "max(CASE WHEN arm = 'b' THEN auc END) AS baseline_auc", "max(CASE WHEN arm = 'c' THEN auc END) AS candidate_auc",
    )
    return CO.fold_assignment_test(per_fold)


@query("noise_floor", "E17", rounded(f"""
    WITH {R}, {ASSIGNED}, z AS MATERIALIZED ({ALL_SEEDS}), {auc_sql('fold_seed, fold', 'z', 'ac')},
    m AS (SELECT fold_seed, avg(auc) AS v FROM ac GROUP BY fold_seed),
    d AS (SELECT v - lag(v) OVER (ORDER BY fold_seed) AS delta FROM m)
    SELECT count(delta) AS n_pairs, avg(abs(delta)) AS mean_move, stddev_samp(delta) AS sd_move, max(abs(delta)) AS largest_move
    FROM d""", "mean_move sd_move largest_move"))
def _noise_floor(spark, sf_dir):
    counts = FO.objective_scores(responses(spark, sf_dir), SEEDS, {"c": "pred"})
    per_seed = aggregate(auc_of_counts(counts, ["fold_seed", "fold"]), ["fold_seed"], "avg(auc) AS value")
    return CO.noise_floor(per_seed.withColumnRenamed("fold_seed", "seed"))


@query("robust_holdout_report", "E18 M1 J8", rounded(f"""
    WITH {PURGED}, pr AS (SELECT train_fold AS fold, avg(label) AS rate FROM p GROUP BY 1), {auc_sql('fold', 'f', 'au')}
    SELECT fold, count(*) AS n, avg({loss_sql('pred')}) AS model_logloss, avg({loss_sql('rate')}) AS prior_logloss,
           any_value(au.auc) AS model_auc, avg({loss_sql('pred')}) < avg({loss_sql('rate')}) AS won
    FROM f JOIN pr USING (fold) JOIN au USING (fold) GROUP BY fold""", "model_logloss prior_logloss model_auc"))
def _holdout(spark, sf_dir):
    from ..operators.encoding import purged_rates
    from ..plans.experiments import holdout_report

    folds = order_folds(spark, sf_dir)
    return holdout_report(folds, purged_rates(purged(spark, sf_dir, folds)))


# --- shrinkage and blending ------------------------------------------------------------
GRID = ", ".join(f"({w!r}::DOUBLE)" for w in BL.SHRINK_GRID)
SHRUNK = "(base_rate + weight * (pred - base_rate))"


@query("shrinkage_grid", "M11", rounded(f"""
    WITH {R}, b AS (SELECT avg(label) AS base_rate FROM r), g AS (SELECT * FROM (VALUES {GRID}) AS v(weight))
    SELECT weight, avg({loss_sql(SHRUNK)}) AS logloss FROM r, b, g GROUP BY weight""", "weight logloss"))
def _shrinkage(spark, sf_dir):
    rows = responses(spark, sf_dir)
    based = rows.withColumn("base_rate", aggregate(rows, [], "avg(label) AS b").scalar())
    return BL.shrinkage_losses(based)


@query("best_shrinkage", "M11 K8", rounded(f"""
    WITH {R}, {exps_sql()}, b AS (SELECT avg(label) AS base_rate FROM r), g AS (SELECT * FROM (VALUES {GRID}) AS v(weight)),
    l AS (SELECT experiment, weight, avg({loss_sql(SHRUNK)}) AS logloss FROM x, b, g GROUP BY ALL)
    SELECT experiment, arg_min(weight, logloss) AS weight, min(logloss) AS logloss FROM l GROUP BY experiment""", "weight logloss"))
def _best_shrinkage(spark, sf_dir):
    rows = responses(spark, sf_dir)
    based = experiments(spark, sf_dir).withColumn("base_rate", aggregate(rows, [], "avg(label) AS b").scalar())
    return BL.best_weight(BL.shrinkage_losses(based, ["experiment"]), ["experiment"])


DRAW = "(response_id * 7 + d) % 10 < 4"


@query("crossfit_shrinkage", "M12", rounded(f"""
    WITH {R}, dr AS MATERIALIZED (SELECT d AS draw, response_id, label, pred, 0.25::DOUBLE + d * 0.05::DOUBLE AS base_rate
                     FROM r, (SELECT unnest(range(0, 4)) AS d) WHERE {DRAW}),
    g AS (SELECT * FROM (VALUES {GRID}) AS v(weight)), ev AS (SELECT DISTINCT draw AS eval_draw FROM dr),
    ft AS (SELECT eval_draw, dr.* FROM ev, dr WHERE dr.draw <> eval_draw
           AND NOT EXISTS (SELECT 1 FROM dr AS o WHERE o.draw = eval_draw AND o.response_id = dr.response_id)),
    l AS (SELECT eval_draw, weight, avg({loss_sql(SHRUNK)}) AS logloss FROM ft, g GROUP BY ALL)
    SELECT CAST(eval_draw AS BIGINT) AS eval_draw, arg_min(weight, logloss) AS weight, min(logloss) AS logloss FROM l GROUP BY eval_draw""", "weight logloss"))
def _crossfit(spark, sf_dir):
    draws = responses(spark, sf_dir).selectExpr("*", "explode(sequence(0, 3)) AS d").where(DRAW).selectExpr(
        "d AS draw", "response_id", "label", "pred", "0.25D + d * 0.05D AS base_rate"
    )
    return BL.crossfit_shrinkage(draws)


@query("blend_grid", "M14 K8", rounded(f"""
    WITH {R}, w AS (SELECT i / 10.0::DOUBLE AS w FROM (SELECT unnest(range(0, 11)) AS i))
    SELECT w AS weight_a, 1 - w AS weight_b,
           avg({loss_sql('(1 / (1 + exp(-(w * ln(pred / (1 - pred)) + (1 - w) * ln(pred_b / (1 - pred_b))))))')}) AS logloss
    FROM r, w GROUP BY w""", "weight_a weight_b logloss"))
def _blend(spark, sf_dir):
    losses = BL.blend_losses(responses(spark, sf_dir), ["pred", "pred_b"], BL.simplex(2, 10))
    return losses.selectExpr("weights[0] AS weight_a", "weights[1] AS weight_b", "logloss")


@query("promotion_gate", "M16 K8", rounded(f"""
    WITH {SESSION_FOLDS}, w AS (SELECT i * 0.05::DOUBLE AS w FROM (SELECT unnest(range(0, 11)) AS i)),
    q AS MATERIALIZED (SELECT fold, w, sum({loss_sql('(1 / (1 + exp(-((1 - w) * ln(pred_b / (1 - pred_b)) + w * ln(pred / (1 - pred))))))')}) AS s, count(*) AS n
          FROM f, w GROUP BY ALL),
    tr AS (SELECT a.fold, a.w, (sum(b.s) - any_value(a.s)) / (sum(b.n) - any_value(a.n)) AS l FROM q AS a JOIN q AS b ON a.w = b.w GROUP BY ALL),
    ch AS (SELECT fold, arg_min(w, l) AS w FROM tr GROUP BY fold),
    hs AS (SELECT avg({loss_sql('pred_b')}) AS base_logloss,
                  avg({loss_sql('(1 / (1 + exp(-((1 - w) * ln(pred_b / (1 - pred_b)) + w * ln(pred / (1 - pred))))))')}) AS honest_logloss
           FROM f JOIN ch USING (fold)), {auc_sql('', 'f', 'au')}
    SELECT base_logloss, honest_logloss, base_logloss - honest_logloss AS honest_gain, auc AS text_auc,
           honest_logloss <= base_logloss - 3e-4 AND auc > 0.5 AS promoted,
           CASE WHEN honest_logloss <= base_logloss - 3e-4 AND auc > 0.5 THEN (SELECT quantile_cont(w, 0.5) FROM ch) ELSE 0.0 END AS deployment_weight
    FROM hs, au""", "base_logloss honest_logloss honest_gain text_auc deployment_weight"))
def _gate(spark, sf_dir):
    folds = session_folds(spark, sf_dir)
    return BL.promotion_gate(folds, "pred_b", "pred", auc(folds, [], "label", "pred"))


# --- gates and sinks -------------------------------------------------------------------
@query("output_contract", "E26 U2", f"""
    WITH e AS (SELECT o_orderkey AS response_id, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders),
    g AS (SELECT response_id, CASE WHEN response_id % 5000 = 17 THEN pos + 1 ELSE pos END AS pos,
                 CASE WHEN response_id % 4000 = 3 THEN 1.0 ELSE 0.4 END AS p FROM e WHERE response_id % 7000 <> 11),
    j AS (SELECT e.response_id AS ei, g.response_id AS gi, e.pos AS ep, g.pos AS gp, p FROM e FULL JOIN g ON e.response_id = g.response_id),
    s AS (SELECT count(ei) AS w, count(gi) AS h, count(*) FILTER (ei IS NULL OR gi IS NULL) AS strangers,
                 count(*) FILTER (ep IS DISTINCT FROM gp) AS misplaced, min(p) AS lo, max(p) AS hi FROM j)
    SELECT unnest(['columns_exact', 'row_count_matches', 'no_missing_response_id', 'row_set_matches', 'row_order_matches',
                   'no_nan_probabilities', 'probabilities_in_unit_interval', 'probabilities_clipped_off_0_and_1']) AS rule,
           unnest([true, h = w, true, strangers = 0, h = w AND misplaced = 0, true, lo >= 0 AND hi <= 1, lo > 0 AND hi < 1]) AS passed FROM s""")
def _contract(spark, sf_dir):
    from ..operators.ordered import Sequence, scan

    ids = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS response_id")
    expected = scan(ids, Sequence((), ("response_id",), ("response_id div 65536",)), running={"pos": "1L"}) \
        .selectExpr("response_id", "pos + 1 AS pos")
    produced = expected.where("response_id % 7000 <> 11").selectExpr(
        "response_id", "CASE WHEN response_id % 5000 = 17 THEN pos + 1 ELSE pos END AS pos",
        "CASE WHEN response_id % 4000 = 3 THEN 1D ELSE 0.4D END AS probability",
    )
    return QU.output_contract(produced, expected)


@query("prediction_sanity", "E27", f"""
    WITH {R}, {auc_sql('', 'r', 'au')}, s AS (SELECT count(*) AS n, avg({loss_sql('pred')}) AS l, avg(pred) AS mp, avg(label) AS b FROM r)
    SELECT unnest(['enough_rows', 'beats_coin_flip', 'prediction_sanity', 'prediction_mean_near_base_rate']) AS rule,
           unnest([n >= 50, l < 0.6931, l <= 0.60 AND auc >= 0.70, abs(mp - b) < 0.10]) AS passed FROM s, au""")
def _sanity(spark, sf_dir):
    return QU.prediction_sanity(responses(spark, sf_dir))


@query("oof_replay", "E30", rounded(f"""
    WITH {R}, c AS (SELECT pred AS a, CASE WHEN response_id % 997 = 1 THEN pred + 1e-3 ELSE pred END AS b FROM r)
    SELECT count(*) AS n_rows, count(*) FILTER (abs(a - b) > 1e-12 + 1e-12 * abs(b)) AS n_different, max(abs(a - b)) AS max_abs_delta FROM c""",
    "max_abs_delta"))
def _replay(spark, sf_dir):
    rows = responses(spark, sf_dir).select("response_id", "pred")
    stored = rows.selectExpr("response_id", "CASE WHEN response_id % 997 = 1 THEN pred + 1e-3D ELSE pred END AS pred")
    return QU.replay(rows, stored)


@query("prediction_sink", "S9 J9", rounded("""
    SELECT o_orderkey AS pos, o_orderkey AS response_id,
           greatest(least(coalesce(CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice / 399989.0::DOUBLE - 0.1 END, 0.31), 0.999999), 0.000001) AS probability
    FROM orders""", "probability"))
def _sink(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    required = rows.selectExpr("o_orderkey AS response_id", "o_orderkey AS pos")
    made = rows.where("o_orderkey % 13 <> 0").selectExpr(
        "o_orderkey AS response_id", "o_totalprice / 399989.0D - 0.1D AS probability")
    return QU.prediction_sink(required, made, 0.31)


@query("batch_scoring", "M17 M9 M11 M13 J9 S9", rounded(f"""
    WITH {R}, m AS (SELECT objective_id, (sum(label) + 20 * (SELECT avg(label) FROM r WHERE session_id % 2 = 0)) / (count(*) + 20) AS e
                    FROM r WHERE session_id % 2 = 0 GROUP BY 1),
    fp AS (SELECT response_id, objective_id, CASE WHEN session_id % 17 <> 0 THEN (pred + pred * 0.9 + pred * 0.8) / 3 END AS p,
                  CASE WHEN session_id % 5 <> 0 THEN pred_b END AS t FROM r),
    b AS (SELECT *, CASE WHEN t IS NULL OR p IS NULL THEN p ELSE 1 / (1 + exp(-(0.75 * ln(p / (1 - p)) + 0.25 * ln(t / (1 - t))))) END AS q FROM fp),
    c AS (SELECT *, 1 / (1 + exp(-(0.9 * ln(q / (1 - q)) + 0.05))) AS cal FROM b)
    SELECT response_id AS pos, response_id, CASE WHEN q IS NULL THEN coalesce(e, 0.33) ELSE 0.33 + 0.6 * (cal - 0.33) END AS probability
    FROM c LEFT JOIN m USING (objective_id)""", "probability"))
def _batch(spark, sf_dir):
    from ..operators.encoding import smoothed_means

    rows = responses(spark, sf_dir)
    folds = rows.where("session_id % 17 <> 0").selectExpr(
        "response_id", "explode(array(pred, pred * 0.9D, pred * 0.8D)) AS pred")
    return score_batch(
        rows.selectExpr("response_id", "response_id AS pos"), folds, rows,
        smoothed_means(rows.where("session_id % 2 = 0")),
        text=rows.where("session_id % 5 <> 0").selectExpr("response_id", "pred_b AS text_pred"), text_weight=0.25,
        calibrator={"method": "platt", "coef": 0.9, "intercept": 0.05}, shrinkage=(0.6, 0.33), fallback=0.33,
    )


#: Newton steps for one weight between zero and one.
BLEND_STEPS = f"""
    WITH RECURSIVE {R},
    z AS MATERIALIZED (SELECT label, pred, pred_b, ln(pred / (1 - pred)) AS za, ln(pred_b / (1 - pred_b)) AS zb FROM r),
    steps AS (
        SELECT 0 AS step, 0.5::DOUBLE AS w
        UNION ALL
        SELECT step + 1, least(1, greatest(0, w - g / h))
        FROM (SELECT step, w, sum((q - label) * (za - zb)) AS g, sum(q * (1 - q) * (za - zb) * (za - zb)) AS h
              FROM (SELECT step, w, label, za, zb, 1 / (1 + exp(-(w * za + (1 - w) * zb))) AS q FROM steps, z WHERE step < 15) GROUP BY ALL))"""


@query("blend_report", "M15 J10 M14", rounded(f"""
    {BLEND_STEPS}, best AS (SELECT w FROM steps WHERE step = 15)
    SELECT count(*) AS n_common, any_value(w) AS weight_a, 1 - any_value(w) AS weight_b,
           avg({loss_sql('(1 / (1 + exp(-(w * za + (1 - w) * zb))))')}) AS logloss, 0.0::DOUBLE AS optimality_gap,
           avg({loss_sql('pred')}) AS logloss_a, avg({loss_sql('pred_b')}) AS logloss_b,
           'mixed' AS split_mode, false AS regime_consistent FROM z, best""",
    "weight_a weight_b logloss optimality_gap logloss_a logloss_b"))
def _blend_report(spark, sf_dir):
    from ..plans.experiments import blend_report

    rows = responses(spark, sf_dir)
    a = rows.select("response_id", "session_id", "label", "pred")
    b = rows.selectExpr("response_id", "session_id", "label", "pred_b AS pred")
    return blend_report({"a": a, "b": b}, {"a": "objective", "b": "session"})


# --- ledgers and importances -----------------------------------------------------------
RATES = {"cpu": 0.08, "small": 1.7, "large": 11.8}
LEDGER = """
    SELECT event_id, ts, event_type AS task, CASE user_id % 3 WHEN 0 THEN 'cpu' WHEN 1 THEN 'small' ELSE 'large' END AS tier,
           value * 60 AS wall_seconds FROM events"""
UNITS = "(CASE tier WHEN 'cpu' THEN 0.08 WHEN 'small' THEN 1.7 ELSE 11.8 END) * wall_seconds / 3600.0"


def ledger(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "ts", "event_type AS task",
        "CASE user_id % 3 WHEN 0 THEN 'cpu' WHEN 1 THEN 'small' ELSE 'large' END AS tier", "value * 60D AS wall_seconds",
    )


@query("cost_rollup", "E24", rounded(f"""
    WITH l AS (SELECT *, {UNITS} AS units FROM ({LEDGER}))
    SELECT 'task' AS kind, task AS key, sum(units) AS units, count(*) AS n_runs FROM l GROUP BY task
    UNION ALL SELECT 'tier', tier, sum(units), count(*) FROM l GROUP BY tier
    UNION ALL SELECT 'total', 'spent', sum(units), count(*) FROM l
    UNION ALL SELECT 'total', 'left', 50000.0 - sum(units), count(*) FROM l""", "units"))
def _cost(spark, sf_dir):
    return LE.cost_rollup(ledger(spark, sf_dir), RATES, 50000.0)


@query("cumulative_units", "W20", rounded(f"""
    WITH l AS (SELECT *, {UNITS} AS units FROM ({LEDGER}))
    SELECT event_id, units, sum(units) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cumulative_units FROM l""",
    "units cumulative_units"))
def _cumulative(spark, sf_dir):
    spent = LE.cumulative_units(ledger(spark, sf_dir), RATES, ("ts", "event_id"), ("date(ts)",))
    return spent.select("event_id", "units", "cumulative_units")


@query("run_records", "S10", rounded("""
    SELECT 'task-' || event_id AS task, 'cpu' AS tier, value AS wall_seconds, event_type AS experiment, value / 500.0::DOUBLE AS logloss,
           CASE WHEN event_id % 3 <> 0 THEN CAST(400 AS BIGINT) END AS subsample
    FROM events WHERE event_id % 11 <> 5 AND event_id % 13 <> 7""", "wall_seconds logloss"))
def _run_records(spark, sf_dir):
    from ..sources.files import parse_runs

    lines = table(spark, sf_dir, "events").selectExpr("""
        CASE WHEN event_id % 11 = 5 THEN '{broken' WHEN event_id % 13 = 7 THEN concat('{"task": "', event_id, '", "wall_seconds": "no number"}')
        ELSE to_json(named_struct('task', concat('task-', event_id), 'tier', 'cpu', 'wall_seconds', value,
             'subsample', CASE WHEN event_id % 3 = 0 THEN NULL ELSE 400 END,
             'metrics', named_struct('experiment', event_type, 'logloss', value / 500.0D))) END AS value""")
    return parse_runs(lines).selectExpr(
        "task", "tier", "wall_seconds", "metrics.experiment AS experiment", "metrics.logloss AS logloss", "subsample")


@query("leaderboard", "K7", rounded("""
    WITH g AS (SELECT event_id, event_type || '_' || (user_id % 7) AS experiment, round(value / 500.0::DOUBLE, 2) AS logloss,
                      CASE WHEN event_id % 3 = 0 THEN NULL ELSE 400 END AS subsample FROM events),
    k AS (SELECT subsample IS NOT NULL AS subsampled, experiment, round(logloss, 6) AS score, count(*) AS n_runs FROM g GROUP BY ALL),
    p AS (SELECT *, row_number() OVER (PARTITION BY subsampled ORDER BY score, experiment) AS place FROM k)
    SELECT subsampled, experiment, score, n_runs, place FROM p WHERE place <= 60""", "score"))
def _leaderboard(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "ts", "concat(event_type, '_', user_id % 7) AS experiment", "round(value / 500.0D, 2) AS logloss",
        "CASE WHEN event_id % 3 = 0 THEN NULL ELSE 400 END AS subsample",
    )
    return CO.leaderboard(rows).drop("ts")


FEATURES = ("struct_n", "ling_q", "temp_gap", "lo_sim", "fb_rate", "fbs_rate", "traj_run", "lopos_mid", "cont_01", "age")
GAINS = (f"SELECT {list(FEATURES)}[p_partkey % 10 + 1] AS feature, p_partkey // 10 % 5 AS fold, p_retailprice * p_size AS gain FROM part")
BLOCK_SQL = ("CASE WHEN starts_with(feature, 'struct_') THEN 'structural' WHEN starts_with(feature, 'ling_') THEN 'linguistic' "
             "WHEN starts_with(feature, 'temp_') THEN 'temporal' WHEN starts_with(feature, 'lo_') THEN 'lo_alignment' "
             "WHEN starts_with(feature, 'fb_') OR starts_with(feature, 'fbs_') THEN 'feedback' WHEN starts_with(feature, 'traj_') THEN 'trajectory' "
             "WHEN starts_with(feature, 'lopos_') THEN 'lo_position' WHEN starts_with(feature, 'cont_') THEN 'content' ELSE 'other' END")


def gains(spark, sf_dir):
    names = ", ".join(f"'{f}'" for f in FEATURES)
    return table(spark, sf_dir, "part").selectExpr(
        f"element_at(array({names}), CAST(p_partkey % 10 + 1 AS INT)) AS feature", "p_partkey div 10 % 5 AS fold",
        "p_retailprice * p_size AS gain",
    )


@query("importance_summary", "A16 P7", rounded(f"""
    SELECT feature, avg(gain) AS gain_mean, stddev_samp(gain) AS gain_std, min(gain) AS gain_min, max(gain) AS gain_max,
           {BLOCK_SQL} AS block FROM ({GAINS}) GROUP BY feature""", "gain_mean gain_std gain_min gain_max"))
def _importance(spark, sf_dir):
    return LE.importance_summary(gains(spark, sf_dir))


@query("importance_by_block", "A16 P7", rounded(f"""
    SELECT {BLOCK_SQL} AS block, sum(m) AS gain FROM (SELECT feature, avg(gain) AS m FROM ({GAINS}) GROUP BY 1) GROUP BY 1""", "gain"))
def _by_block(spark, sf_dir):
    return LE.importance_by_block(LE.importance_summary(gains(spark, sf_dir)))


@query("block_summary", "A18 P7", rounded("""
    WITH t AS (SELECT p_size AS a, p_retailprice AS b, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size * 2 END AS c FROM part)
    SELECT 'structural' AS block, 1::BIGINT AS n_features, count(*) AS n_rows, avg(CASE WHEN a IS NULL THEN 1.0 ELSE 0.0 END) AS missing_rate FROM t
    UNION ALL SELECT 'linguistic', 2, count(*), avg(((b IS NULL)::INT + (c IS NULL)::INT) / 2.0) FROM t""", "missing_rate"))
def _block_summary(spark, sf_dir):
    wide = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_size AS struct_size", "p_retailprice AS ling_price",
        "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size * 2 END AS ling_double",
    )
    return LE.block_summary(wide, "p_partkey")


@query("key_moment_positions", "A19", rounded(f"""
    WITH {R} SELECT avg(pred) AS mean, quantile_cont(pred, 0.5) AS median, quantile_cont(pred, 0.25) AS q25,
             quantile_cont(pred, 0.75) AS q75 FROM r""", "mean median q25 q75"))
def _moments(spark, sf_dir):
    rows = ranked(histogram(responses(spark, sf_dir), [], "pred"), [], chunked=True)
    return aggregate(
        rows, [], "sum(value * cnt) / sum(cnt) AS mean", f"{quantile(0.5)} AS median", f"{quantile(0.25)} AS q25",
        f"{quantile(0.75)} AS q75",
    )


@query("key_moment_histogram", "A19", f"""
    WITH {R} SELECT least(CAST({' + '.join(f"(pred >= {i * (1.0 / 25)!r}::DOUBLE)::INT" for i in range(1, 25))} AS BIGINT), 24) AS bin, count(*) AS n
    FROM r WHERE pred BETWEEN 0 AND 1 GROUP BY 1""")
def _moment_histogram(spark, sf_dir):
    rows = responses(spark, sf_dir).where("pred BETWEEN 0 AND 1")
    return aggregate(rows.selectExpr(f"{ME.probability_bin('pred', 25)} AS bin"), ["bin"], "count(1) AS n")
