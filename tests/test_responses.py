from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from conftest import by_key
from turnwise.functions import scalars as S
from turnwise.operators import blend as BL
from turnwise.operators import compare as CO
from turnwise.operators import encoding as EN
from turnwise.operators import folds as FO
from turnwise.operators import joins as JN
from turnwise.operators import metrics as ME
from turnwise.operators import quality as QU
from turnwise.operators import sampling as SA
from turnwise.operators.stats import auc
from turnwise.plans.experiments import blend_report, score_experiments
from turnwise.plans.matrix import CROSS_ROW, build_matrix
from turnwise.plans.overview import variance_decomposition

SCHEMA = "response_id bigint, session_id string, objective_id string, label double, pred double, pred_b double"


def make(seed=0, sessions=120, objectives=12):
    rng = random.Random(seed)
    rows, i = [], 0
    for s in range(sessions):
        for _ in range(rng.randint(1, 4)):
            y = float(rng.random() < 0.6)
            p = min(0.95, max(0.05, 0.5 + 0.2 * (y - 0.5) + rng.gauss(0, 0.2)))
            rows.append((i, f"s{s:03d}", f"o{rng.randrange(objectives):02d}", y, p, rng.uniform(0.1, 0.9)))
            i += 1
    return rows


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_session_folds_are_disjoint_balanced_and_deterministic(frame, rows):
    a, b = FO.session_folds(frame, 5, 3), FO.session_folds(frame.repartition(7), 5, 3)
    fold = {r.response_id: r.fold for r in a.collect()}
    assert fold == {r.response_id: r.fold for r in b.collect()}
    assert len(fold) == len(rows) and set(fold.values()) == set(range(5))
    assert FO.split_groups(a, "session_id").count() == 0
    assert fold != {r.response_id: r.fold for r in FO.session_folds(frame, 5, 4).collect()}
    per = [[y for i, _, _, y, _, _ in rows if fold[i] == f] for f in range(5)]
    sizes, rates = [len(p) for p in per], [np.mean(p) for p in per]
    assert max(sizes) - min(sizes) <= 12 and max(rates) - min(rates) < 0.08


def test_purge_drops_shared_sessions_and_objectives(frame):
    folds = FO.objective_folds(frame)
    assert FO.split_groups(folds, "objective_id").count() == 0
    purged = FO.purged_training(folds.where("response_id % 9 = 0"))
    base = folds.where("response_id % 9 = 0").collect()
    got = {(r.response_id, r.train_fold) for r in purged.collect()}
    for f in range(5):
        valid = [r for r in base if r.fold == f]
        ses, obj = {r.session_id for r in valid}, {r.objective_id for r in valid}
        want = {r.response_id for r in base if r.fold != f and r.session_id not in ses and r.objective_id not in obj}
        assert {i for i, t in got if t == f} == want


def test_degenerate_folds_are_reported(spark):
    rows = [(i, f"s{i}", f"o{i}", 1.0, 0 if i == 0 else 1 + i % 4) for i in range(100)]
    folds = spark.createDataFrame(rows, "response_id bigint, session_id string, objective_id string, label double, fold int")
    summary = FO.fold_summary(folds, purged=FO.purged_training(folds))
    health = FO.fold_health(summary, FO.split_groups(folds, "objective_id"), folds.where("fold IS NULL"))
    passed = {r.rule: r.passed for r in health.collect()}
    assert not passed["objectives_per_fold"] and passed["fold_count"] and passed["non_empty_after_purge"]


def test_unseen_split_keeps_sessions_whole(frame):
    split = FO.unseen_split(frame, 0.1, seed=1).collect()
    sides = {}
    for r in split:
        sides.setdefault(r.session_id, set()).add(r.side)
    assert all(len(s) == 1 for s in sides.values())
    seen = {r.objective_id for r in split if r.side == "train"}
    assert all(r.scored == (r.side == "validation" and r.objective_id not in seen) for r in split)
    assert any(r.scored for r in split)


def test_group_shuffle_split(frame):
    out = FO.group_shuffle_split(frame, test=0.2, seed=2).select("session_id", "side").distinct().collect()
    assert len(out) == 120 and sum(r.side == "test" for r in out) == 24


def smoothed(train, objective, m=20.0):
    g = np.mean([r[3] for r in train])
    mine = [r[3] for r in train if r[2] == objective]
    return (sum(mine) + m * g) / (len(mine) + m)


def test_encodings_match_explicit_loops(frame, rows):
    folds = FO.session_folds(frame)
    fold = {r.response_id: r.fold for r in folds.collect()}
    outer = by_key(EN.outer_encoding(folds), "response_id")
    models = by_key(EN.model_encodings(folds), "response_id", "outer_fold")
    for r in rows[::17]:
        f = fold[r[0]]
        assert np.isclose(outer[r[0]]["encoding"], smoothed([t for t in rows if fold[t[0]] != f], r[2]))
        for o in range(5):
            train = [t for t in rows if fold[t[0]] not in (o, f)]
            assert np.isclose(models[r[0], o]["encoding"], smoothed(train, r[2]))
            assert models[r[0], o]["side"] == ("validation" if f == o else "train")


def test_validation_labels_do_not_move_training_encodings(spark, frame, rows):
    folds = FO.session_folds(frame).select("response_id", "fold")
    flipped = spark.createDataFrame([(*r[:3], 1 - r[3], *r[4:]) for r in rows], SCHEMA)
    mixed = frame.join(folds.where("fold <> 0"), "response_id").unionByName(
        flipped.join(folds.where("fold = 0"), "response_id"))
    before = by_key(EN.model_encodings(frame.join(folds, "response_id")).where("outer_fold = 0"), "response_id")
    after = by_key(EN.model_encodings(mixed).where("outer_fold = 0"), "response_id")
    assert all(np.isclose(before[i]["encoding"], after[i]["encoding"]) for i in before)
    # and a row's own session never informs its own training encoding
    own = by_key(EN.model_encodings(mixed).where("outer_fold = 1 AND fold = 0"), "response_id")
    ref = by_key(EN.model_encodings(frame.join(folds, "response_id")).where("outer_fold = 1 AND fold = 0"), "response_id")
    assert all(np.isclose(own[i]["encoding"], ref[i]["encoding"]) for i in own)


def test_unknown_objective_takes_the_training_rate(spark):
    rows = [(i, f"s{i}", "a" if i < 8 else "b", float(i % 2), 0 if i >= 8 else 1 + i % 2) for i in range(10)]
    folds = spark.createDataFrame(rows, "response_id bigint, session_id string, objective_id string, label double, fold int")
    got = by_key(EN.outer_encoding(folds), "response_id")
    assert np.isclose(got[9]["encoding"], got[9]["fold_rate"])


def test_block_join_checks(spark, frame):
    base = frame.select("response_id", "session_id")
    good = frame.groupBy("session_id").count()
    assert JN.checked_block_join(base, good, "session_id").count() == base.count()
    matrix, cols = build_matrix(base, [("b", good.withColumnRenamed("count", CROSS_ROW[0]), "session_id"),
                                       ("c", frame.groupBy("session_id").avg("pred").toDF("session_id", "lo_x"), "session_id")])
    assert cols == ["lo_x"] and matrix.count() == base.count()
    doubled = good.unionByName(good.limit(1))
    partial = good.where("session_id <> 's000'")
    for bad in (doubled, partial):
        with pytest.raises(ValueError):
            JN.checked_block_join(base, bad, "session_id")
        with pytest.raises(Exception, match="repeated|absent"):
            JN.guarded_block_join(base, bad, "session_id").collect()
    with pytest.raises(KeyError):
        JN.guarded_block_join(base, good.withColumnRenamed("session_id", "x"), "session_id")


def test_cohort_refusal(spark):
    a = spark.createDataFrame([(1, "s", 1.0, 0.5), (2, "t", 0.0, 0.4)], "response_id int, session_id string, label double, pred double")
    b = spark.createDataFrame([(3, "s", 1.0, 0.5), (4, "t", 0.0, 0.4)], "response_id int, session_id string, label double, pred double")
    assert JN.cohort_audit(a, a).first().comparable
    facts = JN.cohort_audit(a, b).first()
    assert facts.only_reference == 2 and facts.only_candidate == 2
    with pytest.raises(ValueError):
        blend_report({"a": a, "b": b}, {"a": "session", "b": "session"})


def test_value_parity_nulls_and_tolerance(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 5.0)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 1.0 + 1e-12, None), (2, 2.5, None)], "k int, x double, y double")
    r = JN.value_parity(a, b, "k").first()
    assert (r.n_cells, r.n_bad_cells, r.n_bad_columns, r.max_abs_delta) == (4, 2, 2, 0.5)


def test_within_fold_auc_skips_small_and_single_class(spark):
    rng = random.Random(1)
    rows = [(0, float(rng.random() < 0.5), rng.random()) for _ in range(300)]
    rows += [(1, 1.0, 0.5)] * 300 + [(2, float(i % 2), 0.1 * i) for i in range(10)]
    r = ME.within_fold_auc(spark.createDataFrame(rows, "fold int, label double, pred double")).first()
    assert r.n_folds == 1 and r.n_skipped == 2 and r.sd_auc == 0.0


def test_constant_predictor_artefact(spark):
    rows = [(f, float(i < k), 0.0) for f, k in ((0, 8), (1, 2)) for i in range(10)]
    df = spark.createDataFrame(rows, "fold int, label double, pred double")
    assert np.isclose(ME.fold_constant_auc(df).first().pooled_auc, (8 * 8 + 0.5 * (8 * 2 + 2 * 8)) / 100)


@pytest.mark.parametrize("p", [0.0, 0.1, 0.2, 0.3, 0.6, 0.7, 0.999, 1.0])
def test_bin_edges(spark, p):
    got = spark.range(1).selectExpr(f"{ME.probability_bin(S.num(p))} AS b").first().b
    assert got == int(np.clip(np.digitize(p, np.linspace(0, 1, 11)[1:-1]), 0, 9))


def test_quantile_bins_with_repeated_edges(spark):
    xs = [1.0] * 6 + [2.0, 3.0, 4.0, 9.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = {r.x: r.bin for r in ME.quantile_bins(df, "x", 5, cells=3).collect()}
    edges = sorted(set(np.percentile(xs, [0, 20, 40, 60, 80, 100]).tolist()))
    for x in xs:
        want = max(1, sum(e < x for e in edges))
        assert got[x] == want


def test_scalars(spark):
    row = spark.range(1).selectExpr(
        f"{S.safe_div('1', '0')} AS z", f"{S.log_loss('1D', '0D')} AS worst", f"{S.clip_probability('1D')} AS c",
        f"{S.sigmoid(S.logit('0.3D'))} AS back", f"{S.blend_logit(['0.3D', 'CAST(NULL AS DOUBLE)'], ['0.5D', '0.5D'])} AS kept",
        f"{S.interpolate('0.35D', (0.1, 0.3, 0.5), (0.0, 0.4, 0.5))} AS i", f"{S.interpolate('0.9D', (0.1, 0.3), (0.0, 0.4))} AS top",
    ).first()
    assert row.z == 0 and np.isclose(row.worst, -math.log(1e-6)) and row.c == 1 - 1e-6 and np.isclose(row.back, 0.3)
    assert row.kept == 0.3 and np.isclose(row.i, 0.425) and row.top == 0.4


def test_shrinkage_keeps_ranking_and_crossfit_excludes_shared(spark, frame):
    shrunk = frame.selectExpr("label", "pred", f"{S.shrink('pred', '0.4D', '0.6D')} AS q")
    a = auc(shrunk, [], "label", "pred").first().auc
    assert np.isclose(a, auc(shrunk, [], "label", "q").first().auc)
    rows = [(d, i, float(i % 2), 0.9 if i % 2 else 0.1, 0.5) for d in range(3) for i in range(d * 10, d * 10 + 10)]
    rows += [(0, 99, 0.0, 0.999, 0.5), (1, 99, 0.0, 0.999, 0.5)]
    draws = spark.createDataFrame(rows, "draw int, response_id int, label double, pred double, base_rate double")
    got = by_key(BL.crossfit_shrinkage(draws), "eval_draw")
    assert got[0]["weight"] == 1.0 and got[1]["weight"] == 1.0  # the shared bad row never counts for them
    assert got[2]["weight"] < 1.0


def test_blend_search(spark, frame):
    best = BL.best_blend(BL.blend_losses(frame, ["pred", "pred_b"], BL.simplex(2, 10))).first()
    fine = BL.optimal_blend(frame, ["pred", "pred_b"])
    loss = lambda w: frame.selectExpr(f"avg({S.log_loss('label', S.blend_logit(['pred', 'pred_b'], [S.num(v) for v in w]))}) AS l").first().l
    assert np.isclose(sum(fine.weights), 1) and loss(fine.weights) <= loss(best.weights) + 1e-12 and np.isclose(loss(fine.weights), fine.logloss)
    assert len(BL.simplex(3, 4)) == 15 and all(np.isclose(sum(p), 1) for p in BL.simplex(3, 4))


def test_simplex_weights_are_optimal(spark):
    """Four models, one of them useless and one repeated: no other weights within reach are better."""
    rng = np.random.default_rng(3)
    truth = rng.normal(size=600)
    y = (rng.random(600) < 1 / (1 + np.exp(-truth))).astype(float)
    z = np.stack([truth + rng.normal(size=600), 0.5 * truth + rng.normal(size=600) * 0.7, -truth, truth + 0.1], axis=1)
    p = 1 / (1 + np.exp(-np.clip(z, -13, 13)))
    rows = [(float(t), *map(float, v)) for t, v in zip(y, p)] + [(1.0, 0.3, None, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "label double, a double, b double, c double, d double")
    best = BL.optimal_blend(df, list("abcd"))
    full = np.log(p / (1 - p))
    loss = lambda w: (np.logaddexp(0, full @ w) - y * (full @ w)).sum() - np.log(0.3)
    assert best.gap < 1e-6 and min(best.weights) >= 0 and np.isclose(sum(best.weights), 1) and min(best.weights) == 0 < sorted(best.weights)[1]
    assert np.isclose(loss(np.array(best.weights)) / 601, best.logloss)
    for other in rng.dirichlet([0.5] * 4, 3000):
        for step in (1.0, 0.1, 0.001):
            assert loss((1 - step) * np.array(best.weights) + step * other) >= loss(np.array(best.weights)) - 601 * 1e-9
    assert BL.optimal_blend(df, ["a"]).weights == (1.0,)


def test_harmful_text_is_not_promoted(spark):
    rows = [(i, i % 5, float(i % 2), 0.8 if i % 2 else 0.2) for i in range(100)]
    df = spark.createDataFrame(rows, "response_id int, fold int, label double, base double").selectExpr("*", "1 - base AS text")
    r = BL.promotion_gate(df, "base", "text", auc(df, [], "label", "text")).first()
    assert not r.promoted and r.deployment_weight == 0.0
    weights = {x.weight for x in BL.fold_weights(df, "base", "text").collect()}
    assert weights == {0.0}


def test_repeated_and_paired(spark):
    runs = spark.createDataFrame(
        [("a", s, v) for s, v in enumerate([0.5, 0.52, 0.51])] + [("b", s, v) for s, v in enumerate([0.48, 0.49])],
        "name string, seed int, value double")
    a = by_key(CO.summarize(runs), "name")["a"]
    v = np.array([0.5, 0.52, 0.51])
    assert np.isclose(a["sd"], v.std(ddof=1)) and np.isclose(a["ci95_low"], v.mean() - 1.96 * v.std(ddof=1) / 3**0.5)
    d = CO.summarize(CO.paired_delta(runs, "a")).first()
    assert d.n_seeds == 2 and np.isclose(d.mean, -0.025) and d.n_same_sign == 2 and d.excludes_zero
    assert by_key(CO.summarize(runs.where("seed = 0")), "name")["a"]["sd"] is None


def test_fold_assignment_promotion(spark):
    rows = [(s, f, 0.6, 0.6 + d) for s, d in enumerate([0.02, 0.03, 0.025, 0.021, 0.019]) for f in range(3)]
    df = spark.createDataFrame(rows, "fold_seed int, fold int, baseline_auc double, candidate_auc double")
    assert CO.fold_assignment_test(df).first().promotable
    assert not CO.fold_assignment_test(df.where("fold_seed < 3")).first().promotable


def test_experiment_ranking_needs_coverage(spark, frame):
    oof = frame.selectExpr("response_id", "label", "stack(2, 'a', pred, 'b', pred_b) AS (experiment, pred)")
    folds = frame.selectExpr("response_id", "0 AS fold")
    modes = spark.createDataFrame([("a", "objective")], "experiment string, split_mode string")
    got = by_key(score_experiments(oof, folds, modes, 0.6, 1.0), "experiment")
    assert got["a"]["evidence"] == "honest" and got["b"]["evidence"] == "optimistic" and got["a"]["place"] == 1
    assert score_experiments(oof, folds.limit(5), modes, 0.6, 1.0).count() == 0


FORMAT = [(f"r{i}", i) for i in range(20)]


@pytest.mark.parametrize("change,broken", [
    (lambda r: r, set()),
    (lambda r: [(i, 19 - p, x) for i, p, x in r], {"row_order_matches"}),
    (lambda r: r[:-1], {"row_count_matches", "row_set_matches", "row_order_matches"}),
    (lambda r: [(i, p, 1.5 if p == 3 else x) for i, p, x in r], {"probabilities_in_unit_interval", "probabilities_clipped_off_0_and_1"}),
    (lambda r: [(i, p, 1.0 if p == 3 else x) for i, p, x in r], {"probabilities_clipped_off_0_and_1"}),
    (lambda r: [(i, p, float("nan") if p == 3 else x) for i, p, x in r],
     {"no_nan_probabilities", "probabilities_in_unit_interval", "probabilities_clipped_off_0_and_1"}),
    (lambda r: [(None if p == 3 else i, p, x) for i, p, x in r],
     {"no_missing_response_id", "row_set_matches", "row_order_matches"}),
])
def test_output_contract(spark, change, broken):
    expected = spark.createDataFrame(FORMAT, "response_id string, pos int")
    made = spark.createDataFrame(change([(i, p, 0.4) for i, p in FORMAT]), "response_id string, pos int, probability double")
    result = {r.rule: r.passed for r in QU.output_contract(made, expected).collect()}
    assert len(result) == 8 and {k for k, v in result.items() if not v} == broken


def test_prediction_sink_fills_and_orders(spark):
    want = spark.createDataFrame(FORMAT, "response_id string, pos int")
    made = spark.createDataFrame([("r3", 2.0), ("r1", 0.2)], "response_id string, probability double")
    got = QU.prediction_sink(want, made, 0.31).collect()
    assert [r.response_id for r in got] == [i for i, _ in FORMAT]
    assert got[3].probability == 1 - 1e-6 and got[1].probability == 0.2 and got[0].probability == 0.31


def test_variance_decomposition(frame, rows):
    r = variance_decomposition(frame).first()
    groups = {}
    for x in rows:
        groups.setdefault(x[1], []).append(x[3])
    within = sum(len(g) * np.var(g) for g in groups.values()) / len(rows)
    assert np.isclose(r.within_variance, within) and np.isclose(r.total_variance, np.var([x[3] for x in rows]))


def test_sampling(spark, frame, rows):
    sample = SA.per_group_sample(frame, "session_id", "response_id", 240, seed=1).collect()
    per = {}
    for r in sample:
        per[r.session_id] = per.get(r.session_id, 0) + 1
    sizes = {}
    for x in rows:
        sizes[x[1]] = sizes.get(x[1], 0) + 1
    assert per == {s: min(2, n) for s, n in sizes.items()}
    assert [r.session_id for r in SA.first_cohort(frame, "session_id", "response_id", 3).collect()] == ["s000", "s001", "s002"]
    kept = SA.collapse_rare(frame, "objective_id", keep=2).select("objective_id").distinct().collect()
    assert len(kept) == 3 and "(other)" in {r.objective_id for r in kept}


def test_large_share_sampling_equals_the_ranked_limit(spark, monkeypatch):
    df = spark.range(300).selectExpr("id AS response_id", "CASE WHEN id < 250 THEN 'hot' ELSE 'cold' END AS session_id")
    ranked = {r.response_id for r in SA.per_group_sample(df, "session_id", "response_id", 120, seed=1).collect()}
    monkeypatch.setattr(SA, "GROUP_LIMIT", 10)
    assert ranked == {r.response_id for r in SA.per_group_sample(df, "session_id", "response_id", 120, seed=1).collect()}
    assert len(ranked) == 110


def walked_plainly(groups, k, stratified):
    """One group after another, costs as variances of exact fractions."""
    total_a = sum(n - p if stratified else n for n, p in groups)
    total_b = sum(p for _, p in groups)
    scale = [Fraction(max(t, k)) / k for t in (total_a, total_b)]
    held, rows, out = [[0, 0] for _ in range(k)], [0] * k, []
    for i, (n, p) in enumerate(groups):
        own = (n - p if stratified else n, p)

        def cost(j):
            trial = [[h[m] + (own[m] if f == j else 0) for f, h in enumerate(held)] for m in (0, 1)]
            mean = [Fraction(sum(t), k) for t in trial]
            return sum(sum((x - mu) ** 2 for x in t) / k / s**2 for t, mu, s in zip(trial, mean, scale))

        best = min(range(k), key=lambda j: (cost(j), rows[j] if stratified else 0, j))
        fold = i if not stratified and i < k else best
        held[fold] = [held[fold][0] + own[0], held[fold][1] + own[1]]
        rows[fold] += n
        out.append(fold)
    return out


@pytest.mark.parametrize("stratified", [True, False])
@pytest.mark.parametrize("shape", ["mixed", "one giant", "few", "equal"])
def test_greedy_folds_equal_the_walk(spark, stratified, shape):
    rng = random.Random(8)
    sizes = {"mixed": [(n, rng.randint(0, n)) for n in [rng.choice([1, 1, 1, 2, 3, 7, 40]) for _ in range(150)]],
             "one giant": [(90, 30)] + [(1, i % 2) for i in range(130)], "few": [(3, 1), (2, 2)], "equal": [(2, 1)] * 23}[shape]
    groups = [(f"g{i}", n, p) for i, (n, p) in enumerate(sizes)]
    df = spark.createDataFrame(groups, "g string, n long, n_pos long").repartition(3)
    got = {r.g: r.fold for r in FO.greedy(df, 4, 7, "g", stratified).collect()}
    hashed = lambda g: hashlib.md5(f"{g}|7".encode()).hexdigest()
    ordered = sorted(groups, key=lambda x: ((-abs(x[1] - 2 * x[2]) if stratified else 0), -x[1], -x[2], hashed(x[0])))
    want = walked_plainly([x[1:] for x in ordered], 4, stratified)
    assert [got[x[0]] for x in ordered] == want and len(got) == len(groups)


def test_greedy_folds_are_more_even_than_the_snake(spark):
    rng = random.Random(2)
    groups = [(i, n, rng.randint(0, n)) for i, n in enumerate([int(200 * rng.random() ** 6) + 1 for _ in range(120)])]
    df = spark.createDataFrame(groups, "g long, n long, n_pos long")

    def spread(dealt):
        totals = [r.n for r in dealt.join(df.select("g", "n"), "g").groupBy("fold").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()]
        return np.var(totals)

    assert spread(FO.greedy(df, 5, 0, "g", False).select("g", "fold")) < spread(FO.deal(df, ("n", "n_pos"), 5, 0, "g").select("g", "fold"))


def test_a_class_of_any_size_takes_few_phases():
    plan = FO.phases([0, 10**15, 7, 7], [0, 0, 0, 0], 3, 1, 10**18)
    assert len(plan) <= 8 and plan[0] == (0, [0]) and sorted(plan[-1][1]) == [0, 1, 2, 3]
