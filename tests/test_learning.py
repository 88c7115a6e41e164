from __future__ import annotations

import random

import numpy as np
import pytest

from conftest import by_key
from test_responses import SCHEMA, make
from turnwise.operators import boosting as BO
from turnwise.operators import folds as FO
from turnwise.operators import isotonic as IS
from turnwise.operators import moments as MO
from turnwise.operators import newton as NE
from turnwise.operators import sparse as SP
from turnwise.operators import vocabulary as VO
from turnwise.operators.ordered import aggregate
from turnwise.plans import learning as LN
from turnwise.plans.scoring import score_batch, score_new


@pytest.fixture(scope="module")
def matrix(spark):
    rows = make(2, sessions=80)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "pred AS f1", "CASE WHEN response_id % 7 = 0 THEN NULL ELSE pred_b END AS f2")
    return LN.cut(FO.session_folds(df, 3))


def test_out_of_fold_covers_every_row(matrix):
    oof, gains = LN.out_of_fold(matrix, ["f1", "f2"], LN.boosted_trees(3, 2), range(3), importance=True, k=3)
    assert oof.count() == matrix.count() == oof.select("response_id").distinct().count()
    assert oof.selectExpr("max(pred) - min(pred) AS d").first().d > 0.01
    assert {r.feature for r in gains.collect()} == {"f1", "f2", "lo_prior_enc"}


@pytest.fixture(scope="module")
def fitted(matrix):
    return LN.fit_fold_models(matrix, ["f1", "f2"], LN.boosted_trees(4, 2), range(3), k=3, pca=(["f1", "pred_b"], 1))


def test_saved_models_give_the_same_predictions(spark, matrix, fitted, tmp_path):
    models, oof = fitted
    models.save(str(tmp_path))
    back = LN.FoldModels.load(spark, str(tmp_path))
    want = {(r.response_id, r.fold): r.pred for r in oof.collect()}
    for fold in range(3):
        for r in back.score(matrix.where(f"fold = {fold}"), [fold]).collect():
            assert abs(r.pred - want[r.response_id, fold]) < 1e-12
    facts = tmp_path / "facts"
    line = next(p for p in facts.iterdir() if p.name.startswith("part-"))
    line.write_text(line.read_text().replace('"f1", "f2"', '"f2", "f1"'))
    (facts / f".{line.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="expects"):
        LN.FoldModels.load(spark, str(tmp_path))
    with pytest.raises(ValueError, match="absent"):
        models.score(matrix.drop("f2"))


def test_new_rows_are_scored_by_every_fold_model(spark, matrix, fitted):
    required = matrix.selectExpr("response_id", "response_id AS pos").unionByName(spark.range(1).selectExpr("-5 AS response_id", "-5 AS pos"))
    unseen = matrix.selectExpr(*[c for c in matrix.columns if c != "objective_id"], "'never seen' AS objective_id")
    rows = score_new(fitted[0], required, unseen.where("response_id % 2 = 0"), fallback=0.25).collect()
    got = {r.response_id: r.probability for r in rows}
    assert len(got) == matrix.count() + 1 and got[-5] == 0.25 and all(0 < p < 1 for p in got.values())
    per_fold = fitted[0].score(unseen.where("response_id = 2"))
    assert per_fold.count() == 3 and np.isclose(got[2], np.mean([r.pred for r in per_fold.collect()]))


def test_validation_labels_do_not_move_training_encodings(matrix):
    turned = matrix.selectExpr(*[c for c in matrix.columns if c != "label"], "CASE WHEN fold = 1 THEN 1 - label ELSE label END AS label")
    maps = [{r.objective_id: r.encoding for r in LN.fit_fold_models(
        m, ["f1"], LN.logistic(iterations=2), [1], k=3)[0].priors.collect()} for m in (matrix, turned)]
    assert maps[0] == maps[1] and maps[0]


def test_objective_mode_purges_and_refuses_encodings(matrix):
    rows = matrix.drop("fold").join(FO.objective_folds(matrix.drop("fold"), 3).select("response_id", "fold"), "response_id")
    with pytest.raises(ValueError, match="unseen"):
        LN.fit_fold_models(rows, ["f1"], LN.logistic(), range(3), mode="objective", k=3)
    models, oof = LN.fit_fold_models(rows, ["f1"], LN.logistic(iterations=3), [0], mode="objective", encode=False, k=3)
    purged = FO.purged_training(rows, 3).where("train_fold = 0")
    assert np.isclose(models.rates[0], purged.agg({"label": "avg"}).first()[0])
    assert oof.count() == rows.where("fold = 0").count() and purged.count() < rows.where("fold <> 0").count()


def test_text_difficulty_inside_the_folds(spark, matrix):
    rows = matrix.withColumn("objective_text", LN.F.concat(LN.F.lit("topic "), LN.F.col("objective_id").cast("string")))
    models, oof = LN.fit_fold_models(rows, ["f1"], LN.logistic(iterations=3), [0], encode=False, k=3, text=True)
    again = {r.response_id: r.pred for r in models.score(rows.where("fold = 0")).collect()}
    assert all(np.isclose(r.pred, again[r.response_id], atol=1e-9) for r in oof.collect())


def test_bounded_vocabulary_and_weights(spark):
    texts = [(1, ["a", "b", "b", "b"]), (2, ["a"]), (3, ["a", "c", "c"]), (4, ["z"]), (5, [])]
    counts = VO.term_counts(spark.createDataFrame(texts, "id int, grams array<string>"), ["id"])
    terms = VO.dictionary(counts, 1, most=3)
    assert [(r.term, r.id, r.df, r.n) for r in terms.orderBy("id").collect()] == [("a", 0, 3, 3), ("b", 1, 1, 3), ("c", 2, 1, 2)]
    assert [r.term for r in VO.dictionary(counts, 2).collect()] == ["a"]
    got = by_key(VO.term_weights(counts, terms, 5, ["id"]), "id", "term")
    a, b = np.log(6 / 4) + 1, (1 + np.log(3)) * (np.log(6 / 2) + 1)
    assert np.isclose(got[1, "b"]["weight"], b / np.hypot(a, b)) and got[2, "a"]["weight"] == 1.0 and (4, "z") not in got


def test_fold_models_know_only_the_texts_outside(spark):
    """Every fold's model equals one fitted alone on the texts outside the fold."""
    rng = random.Random(9)
    rows = [(i, i % 3, float(i % 2), rng.choice([1.0, 3.0]), [rng.choice("abcdefg") for _ in range(6)] + ["up" if i % 2 else "down"] * (i % 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, fold int, label double, weight double, grams array<string>")
    all_folds = VO.fit_fold_terms(df, "id", [-1, 0, 1, 2], [1, 2, 2, 2])
    z = by_key(all_folds.margins(df, "id"), "id")
    alone = VO.fit_fold_terms(df.where("fold <> 1").withColumn("fold", LN.F.lit(7)), "id", [-1], [2])
    want = by_key(alone.margins(df, "id"), "id")
    assert all(np.isclose(z[i]["z"][2], want[i]["z"][0], atol=1e-9) for i in z)
    assert z[1]["z"][0] > z[2]["z"][0]


def test_validation_covariates_do_not_move_the_pca(spark, matrix):
    moved = matrix.selectExpr(*[c for c in matrix.columns if c not in ("f1", "pred_b")],
                              "CASE WHEN fold = 0 THEN f1 * 100 ELSE f1 END AS f1", "pred_b")
    a = by_key(LN.fold_safe_pca(matrix, ["f1", "pred_b"], 0, 1).where("fold <> 0"), "response_id")
    b = by_key(LN.fold_safe_pca(moved, ["f1", "pred_b"], 0, 1).where("fold <> 0"), "response_id")
    assert all(np.isclose(abs(a[i]["cont_00"]), abs(b[i]["cont_00"])) for i in a)
    assert abs(np.mean([v["cont_00"] for v in a.values()])) < 1e-9  # centred on training rows


def test_components_of_all_folds_from_one_pass(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + 1e6
    df = spark.createDataFrame([(i, i % 3, *map(float, v)) for i, v in enumerate(x)], "id int, fold int, a double, b double, c double, d double, e double")
    found = MO.fold_components(df.repartition(4), list("abcde"), 2)
    for f, (mean, vectors, values) in found.items():
        own = x[np.arange(300) % 3 != f]
        matrix = np.cov(own.T)
        assert np.allclose(mean, own.mean(axis=0)) and np.allclose(matrix @ vectors, vectors * values, rtol=1e-6, atol=1e-6)
        assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:2], rtol=1e-6) and (vectors[np.abs(vectors).argmax(axis=0), [0, 1]] > 0).all()
    scored = by_key(LN.pca_by_fold(df, list("abcde"), [0, 1, 2], 2), "id", "model_fold")
    assert len(scored) == 900 and np.isclose(scored[7, 2]["cont_01"], (x[7] - found[2][0]) @ found[2][1][:, 1])


def test_character_grams(spark):
    df = spark.createDataFrame([(1, "ab c"), (2, ""), (3, None), (4, "ab ab")], "response_id int, text string")
    rows = by_key(LN.hashed_grams(df, buckets=1 << 16), "response_id")
    # word part: "ab" only; characters: " ab", "ab ", " ab " and " c "
    words = [v for b, v in zip(rows[1]["buckets"], rows[1]["values"]) if b < 1 << 16]
    assert words == [1.0] and len(rows[1]["values"]) == 5 and np.isclose(np.linalg.norm(rows[1]["values"]), 2**0.5)
    assert rows[2]["buckets"] == rows[3]["values"] == []
    assert sorted(v for b, v in zip(rows[4]["buckets"], rows[4]["values"]) if b < 1 << 16) == pytest.approx([1 / 5**0.5, 2 / 5**0.5])


def test_grams_hash_as_spark_does_and_are_counted_in_stretches(spark, monkeypatch):
    from turnwise.operators import grams as GR

    words = ["", "a", "abc", " ab ", "Éé", "\U0001F600x", "ß\x00z", "İstan", "abcde"]
    want = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").selectExpr("hash(w)").collect()]
    assert GR.murmur([w.encode() for w in words]).tolist() == want
    texts = spark.createDataFrame([(i, " ".join(words[1:1 + i % 9] * (i % 4))) for i in range(40)] + [(40, None)], "response_id int, text string")
    whole = by_key(LN.hashed_grams(texts, buckets=61), "response_id")
    monkeypatch.setattr(GR, "ENTRIES", 7)
    assert by_key(LN.hashed_grams(texts, buckets=61), "response_id") == whole
    for i, row in whole.items():  # against plain counting
        text = row["text"] or ""
        counts = {}
        for w in text.lower().split():
            for n in (3, 4, 5):
                for j in range(len(w) + 3 - n):
                    g = f" {w} "[j:j + n]
                    at = 61 + GR.murmur([g.encode()])[0] % 61
                    counts[at] = counts.get(at, 0) + 1
        length = sum(c * c for c in counts.values()) ** 0.5
        got = {b: v for b, v in zip(row["buckets"], row["values"]) if b >= 61}
        assert got == pytest.approx({b: c / length for b, c in counts.items()})


def test_blocks_of_texts_equal_their_counted_grams(spark):
    from turnwise.operators import grams as GR

    words = ["abc", "ab", "Éé", "x", "😀x", "İstan", "abcde", "hello", "held", "a\tb\x0bc", "d\u00a0e\x1cf"]
    rows = [(i, i % 4, float(i % 2), "  ".join(words[i % 7:] * (1 + i % 5) + words[:i % 3] + words[-(i % 3):])) for i in range(60)] + [(60, 0, 1.0, ""), (61, 1, 0.0, None)]
    texts = LN.cut(spark.createDataFrame([(i, "s", f, y, t) for i, f, y, t in rows], "response_id int, session_id string, fold int, label double, text string").repartition(3))
    blocks = LN.packed_grams(texts, "text", 61, entries=150, dense=40)
    assert "text" not in blocks.columns and blocks.count() > 6
    plain = SP.packed(LN.hashed_grams(texts, buckets=61).selectExpr("fold", "label", "1D AS weight", "buckets", "values"))
    weights = np.random.default_rng(3).normal(size=(123, 3))
    residual = SP.outside_folds(range(3))
    assert np.allclose(SP.gradients(blocks, residual, weights, opened=GR.opened_grams(61)), SP.gradients(plain, residual, weights), atol=1e-12)
    scored = by_key(SP.score_elastic(LN.hashed_grams(texts, buckets=61).where("fold < 3"), weights, range(3)), "response_id")
    got = by_key(SP.score_blocks(blocks, GR.opened_grams(61, True), weights, range(3), texts.drop("text").schema), "response_id")
    assert got.keys() == scored.keys() and all(abs(got[i]["pred"] - r["pred"]) < 1e-12 and got[i]["label"] == r["label"] for i, r in scored.items())
    out = by_key(LN.text_out_of_fold(texts, range(3), steps=5, buckets=61), "response_id")
    want = SP.fit_elastic(LN.hashed_grams(texts, buckets=61), range(3), 122, steps=5)
    want = by_key(SP.score_elastic(LN.hashed_grams(texts, buckets=61).where("fold < 3"), want, range(3)), "response_id")
    assert out.keys() == want.keys() and all(abs(out[i]["pred"] - r["pred"]) < 1e-12 for i, r in want.items())


def test_trees_route_columns_of_codes_as_a_walk_does():
    from turnwise.operators.boosting import Node, Shape

    tree = [Node(0.0, 0, 3, True, 1, 2), Node(1.5), Node(0.0, 1, 0, False, 3, 4), Node(-2.0), Node(7.0)]
    codes = np.random.default_rng(1).integers(0, 9, (500, 2)).astype(np.uint8)  # 8: missing

    def walk(row):
        at = 0
        while tree[at].feature >= 0:
            n = tree[at]
            at = n.left if (n.missing_left if row[n.feature] == 8 else row[n.feature] <= n.border) else n.right
        return tree[at].value

    columns = np.ascontiguousarray(codes.T)
    assert Shape(tree, 8).values(columns).tolist() == [walk(r) for r in codes]
    assert Shape([Node(3.0)], 8).values(columns).tolist() == [3.0] * 500


def test_packed_blocks_hold_every_row(spark, monkeypatch):
    rows = [(i % 3, float(i), 1.0, list(range(i % 5)), [i + j / 7 for j in range(i % 5)]) for i in range(50)]
    rows.append((0, 99.0, 2.0, list(range(70_000)), [j / 3 for j in range(70_000)]))  # more distinct values than short codes
    df = LN.cut(spark.createDataFrame(rows, "fold int, label double, weight double, buckets array<int>, values array<double>").repartition(2))
    monkeypatch.setattr(SP, "BLOCK_ENTRIES", 16)
    got, blocks = [], SP.packed(df).toArrow().to_batches()
    for block in (b for batch in blocks for b in SP._blocks(batch)):
        ends = block.sizes.cumsum().tolist()
        got += [(int(f), float(y), float(w), block.buckets[e - n:e].tolist(), block.values[e - n:e].tolist())
                for f, y, w, n, e in zip(block.fold, block.label, block.weight, block.sizes.tolist(), ends)]
    assert len(blocks) and sorted(got) == sorted(rows)


def test_sparse_fit_equals_a_plain_solver(spark):
    rng = np.random.default_rng(2)
    size, n, reg, elastic = 30, 150, 1e-2, 0.3
    x = np.zeros((n, size))
    for row in x:
        at = rng.choice(size, 4, replace=False)
        row[at] = rng.random(4)
        row /= np.linalg.norm(row) / 2**0.5
    y = (rng.random(n) < 1 / (1 + np.exp(-4 * (x[:, 0] - x[:, 1])))).astype(float)
    fold = np.arange(n) % 3
    rows = [(i, int(fold[i]), float(y[i]), np.flatnonzero(x[i]).tolist(), x[i][x[i] != 0].tolist()) for i in range(n)]
    df = LN.cut(spark.createDataFrame(rows, "response_id int, fold int, label double, buckets array<int>, values array<double>").repartition(3))
    got = SP.fit_elastic(df, range(3), size, reg, elastic, steps=150, tolerance=1e-7)
    for k in range(3):
        keep = fold != k
        design, w = np.c_[x[keep], np.ones(keep.sum())], np.zeros(size + 1)
        rate, free = 1 / (0.75 + reg), np.r_[np.ones(size), 0.0]
        for _ in range(20_000):  # plain proximal descent
            z = w - rate * (design.T @ (1 / (1 + np.exp(-design @ w)) - y[keep]) / keep.sum() + reg * (1 - elastic) * free * w)
            w = np.sign(z) * np.maximum(np.abs(z) - rate * reg * elastic * free, 0)
        assert np.allclose(got[:, k], w, atol=1e-3) and (w[:size] == 0).any()
        own = by_key(SP.score_elastic(df, got, range(3)).where(f"fold = {k}"), "response_id")
        for i in np.flatnonzero(~keep):
            assert np.isclose(own[i]["pred"], 1 / (1 + np.exp(-(x[i] @ w[:size] + w[size]))), atol=1e-3)
    with pytest.raises(ValueError, match="exceed"):
        SP.fit_elastic(df, range(3), 1 << 30)


def test_calibration_recovers_a_distortion(spark):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        p = rng.random()
        rows.append((i, i % 3, float(rng.random() < p), float(p**2)))
    df = spark.createDataFrame(rows, "response_id int, fold int, label double, pred double")
    chosen, losses = LN.choose_calibrator(df, range(3))
    table = by_key(losses, "method")
    assert chosen["method"] in ("platt", "isotonic")
    assert min(table["platt"]["logloss"], table["isotonic"]["logloss"]) < table["none"]["logloss"]
    done = LN.with_calibration(df, chosen).orderBy("pred").collect()
    assert len(done) == 3000 and all(a.calibrated <= b.calibrated for a, b in zip(done, done[1:]))


def pooled_plainly(points):
    """Isotonic values at the distinct scores of (x, y, weight)."""
    sums = {}
    for x, y, w in points:
        t, n = sums.get(x, (0.0, 0.0))
        sums[x] = (t + y * w, n + w)
    blocks = []
    for x in sorted(sums):
        blocks.append([[x], *sums[x]])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] > blocks[-1][1] / blocks[-1][2]:
            xs, t, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + xs, blocks[-1][1] + t, blocks[-1][2] + n]
    return {x: t / n for xs, t, n in blocks for x in xs}


@pytest.mark.parametrize("per_task", [7, 10**6])
@pytest.mark.parametrize("shape", ["noise", "falling", "rising", "ties"])
def test_isotonic_blocks_equal_plain_pooling(spark, monkeypatch, per_task, shape):
    rng = random.Random(3)
    make_y = {"noise": lambda x: float(rng.random() < x), "falling": lambda x: 1 - x, "rising": lambda x: x, "ties": lambda x: float(rng.random() < 0.5)}[shape]
    scores = [round(rng.random(), 1 if shape == "ties" else 4) for _ in range(200)]
    points = [(k, x, make_y(x), rng.choice([1.0, 2.0])) for k in (0, 1) for x in scores]
    df = spark.createDataFrame(points, "key long, x double, y double, weight double")
    blocks = IS.isotonic_blocks(df, per_task)
    asked = sorted({p[1] for p in points} | {0.0, 1.0, 0.12345})
    monkeypatch.setattr(IS, "GROUP_ROWS", per_task)
    got = IS.interpolated(spark.createDataFrame([(k, x) for k in (0, 1) for x in asked] + [(0, None), (5, 0.5)], "key long, x double"), blocks).collect()
    value = {(r.key, r.x): r.fitted for r in got}
    assert value.pop((0, None)) is None and value.pop((5, 0.5)) is None and len(value) == 2 * len(asked)
    for k in (0, 1):
        fit = pooled_plainly([p[1:] for p in points if p[0] == k])
        xs = sorted(fit)
        for x in asked:
            assert np.isclose(value[k, x], np.interp(x, xs, [fit[v] for v in xs]), atol=1e-12)


def test_isotonic_of_many_scores(spark):
    df = spark.range(1_000_000).selectExpr("0L AS key", "xxhash64(id) / 1.8446744073709552E19 + 0.5 AS x", "id").selectExpr(
        "key", "x", "CASE WHEN pmod(xxhash64(id, 1), 1000) < 1000 * x * x THEN 1D ELSE 0D END AS y", "1D AS weight")
    blocks = LN.cut(IS.isotonic_blocks(df, per_task=200_000))
    facts = blocks.selectExpr("sum(weight) AS n", "sum(weight * value) AS y", "count(1) AS n_blocks").first()
    total = df.agg({"y": "sum"}).first()[0]
    assert facts.n == 1_000_000 and np.isclose(facts.y, total) and facts.n_blocks < 20_000
    rows = blocks.orderBy("lo").collect()
    assert all(a.hi < b.lo and a.value <= b.value for a, b in zip(rows, rows[1:]))
    xs, ys = zip(*[(r.x, r.y) for r in df.collect()])
    fit = pooled_plainly([(x, y, 1.0) for x, y in zip(xs, ys)])
    assert all(np.isclose(fit[r.lo], r.value) and np.isclose(fit[r.hi], r.value) for r in rows)


def test_newton_reaches_the_optimum_of_every_run(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [2.0, -1.0] + 0.5)))).astype(float)
    df = LN.cut(spark.createDataFrame([(i % 3, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], "fold int, a double, b double, label double"))
    runs = {"all": "true", "0": "fold <> 0", "none": "fold > 7"}
    got = NE.fit_logistic(df, runs, ["a", "b"])
    design = np.c_[x, np.ones(400)]
    for name, keep in (("all", np.ones(400, bool)), ("0", np.arange(400) % 3 != 0)):
        p = 1 / (1 + np.exp(-design[keep] @ got[name]))
        assert np.abs(design[keep].T @ (p - y[keep]) + 1e-6 * got[name] * [1, 1, 0]).max() < 1e-6
    assert (got["none"] == 0).all()
    apart = NE.fit_logistic(df.selectExpr("*", "CASE WHEN label = 1 THEN 1D ELSE -1D END AS s"), {"all": "true"}, ["s"])
    assert np.isfinite(apart["all"]).all() and apart["all"][0] > 3


def test_move_classifier_report(spark):
    rows = [(f"s{i}", i, "tutor", t, m) for i, (t, m) in enumerate([("well done you", "affirming"), ("try again now", "correcting")] * 20)]
    turns = spark.createDataFrame(rows, "session_id string, pos int, role string, content string, move string")
    model = LN.fit_move_classifier(turns)
    scored = LN.predict_moves(model, turns.drop("move")).join(turns.select("session_id", "move"), "session_id")
    report = by_key(LN.classification_report(scored), "class")
    assert report["affirming"]["f1"] == 1.0 and report["(all)"]["recall"] == 1.0
    half = scored.withColumn("predicted_move", LN.F.lit("affirming"))
    r = by_key(LN.classification_report(half), "class")
    assert r["affirming"]["precision"] == 0.5 and r["correcting"]["f1"] == 0.0 and np.isclose(r["(all)"]["f1"], 1 / 3)


def test_text_difficulty_uses_base_rate_when_it_must(spark):
    rows = [(i, f"o{i % 4}", "" if i % 4 == 0 else f"topic {'easy' if i % 4 < 3 else 'hard'}", float(i % 4 < 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "response_id int, objective_id string, objective_text string, label double")
    got = by_key(LN.text_difficulty(df.where("response_id < 30"), df.where("response_id >= 30")), "response_id")
    base = np.mean([r[3] for r in rows[:30]])
    assert len(got) == 40 and all(np.isclose(got[i]["lo_text_difficulty"], base) for i in range(30))
    assert np.isclose(got[32]["lo_text_difficulty"], base)  # blank text
    assert got[31]["lo_text_difficulty"] < got[33]["lo_text_difficulty"]


def test_inner_text_difficulty_ignores_own_objective(spark):
    rows = [(i, f"o{i % 12:02d}", f"topic w{i % 12} {'a' if i % 12 < 6 else 'b'}", float(i % 12 < 6)) for i in range(96)]
    df = spark.createDataFrame(rows, "response_id int, objective_id string, objective_text string, label double")
    flip = df.withColumn("label", LN.F.expr("CASE WHEN objective_id = 'o03' THEN 1 - label ELSE label END"))
    valid = df.where("response_id < 0")
    a = by_key(LN.text_difficulty(df, valid).where("objective_id = 'o03'"), "response_id")
    b = by_key(LN.text_difficulty(flip, valid).where("objective_id = 'o03'"), "response_id")
    assert all(np.isclose(a[i]["lo_text_difficulty"], b[i]["lo_text_difficulty"]) for i in a)


def test_domain_folds_keep_domains_whole(spark):
    rng = random.Random(6)
    sessions = spark.createDataFrame([(f"s{i}", rng.gauss(i % 4 * 10, 1), None if i % 9 == 0 else 1.0) for i in range(60)],
                                     "session_id string, a double, b double")
    domains = LN.session_domains(sessions, ["a", "b"], 4)
    rows = sessions.selectExpr("session_id", "session_id AS response_id", "1D AS label")
    folds = LN.domain_folds(rows, domains, 3)
    assert folds.count() == 60 and FO.split_groups(folds, "domain_id").count() == 0


def test_batch_scoring_falls_back_to_priors(spark):
    need = spark.createDataFrame([(1, 0, "a"), (2, 1, "b"), (3, 2, "c")], "response_id int, pos int, objective_id string")
    folds = spark.createDataFrame([(1, 0.4), (1, 0.6)], "response_id int, pred double")
    priors = spark.createDataFrame([("b", 0.7)], "objective_id string, encoding double")
    got = score_batch(need, folds, need, priors, shrinkage=(0.5, 0.3), fallback=0.25).collect()
    assert [round(r.probability, 6) for r in got] == [0.4, 0.7, 0.25]


def test_repeated_and_ablation(matrix):
    out = by_key(LN.ablation(matrix.drop("fold"), {"x": ["f1"], "y": ["f2"]}, LN.logistic(iterations=5), seeds=(0, 1), k=2), "name")
    assert set(out) == {"without_x", "without_y"} and out["without_x"]["n_seeds"] == 2
    assert out["without_x"]["mean"] > out["without_y"]["mean"]  # f1 carries the signal


def test_run_loss(spark):
    df = spark.createDataFrame([(1.0, 0.5), (0.0, 0.5)], "label double, pred double")
    assert np.isclose(LN.run_loss(df, "m", 3).first().value, np.log(2))
    assert aggregate(df, [], "count(1) AS n").first().n == 2


def test_tree_queries_do_the_described_work(spark):
    from turnwise.catalog import learning as queries

    trees = queries.TREES()
    assert trees.getMaxIter() >= 200 and trees.getValidationIndicatorCol() == "is_validation"
    assert sorted(f for block in queries.BLOCKS.values() for f in block) == sorted(queries.FEATURES)
    assert len(set(queries.SEEDS)) == 5


def plain_boost(rows, columns, held, how, borders):
    """The same boosting in a few plain loops over rows; returns held-out margins by number of trees."""
    codes = [[sum(x > b for b in borders[c]) if x is not None else how.bins for c, x in enumerate(r[2:])] for r in rows]
    y = [r[1] for r in rows]
    train = [i for i, r in enumerate(rows) if r[0] != held and r[0] >= 0]
    rate = sum(y[i] for i in train) / len(train)
    margin, steps = [np.log(rate / (1 - rate))] * len(rows), []
    for _ in range(how.rounds):
        p = [1 / (1 + np.exp(-m)) for m in margin]
        leaves, value = {0: list(range(len(rows)))}, {0: 0.0}
        fresh, number = [0], 1
        for _ in range(how.depth):
            found = []
            for leaf in leaves if fresh else ():
                own = [i for i in leaves[leaf] if rows[i][0] != held and rows[i][0] >= 0]
                worth = lambda g, h: g * g / (h + how.ridge)
                g, h = sum(p[i] - y[i] for i in own), sum(p[i] * (1 - p[i]) for i in own)
                best = None
                for c in range(len(columns)):
                    for b in range(how.bins):
                        for m in (False, True):
                            goes = [i for i in own if (m if codes[i][c] == how.bins else codes[i][c] <= b)]
                            if min(len(goes), len(own) - len(goes)) < how.least_rows:
                                continue
                            gl, hl = sum(p[i] - y[i] for i in goes), sum(p[i] * (1 - p[i]) for i in goes)
                            gain = (worth(gl, hl) + worth(g - gl, h - hl) - worth(g, h)) / 2
                            if best is None or gain > best[0] + 1e-12:
                                best = (gain, leaf, c, b, m, -gl / (hl + how.ridge), -(g - gl) / (h - hl + how.ridge))
                if best and best[0] > 1e-12:
                    found.append(best)
            fresh = []
            for _, leaf, c, b, m, left, right in sorted(found, key=lambda s: (-s[0], s[1]))[:how.leaves - len(leaves)]:
                goes = [i for i in leaves[leaf] if (m if codes[i][c] == how.bins else codes[i][c] <= b)]
                leaves[number], value[number] = goes, left
                leaves[number + 1], value[number + 1] = sorted(set(leaves[leaf]) - set(goes)), right
                del leaves[leaf], value[leaf]
                fresh += [number, number + 1]
                number += 2
        for leaf, own in leaves.items():
            for i in own:
                margin[i] += how.rate * value[leaf]
        steps.append(list(margin))
    return steps


def boosting_rows(n=240):
    rng = random.Random(12)
    rows = []
    for i in range(n):
        a, b = rng.choice([None, *map(float, range(9))]), rng.choice([None, None, rng.random()])
        rows.append((i % 4 - 1 if i % 9 == 0 else i % 3, float(rng.random() < (0.8 if a is None or a > 5 else 0.25 + 0.3 * (b or 0))), a, b))
    return rows


@pytest.mark.parametrize("merged,pending", [(64, 8), (2, 2)])
def test_shared_trees_equal_plain_boosting(spark, monkeypatch, merged, pending):
    monkeypatch.setattr(BO, "MERGED", merged)
    monkeypatch.setattr(BO, "PENDING", pending)
    rows = boosting_rows()
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, side int, label double, a double, b double").repartition(5)
    how = BO.Trees(rounds=5, rate=0.3, leaves=5, bins=6, least_rows=12, patience=None, row_share=1.0)
    runs = [BO.Run(str(f), "side", f, ("a", "b")) for f in range(3)] + [BO.Run("only a", "side", 0, ("a",))]
    out, forest = BO.boost(frame, "id", runs, how)
    assert forest.kept == [5] * 4 and any(n.missing_left for t in forest.trees[0] for n in t)
    got = {}
    for r in out.collect():
        got.setdefault(r.run, {})[r.id] = r.pred
    for run in runs:
        shown = [r if "b" in run.columns else r[:3] for r in rows]
        want = plain_boost(shown, run.columns, run.held, how, forest.borders)[-1]
        assert got[run.name].keys() == {i for i, r in enumerate(rows) if r[0] == run.held}
        for i, p in got[run.name].items():
            assert abs(p - 1 / (1 + np.exp(-want[i]))) < 1e-9
        loss = np.mean([-np.log(p if rows[i][1] else 1 - p) for i, p in got[run.name].items()])
        assert abs(forest.losses[runs.index(run)][5] - loss) < 1e-9


def test_shared_trees_stop_by_held_out_rows_and_take_odd_rows(spark):
    rows = [(i, *r) for i, r in enumerate(boosting_rows())] + [(900, 0, None, 1.0, None), (901, None, 1.0, float("nan"), None), (902, 1, 1.0, None, float("inf"))]
    frame = spark.createDataFrame(rows, "id long, side int, label double, a double, b double")
    out, forest = BO.boost(frame, "id", [BO.Run("0", "side", 0, ("a", "b")), BO.Run("1", "side", 1, ("a", "b"))], BO.Trees(rounds=40, rate=0.5, least_rows=10, patience=3))
    for losses, kept in zip(forest.losses, forest.kept, strict=True):
        assert kept == int(np.argmin(losses)) and (len(losses) == 41 or len(losses) - 1 - kept == 3)
    seen = {(r.run, r.id): r.pred for r in out.collect()}
    assert ("0", 900) in seen and ("1", 902) in seen and all(0 < p < 1 for p in seen.values())
    assert not any(i == 901 for _, i in seen)
    empty, _ = BO.boost(frame.limit(0), "id", [BO.Run("0", "side", 0, ("a",))], BO.Trees(rounds=2))
    assert empty.count() == 0


def test_equal_rows_are_one_cell_and_equal_runs_grow_once(spark, monkeypatch):
    rows = [(i, *r) for i, r in enumerate(boosting_rows() * 8)]  # equal rows in plenty
    frame = LN.cut(spark.createDataFrame([(*r, r[1], (r[1] + 1) % 3) for r in rows], "id long, side int, label double, a double, b double, again int, other int").repartition(3))
    how = BO.Trees(rounds=4, rate=0.3, leaves=5, bins=6, least_rows=12, patience=None, row_share=0.7)
    runs = [BO.Run(f"{s}|{f}", s, f, ("a", "b")) for s in ("side", "again", "other") for f in range(3)]
    own, place = BO.alike(frame, runs)
    assert place == [0, 1, 2, 0, 1, 2, 3, 4, 5] and [r.assignment for r in own] == ["side"] * 3 + ["other"] * 3
    table, forest, _ = BO.prepared(frame, "id", runs, how)
    monkeypatch.setattr(BO, "BLOCK_ROWS", 300)
    blocks = [b for batch in BO.packed(table, forest.base).toArrow().to_batches() for b in BO._opened(batch, 2)]
    assert len(blocks) > 3 and sum(len(b[4]) for b in blocks) == len(rows)
    assert all(len({tuple(c) for c in b[0].T}) == b[0].shape[1] < len(b[2]) and b[1].shape == (6, b[0].shape[1]) for b in blocks)
    preds = []
    for least in (32 << 20, 0):  # summed by the driver, and in tasks
        monkeypatch.setattr(BO, "DIRECT_BYTES", least)
        out, forest = BO.boost(frame, "id", runs, how)
        assert forest.runs == runs and forest.trees[0] is forest.trees[3] and len(forest.losses) == 9
        preds.append({(r.run, r.id): r.pred for r in out.collect()})
        assert {k for k in preds[-1] if k[0] == "again|1"} == {("again|1", r[0]) for r in rows if r[1] == 1}
        assert all(preds[-1][f"again|{r[1]}", r[0]] == preds[-1][f"side|{r[1]}", r[0]] for r in rows if r[1] >= 0)
    assert preds[0].keys() == preds[1].keys() and all(abs(p - preds[1][k]) < 1e-12 for k, p in preds[0].items())


def test_tree_ablation_and_stress_share_their_passes(matrix):
    how = BO.Trees(rounds=3, rate=0.5, least_rows=5, bins=8)
    out = by_key(LN.tree_ablation(matrix.drop("fold"), {"x": ["f1"], "y": ["f2"]}, (0, 1), 2, how), "name")
    assert set(out) == {"without_x", "without_y"} and out["without_x"]["n_seeds"] == 2
    assert out["without_x"]["mean"] > out["without_y"]["mean"]
    oof, forest = LN.tree_out_of_fold(matrix, ["f1", "f2"], 3, how)
    assert oof.count() == matrix.count() == oof.select("response_id").distinct().count()
    assert {r.feature for r in LN.tree_gains(forest).collect()} == {"f1", "f2", "lo_prior_enc"}
    rows = matrix.drop("fold").selectExpr("*").withColumn("session_id", matrix.response_id)
    stress = by_key(LN.tree_stress_test(rows, ["f1", "f2"], draws=2, how=BO.Trees(rounds=3, patience=None, least_rows=5)), "name")
    assert set(stress) == {"model", "prior", "gain"} and stress["gain"]["n_seeds"] == 2


def test_objective_scores_count_responses_once_for_all_seeds(spark, tmp_path):
    from turnwise.operators import folds as FO
    from turnwise.operators.stats import auc, auc_of_counts

    path = str(tmp_path / "rows")
    spark.range(400).selectExpr("id AS response_id", "CASE WHEN id % 50 = 0 THEN NULL ELSE concat('o', id * id % 13) END AS objective_id",
                                "CAST(id * 7 % 3 = 0 AS DOUBLE) AS label", "CAST(id % 17 AS DOUBLE) AS a", "CAST(id * 31 % 23 AS DOUBLE) AS b"
                                ).write.parquet(path)
    rows = spark.read.parquet(path)
    keys = ["fold_seed", "fold", "arm"]
    counts = FO.objective_scores(rows, (0, 1, 2), {"x": "a", "y": "b"})
    got = {tuple(r)[:3]: tuple(r)[3:] for r in auc_of_counts(counts, keys).collect()}
    want = {}
    for seed in (0, 1, 2):
        arms = FO.objective_folds(rows, seed=seed).selectExpr(f"{seed} AS fold_seed", "fold", "label", "stack(2, 'x', a, 'y', b) AS (arm, pred)")
        want |= {tuple(r)[:3]: tuple(r)[3:] for r in auc(arms, keys, "label", "pred").collect()}
    assert got == want and len(got) >= 24
