"""Models trained on the given tables (checked by invariants, not by SQL)."""

from __future__ import annotations

from ..functions import text as X
from ..operators import folds as FO
from ..operators import vocabulary as VO
from ..operators.boosting import Run, Trees, root_gains
from ..operators.ledger import importance_summary
from ..operators.moments import fold_covariance
from ..plans import learning as LN
from ..plans.linguistic import utterance_text_counts
from ..operators.ordered import aggregate, spread
from .inputs import responses, short_utterances, table
from .registry import query, rounded
from .responses import SESSION_FOLDS, folds_sql

FEATURES = ("len", "n_words", "repeats", "selfcorr_rate", "filler_rate", "negate_rate", "excl_rate", "false_start_rate")
K = 5
#: Trees stop when the validation rows stop improving; depth as in the models they stand for.
TREES = LN.boosted_trees(depth=3)
#: Every feature is in one block.
BLOCKS = {
    "size": ("len", "n_words"),
    "fluency": ("repeats", "selfcorr_rate", "filler_rate", "false_start_rate"),
    "tone": ("negate_rate", "excl_rate"),
}
SEEDS = range(5)


def labelled_texts(spark, sf_dir):
    """Labelled documents as responses: source = session, language = objective."""
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id", "CAST(quality AS DOUBLE) AS label")
    return spread(table(spark, sf_dir, "documents")).join(labels, "doc_id").selectExpr(
        "doc_id AS response_id", "source AS session_id", "lang AS objective_id",
        "concat(lang, ' text from ', source) AS objective_text", "label", "text",
    )


def document_matrix(spark, sf_dir):
    texts = labelled_texts(spark, sf_dir)
    counts = utterance_text_counts(
        texts.selectExpr("session_id", "response_id AS pos", "'student' AS role", "text AS content")
    ).selectExpr("pos AS response_id", *FEATURES)
    return texts.drop("text", "objective_text").join(counts, "response_id")


@query("gbt_oof", "M3 F7 F8")
def _gbt(spark, sf_dir):
    folds = FO.session_folds(document_matrix(spark, sf_dir), K)
    return LN.out_of_fold(folds, FEATURES, TREES, range(K), k=K)[0]


@query("gbt_importance", "M3 A16")
def _gbt_importance(spark, sf_dir):
    folds = FO.session_folds(document_matrix(spark, sf_dir), K)
    gains = LN.out_of_fold(folds, FEATURES, TREES, range(K), importance=True, k=K)[1]
    return importance_summary(gains)


#: Shared-pass trees; the rate is that of few, larger steps, as every tree costs its depth in passes.
SHARED_TREES = Trees(rate=0.3, patience=3)


@query("histogram_gbt_oof", "M3 F7 F8")
def _histogram_gbt(spark, sf_dir):
    folds = LN.cut(FO.session_folds(document_matrix(spark, sf_dir), K))
    return LN.tree_out_of_fold(folds, FEATURES, K, SHARED_TREES)[0]


@query("histogram_gbt_gains", "M3 A16")
def _histogram_gains(spark, sf_dir):
    folds = LN.cut(FO.session_folds(document_matrix(spark, sf_dir), K))
    return importance_summary(LN.tree_gains(LN.tree_out_of_fold(folds, FEATURES, K, SHARED_TREES)[1]))


ROOT = Trees(bins=16, row_share=1.0)
#: A response's order of magnitude and remainders, missing where a remainder says so.
ROOT_FEATURES = {"f_pred": "pred", "f_gap": "CASE WHEN response_id % 7 <> 0 THEN response_id % 97 END",
                 "f_rare": "CASE WHEN response_id % 3 = 0 THEN pred * pred END"}


def root_sides() -> str:
    """Candidate splits of each model's first tree: borders at ranks of all rows, sums of its training rows."""
    values = " UNION ALL ".join(f"SELECT response_id, fold, label, '{n}' AS feature, CAST({e} AS DOUBLE) AS x FROM f" for n, e in ROOT_FEATURES.items())
    return f"""
    WITH {SESSION_FOLDS}, v AS MATERIALIZED ({values}),
    c AS (SELECT feature, x, sum(count(*)) OVER (PARTITION BY feature ORDER BY x) AS upto, sum(count(*)) OVER (PARTITION BY feature) AS n
          FROM v WHERE x IS NOT NULL GROUP BY feature, x),
    b AS (SELECT DISTINCT feature, border FROM (SELECT feature, i, min(x) AS border FROM c, range(1, {ROOT.bins}) AS t(i)
          WHERE upto >= ceil(i / {ROOT.bins}::DOUBLE * n) GROUP BY feature, i)),
    k AS (SELECT DISTINCT fold AS run FROM f),
    p AS (SELECT run, avg(label) AS p FROM f JOIN k ON fold <> run GROUP BY run),
    t AS MATERIALIZED (SELECT run, feature, x, count(*) AS n, sum(p - label) AS g, sum(p * (1 - p)) AS h
          FROM v JOIN k ON fold <> run JOIN p USING (run) GROUP BY ALL),
    w AS (SELECT run, feature, sum(n) AS n, sum(g) AS g, sum(h) AS h FROM t GROUP BY ALL),
    s AS (SELECT run, feature, border, missing_left, sum(n) AS nl, sum(g) AS gl, sum(h) AS hl
          FROM t JOIN b USING (feature), (SELECT unnest([true, false]) AS missing_left)
          WHERE x <= border OR (x IS NULL AND missing_left) GROUP BY ALL)
    SELECT CAST(run AS VARCHAR) AS run, feature, border, missing_left, CAST(nl AS BIGINT) AS n_left,
           (gl * gl / (hl + {ROOT.ridge}) + (g - gl) * (g - gl) / (h - hl + {ROOT.ridge}) - g * g / (h + {ROOT.ridge})) / 2 AS gain
    FROM s JOIN w USING (run, feature) WHERE nl >= {ROOT.least_rows} AND n - nl >= {ROOT.least_rows}"""


@query("root_split_gains", "M3", rounded(root_sides(), "border gain"))
def _root_gains(spark, sf_dir):
    folds = FO.session_folds(responses(spark, sf_dir), K).selectExpr(
        "response_id", "fold", "label", *[f"CAST({e} AS DOUBLE) AS {n}" for n, e in ROOT_FEATURES.items()])
    return root_gains(LN.cut(folds), "response_id", [Run(str(f), "fold", f, tuple(ROOT_FEATURES)) for f in range(K)], ROOT)


@query("text_model_oof", "M4 T17")
def _text(spark, sf_dir):
    folds = FO.session_folds(labelled_texts(spark, sf_dir), K)
    return LN.text_out_of_fold(folds, range(K), reg=1e-3, elastic=0.05, steps=60)


def labelled_moves(spark, sf_dir):
    rows = short_utterances(spark, sf_dir).where("role IN ('tutor', 'student')")
    return rows.selectExpr("session_id", "pos", "role", "content", f"{X.move_label('role', 'content')} AS move")


@query("move_classifier_report", "M5 F13")
def _move_report(spark, sf_dir):
    split = LN.cut(FO.group_shuffle_split(labelled_moves(spark, sf_dir)))
    model = LN.fit_move_classifier(split.where("side = 'train'").drop("side"))
    return LN.classification_report(LN.predict_moves(model, split.where("side = 'test'").drop("side")))


@query("predicted_moves", "M6")
def _predicted(spark, sf_dir):
    moves = LN.cut(labelled_moves(spark, sf_dir))
    model = LN.fit_move_classifier(moves)
    return LN.predict_moves(model, moves).select("session_id", "pos", "role", "predicted_move")


LOGIT = "ln({0} / (1 - {0}))"
CLIPPED = "greatest(least({}, 1 - 1e-6), 1e-6)"
#: Newton steps written out as a recursion, and the isotonic fit as the largest of the least means.
CALIBRATION = f"""
    WITH RECURSIVE {SESSION_FOLDS},
    cells AS MATERIALIZED (SELECT fold, pred, {LOGIT.format(CLIPPED.format('pred'))} AS z, count(*)::DOUBLE AS n, sum(label) AS s FROM f GROUP BY fold, pred),
    steps AS (
        SELECT DISTINCT fold AS k, 0 AS step, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM cells
        UNION ALL
        SELECT k, step + 1, a - (hbb * (ga + 1e-6 * a) - hab * gb) / ((haa + 1e-6) * hbb - hab * hab),
               b - ((haa + 1e-6) * gb - hab * (ga + 1e-6 * a)) / ((haa + 1e-6) * hbb - hab * hab)
        FROM (SELECT k, step, a, b, sum((n * q - s) * z) AS ga, sum(n * q - s) AS gb, sum(n * q * (1 - q) * z * z) AS haa,
                     sum(n * q * (1 - q) * z) AS hab, sum(n * q * (1 - q)) AS hbb
              FROM (SELECT k, step, a, b, z, n, s, 1 / (1 + exp(-(a * z + b))) AS q FROM steps JOIN cells ON cells.fold <> k WHERE step < 15) GROUP BY ALL)),
    points AS (SELECT k.fold AS k, c.pred AS x, sum(c.s) AS s, sum(c.n) AS n FROM cells AS c JOIN (SELECT DISTINCT fold FROM cells) AS k ON c.fold <> k.fold GROUP BY ALL),
    sums AS (SELECT *, row_number() OVER o AS i, sum(s) OVER o AS ss, sum(n) OVER o AS nn FROM points WINDOW o AS (PARTITION BY k ORDER BY x)),
    least AS (SELECT a.k, a.i AS a, b.i AS i, min((b.ss - a.ss + a.s) / (b.nn - a.nn + a.n)) OVER (PARTITION BY a.k, a.i ORDER BY b.i DESC) AS v
              FROM sums AS a JOIN sums AS b ON a.k = b.k AND b.i >= a.i),
    knots AS (SELECT k, x, v FROM (SELECT k, i, max(v) AS v FROM least GROUP BY k, i) JOIN sums USING (k, i)),
    around AS (SELECT c.fold, c.pred, c.n, c.s, max(x) FILTER (x <= pred) AS x0, arg_max(v, x) FILTER (x <= pred) AS v0,
                      min(x) FILTER (x > pred) AS x1, arg_min(v, x) FILTER (x > pred) AS v1
               FROM cells AS c JOIN knots ON knots.k = c.fold GROUP BY ALL),
    scored AS (
        SELECT 'none' AS method, n, s, pred AS p FROM cells
        UNION ALL SELECT 'platt', n, s, 1 / (1 + exp(-(a * z + b))) FROM cells JOIN steps ON k = fold AND step = 15
        UNION ALL SELECT 'isotonic', n, s, CASE WHEN x0 IS NULL THEN v1 WHEN x1 IS NULL THEN v0 ELSE v0 + (pred - x0) * (v1 - v0) / (x1 - x0) END FROM around),
    clipped AS (SELECT method, n, s, {CLIPPED.format('p')} AS p FROM scored),
    bins AS (SELECT method, {' + '.join(f'(p >= {i / 10!r}::DOUBLE)::INT' for i in range(1, 10))} AS bin,
                    sum(-(s * ln(p) + (n - s) * ln(1 - p))) AS loss, abs(sum(n * p) - sum(s)) AS gap, sum(n) AS n FROM clipped GROUP BY ALL)
    SELECT method, sum(loss) / sum(n) AS logloss, sum(gap) / sum(n) AS ece, CAST(sum(n) AS BIGINT) AS n FROM bins GROUP BY method"""


@query("calibration_choice", "M7 M8 M10 E5", rounded(CALIBRATION, "logloss ece"))
def _calibration(spark, sf_dir):
    folds = FO.session_folds(responses(spark, sf_dir), K)
    return LN.calibration_losses(folds, range(K))


@query("domain_folds", "F5")
def _domains(spark, sf_dir):
    sizes = aggregate(
        utterance_text_counts(short_utterances(spark, sf_dir)), ["session_id"],
        "avg(len) AS mean_len", "sum(n_words) AS n_words", "count(1) AS n", "sum(repeats) AS repeats",
    )
    domains = LN.session_domains(sizes, ["mean_len", "n_words", "n", "repeats"], 20)
    rows = short_utterances(spark, sf_dir).selectExpr(
        "concat_ws('-', session_id, pos) AS response_id", "session_id",
        "CASE WHEN role = 'student' THEN 1D ELSE 0D END AS label")
    return LN.domain_folds(rows, domains, K).select("response_id", "session_id", "domain_id", "fold")


def assessed_texts(spark, sf_dir):
    """Labelled documents as responses to the benchmark's items, whose texts are the objectives."""
    items = table(spark, sf_dir, "benchmark").selectExpr(
        "item_id AS objective_id", "text AS objective_text", "row_number() OVER (ORDER BY item_id) - 1 AS _place", "count(1) OVER () AS _items")
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id AS response_id", "CAST(quality AS DOUBLE) AS label")
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id AS response_id", "source AS session_id").join(labels, "response_id")
    counted = rows.withColumn("_items", items.select("_items").limit(1).scalar())
    return counted.selectExpr("response_id", "session_id", "label", "response_id % _items AS _place").join(
        items.drop("_items"), "_place").drop("_place")


@query("text_difficulty_encoding", "F9 F10 U4")
def _difficulty(spark, sf_dir):
    rows = LN.cut(FO.session_folds(assessed_texts(spark, sf_dir), K))
    scored = LN.text_difficulty(rows.where("fold <> 0"), rows.where("fold = 0"), inner=K)
    return scored.select("response_id", "fold", "lo_text_difficulty")


def gram_sql(text: str) -> str:
    """Words of two characters and more, plain letters, and their pairs, as a list."""
    words = f"regexp_extract_all(translate(lower(coalesce({text}, '')), '{LN.ACCENTED}', '{LN.PLAIN}'), '{LN.TOKEN}')"
    return f"list_concat({words}, list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1]))"


@query("term_weights", "F9 M5 B5", rounded(f"""
    WITH t AS (SELECT item_id, unnest({gram_sql('text')}) AS term FROM benchmark),
    c AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY ALL),
    d AS (SELECT term, count(*) AS df, sum(tf) AS n FROM c GROUP BY term HAVING count(*) >= 2 ORDER BY n DESC, encode(term) LIMIT 2000),
    w AS (SELECT item_id, c.term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS w FROM c JOIN d USING (term))
    SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM w""", "weight"))
def _term_weights(spark, sf_dir):
    texts = LN.word_grams(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text")
    counts = LN.cut(VO.term_counts(texts, ["item_id"]))
    return VO.term_weights(counts, VO.dictionary(counts, 2, 2000), texts.count(), ["item_id"])


DIMS = 64


def vector_folds(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS response_id", "vec_id div 4 AS session_id", "CAST(label % 2 AS DOUBLE) AS label",
        *[f"CAST(embedding[{i}] AS DOUBLE) AS raw_{i:02d}" for i in range(DIMS)])
    return LN.cut(FO.session_folds(vectors, K)), [f"raw_{i:02d}" for i in range(DIMS)]


@query("fold_safe_pca", "F11")
def _pca(spark, sf_dir):
    rows, columns = vector_folds(spark, sf_dir)
    return LN.pca_by_fold(rows, columns, range(K), 8)


@query("fold_covariance", "F11", rounded(f"""
    WITH r AS MATERIALIZED (SELECT vec_id AS response_id, vec_id // 4 AS session_id, CAST(label % 2 AS DOUBLE) AS label, embedding FROM embeddings),
    {folds_sql('session_id', 'np DESC, n DESC')},
    v AS MATERIALIZED (SELECT response_id, fold, unnest(range({DIMS})) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM f),
    m AS (SELECT a.fold, a.i, b.i AS j, count(*) AS n, sum(a.x) AS si, sum(b.x) AS sj, sum(a.x * b.x) AS p FROM v AS a JOIN v AS b USING (response_id)
          WHERE a.i <= b.i GROUP BY ALL),
    t AS (SELECT i, j, sum(n) AS n, sum(si) AS si, sum(sj) AS sj, sum(p) AS p FROM m GROUP BY ALL)
    SELECT fold AS model_fold, CAST(t.n - m.n AS BIGINT) AS n, i, j, (t.si - m.si) / (t.n - m.n) AS mean_i, (t.sj - m.sj) / (t.n - m.n) AS mean_j,
           (t.p - m.p - (t.si - m.si) * (t.sj - m.sj) / (t.n - m.n)) / (t.n - m.n - 1) AS covariance FROM m JOIN t USING (i, j)""",
    "mean_i mean_j covariance"))
def _covariance(spark, sf_dir):
    rows, columns = vector_folds(spark, sf_dir)
    return fold_covariance(rows, columns)


@query("block_ablation", "E14 E13 E15")
def _ablation(spark, sf_dir):
    return LN.tree_ablation(document_matrix(spark, sf_dir), BLOCKS, SEEDS, K, SHARED_TREES)


@query("unseen_stress_test", "E20 F12 E12")
def _stress(spark, sf_dir):
    # the objective is the last digit of the document id, so a draw leaves other sessions to train on
    rows = document_matrix(spark, sf_dir).selectExpr(
        "response_id", "concat_ws('-', session_id, response_id div 40) AS session_id",
        "response_id div 40 % 10 AS objective_id", "label", *FEATURES)
    return LN.tree_stress_test(rows, FEATURES, draws=5)
