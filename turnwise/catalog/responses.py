"""Joins, set operations, folds, encodings and baselines over responses."""

from __future__ import annotations

from ..functions import scalars as S
from ..functions import text as X
from ..operators import encoding as EN
from ..operators import folds as FO
from ..operators import joins as JN
from ..operators import sampling as SA
from ..operators.ordered import aggregate
from ..plans import overview as OV
from ..session import cut
from .inputs import LONG, RESPONSES, SHORT, long_rows, responses, short_utterances, table
from .registry import query, rounded

R = f"r AS MATERIALIZED ({RESPONSES})"
LL = ("(-(label * ln(greatest(least({p}, 0.999999::DOUBLE), 0.000001::DOUBLE)) + (1 - label) * "
      "ln(1 - greatest(least({p}, 0.999999::DOUBLE), 0.000001::DOUBLE))))")


def folds_sql(key: str, order: str, seed: int = 0, k: int = 5, name: str = "f") -> str:
    return f"""
    {name}s AS (SELECT {key}, count(*) AS n, sum(label) AS np FROM r GROUP BY {key}),
    {name}r AS (SELECT {key}, row_number() OVER (ORDER BY {order}, md5(CAST({key} AS VARCHAR) || '|{seed}')) - 1 AS rk FROM {name}s),
    {name}k AS (SELECT {key}, CASE WHEN (rk // {k}) % 2 = 0 THEN rk % {k} ELSE {k - 1} - rk % {k} END AS fold FROM {name}r),
    {name} AS MATERIALIZED (SELECT r.*, fold FROM r JOIN {name}k USING ({key}))"""


def greedy_sql(key: str, stratified: bool, seed: int = 0, k: int = 5) -> str:
    """The walk of one group after another; needs WITH RECURSIVE before it."""
    first, lead = ("n - np", "abs(n - 2 * np) DESC, ") if stratified else ("n", "")
    tie = "rs[j]" if stratified else "0"
    chosen = f"list_sort(list_transform(range(1, {k + 1}), lambda j: {{'c': ta[j] * a * sb + tb[j] * b * sa, 'r': {tie}, 'j': j}}))[1].j"
    chosen = chosen if stratified else f"CASE WHEN i.i <= {k} THEN i.i ELSE {chosen} END"
    grow = lambda t, x: f"list_transform(range(1, {k + 1}), lambda j: {t}[j] + CASE WHEN j = f THEN {x} ELSE 0 END)"
    zeros = f"{[0] * k}::HUGEINT[]"
    return f"""
    gs AS (SELECT {key}, CAST(count(*) AS HUGEINT) AS n, CAST(sum(label) AS HUGEINT) AS np FROM r GROUP BY {key}),
    gi AS MATERIALIZED (SELECT {key}, n, {first} AS a, np AS b, greatest(sum({first}) OVER (), {k}) * greatest(sum({first}) OVER (), {k}) AS sa,
                  greatest(sum(np) OVER (), {k}) * greatest(sum(np) OVER (), {k}) AS sb,
                  row_number() OVER (ORDER BY {lead}n DESC, np DESC, md5(CAST({key} AS VARCHAR) || '|{seed}')) AS i FROM gs),
    walk AS (
        SELECT CAST(0 AS BIGINT) AS i, {zeros} AS ta, {zeros} AS tb, {zeros} AS rs, CAST(0 AS BIGINT) AS f
        UNION ALL
        SELECT i, {grow('ta', 'a')}, {grow('tb', 'b')}, {grow('rs', 'n')}, f
        FROM (SELECT i.i, ta, tb, rs, a, b, n, CAST({chosen} AS BIGINT) AS f FROM walk JOIN gi AS i ON i.i = walk.i + 1)),
    f AS MATERIALIZED (SELECT r.*, walk.f - 1 AS fold FROM r JOIN gi USING ({key}) JOIN walk USING (i))"""


SESSION_FOLDS = f"{R}, {folds_sql('session_id', 'np DESC, n DESC')}"
OBJECTIVE_FOLDS = f"{R}, {folds_sql('objective_id', 'n DESC, np DESC')}"


def session_folds(spark, sf_dir):
    """The fold table, written once: encodings and metrics read it several times."""
    return cut(FO.session_folds(responses(spark, sf_dir)))


def objective_folds(spark, sf_dir):
    return cut(FO.objective_folds(responses(spark, sf_dir)))


# --- joins -----------------------------------------------------------------------------
@query("labelled_documents", "J1 S7", """
    SELECT d.doc_id, source, lang, n_chars, CAST(quality AS DOUBLE) AS correct
    FROM documents AS d JOIN labels AS l ON d.doc_id = l.doc_id""")
def _labelled(spark, sf_dir):
    from ..sources.files import canonical_label

    labels = canonical_label(table(spark, sf_dir, "labels"), ("is_correct", "correct", "label", "quality"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(
        labels.select("doc_id", "correct"), "doc_id"
    )


@query("missing_labels", "J2 A5", """
    SELECT count(*) AS n_rows, count(*) FILTER (quality IS NULL) AS n_missing
    FROM documents LEFT JOIN labels USING (doc_id)""")
def _missing_labels(spark, sf_dir):
    return JN.unmatched(
        table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", "quality"
    )


@query("composite_key_join", "J3", """
    SELECT o.o_orderkey AS response_id, o.o_custkey AS session_id, o.o_totalprice AS price, m.n_items, m.quantity
    FROM orders AS o LEFT JOIN (
        SELECT o_orderkey, o_custkey, count(*) AS n_items, sum(l_quantity) AS quantity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY ALL) AS m
    ON o.o_orderkey = m.o_orderkey AND o.o_custkey = m.o_custkey""")
def _composite(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS response_id", "o_custkey AS session_id", "o_totalprice AS price"
    )
    returned = aggregate(
        table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), ["l_orderkey"],
        "count(1) AS n_items", "sum(l_quantity) AS quantity",
    ).withColumnRenamed("l_orderkey", "response_id")
    meta = returned.join(orders.select("response_id", "session_id"), "response_id")
    return orders.join(meta, ["response_id", "session_id"], "left")


BLOCK = ("SELECT c_custkey AS session_id, CASE WHEN c_custkey % 100 = 7 THEN NULL ELSE c_acctbal END AS balance "
         "FROM customer WHERE c_custkey % 50 <> 3")


@query("block_join_audit", "J4 B16", f"""
    WITH {R}, b AS ({BLOCK}), j AS (SELECT r.*, balance FROM r LEFT JOIN b USING (session_id))
    SELECT 0::BIGINT AS null_keys, (SELECT count(*) FROM (SELECT session_id FROM b GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys,
           (SELECT count(*) FROM r) AS base_rows, count(*) AS joined_rows,
           count(*) FILTER (balance IS NULL) AS absent_rows, count(*) FILTER (balance IS NULL) = 0 AS safe FROM j""")
def _block_audit(spark, sf_dir):
    block = table(spark, sf_dir, "customer").where("c_custkey % 50 <> 3").selectExpr(
        "c_custkey AS session_id", "CASE WHEN c_custkey % 100 = 7 THEN NULL ELSE c_acctbal END AS balance"
    )
    return JN.block_audit(responses(spark, sf_dir), block, "session_id")


@query("join_coverage", "J5", rounded(f"""
    WITH {R}, l AS (SELECT DISTINCT l_orderkey AS response_id FROM lineitem)
    SELECT (SELECT count(*) FROM r) AS n_left, count(*) AS n_joined,
           count(*) / (SELECT count(*) FROM r) AS coverage, count(*) / (SELECT count(*) FROM r) >= 0.99 AS sufficient
    FROM r JOIN l USING (response_id)""", "coverage"))
def _coverage(spark, sf_dir):
    shipped = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS response_id").distinct()
    return JN.coverage(responses(spark, sf_dir), shipped, "response_id")


@query("cohort_members", "J6", """
    SELECT o_orderkey AS response_id, o_custkey AS session_id FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def _members(spark, sf_dir):
    chosen = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").selectExpr("c_custkey AS session_id")
    return responses(spark, sf_dir).select("response_id", "session_id").join(chosen, "session_id", "left_semi")


@query("unseen_objectives", "J7", """
    SELECT o_orderkey AS response_id, strftime(o_orderdate, '%Y-%m') AS objective_id FROM orders
    WHERE o_orderpriority = '1-URGENT' AND strftime(o_orderdate, '%Y-%m-%d') NOT IN
          (SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus = 'F')""")
def _unseen(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "response_id")
    train = rows.where("o_orderpriority <> '1-URGENT' AND o_orderstatus = 'F'").selectExpr("date(o_orderdate) AS day")
    valid = rows.where("o_orderpriority = '1-URGENT'").selectExpr(
        "response_id", "date_format(o_orderdate, 'yyyy-MM') AS objective_id", "date(o_orderdate) AS day"
    )
    return valid.join(train.distinct(), "day", "left_anti").drop("day")


@query("cohort_audit", "J10", f"""
    WITH {R}, a AS (SELECT * FROM r WHERE response_id % 101 <> 5),
    b AS (SELECT response_id, CASE WHEN response_id % 103 = 1 THEN session_id + 1 ELSE session_id END AS session_id,
                 CASE WHEN response_id % 107 = 2 THEN 1 - label ELSE label END AS label FROM r WHERE response_id % 109 <> 4),
    j AS (SELECT a.response_id AS ai, b.response_id AS bi, a.label AS al, b.label AS bl, a.session_id AS asess, b.session_id AS bsess
          FROM a FULL JOIN b ON a.response_id = b.response_id)
    SELECT count(*) FILTER (bi IS NULL) AS only_reference, count(*) FILTER (ai IS NULL) AS only_candidate,
           0::BIGINT AS duplicated, 0::BIGINT AS null_ids, count(*) FILTER (al <> bl) AS label_differs,
           count(*) FILTER (asess <> bsess) AS session_differs, false AS comparable FROM j""")
def _cohort_audit(spark, sf_dir):
    rows = responses(spark, sf_dir)
    other = rows.where("response_id % 109 <> 4").selectExpr(
        "response_id", "CASE WHEN response_id % 103 = 1 THEN session_id + 1 ELSE session_id END AS session_id",
        "CASE WHEN response_id % 107 = 2 THEN 1 - label ELSE label END AS label",
    )
    return JN.cohort_audit(rows.where("response_id % 101 <> 5"), other)


@query("feature_value_parity", "J14", rounded("""
    WITH a AS (SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_partkey % 500 <> 9),
    b AS (SELECT p_partkey, CASE WHEN p_partkey % 400 = 3 THEN NULL ELSE p_size END AS p_size,
                 CASE WHEN p_partkey % 300 = 1 THEN p_retailprice + 0.25 ELSE p_retailprice * (1 + 1e-12) END AS p_retailprice FROM part),
    c AS (SELECT 'size' AS feature, CAST(a.p_size AS DOUBLE) AS x, CAST(b.p_size AS DOUBLE) AS y
          FROM a FULL JOIN b ON a.p_partkey = b.p_partkey
          UNION ALL SELECT 'price', a.p_retailprice, b.p_retailprice FROM a FULL JOIN b ON a.p_partkey = b.p_partkey),
    d AS (SELECT *, NOT (x IS NOT DISTINCT FROM y OR coalesce(abs(x - y) <= 1e-9 + 1e-9 * abs(y), false)) AS bad FROM c)
    SELECT count(*) AS n_cells, count(*) FILTER (bad) AS n_bad_cells,
           count(DISTINCT feature) FILTER (bad) AS n_bad_columns, coalesce(max(abs(x - y)), 0.0) AS max_abs_delta FROM d""",
    "max_abs_delta"))
def _parity(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    changed = part.selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 400 = 3 THEN NULL ELSE p_size END AS p_size",
        "CASE WHEN p_partkey % 300 = 1 THEN p_retailprice + 0.25D ELSE p_retailprice * (1 + 1e-12D) END AS p_retailprice",
    )
    return JN.value_parity(part.where("p_partkey % 500 <> 9"), changed, "p_partkey")


# --- set operations --------------------------------------------------------------------
@query("union_by_name", "U1", """
    SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT CAST(s_suppkey AS BIGINT), s_name, s_acctbal, NULL FROM supplier""")
def _union(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").selectExpr(
        "c_mktsegment AS segment", "c_custkey AS id", "c_name AS name", "c_acctbal AS balance"
    )
    suppliers = table(spark, sf_dir, "supplier").selectExpr("s_name AS name", "s_suppkey AS id", "s_acctbal AS balance")
    return customers.unionByName(suppliers, allowMissingColumns=True).select("id", "name", "balance", "segment")


@query("missing_and_unexpected_ids", "U2", """
    SELECT o_custkey AS session_id, 'unexpected' AS kind FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O'
        EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
    UNION ALL
    SELECT o_custkey, 'missing' FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'
        EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def _id_difference(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey AS session_id", "o_orderstatus")
    return JN.set_difference(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'O'"), "session_id")


@query("shared_keys", "U3", """
    SELECT o_custkey AS session_id, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o
    FROM orders GROUP BY 1 HAVING n_f > 0 AND n_o > 0""")
def _shared(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey AS session_id", "o_orderstatus")
    f = aggregate(rows.where("o_orderstatus = 'F'"), ["session_id"], "count(1) AS n_f")
    return f.join(aggregate(rows.where("o_orderstatus = 'O'"), ["session_id"], "count(1) AS n_o"), "session_id")


@query("weighted_two_class_set", "U4 A12", rounded(f"""
    WITH {R}, g AS (SELECT objective_id, arg_min(slice_value, response_id) AS text, avg(label) AS rate, count(*) AS n FROM r GROUP BY 1)
    SELECT objective_id, text, 1 AS y, n * rate AS weight FROM g WHERE n * rate > 0
    UNION ALL SELECT objective_id, text, 0, n * (1 - rate) FROM g WHERE n * (1 - rate) > 0""", "weight").replace("1 AS y", "1::BIGINT AS y"))
def _two_class(spark, sf_dir):
    from ..plans.learning import two_class_rows

    return two_class_rows(responses(spark, sf_dir).withColumnRenamed("slice_value", "objective_text"), "response_id") \
        .withColumnRenamed("objective_text", "text")


@query("first_row_per_key", "U5 A12", """
    SELECT o_custkey AS session_id, o_orderkey AS response_id, o_totalprice AS price
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def _first(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS session_id", "o_orderkey AS response_id", "o_totalprice AS price", "o_orderdate AS at"
    )
    return JN.first_per_key(rows, "session_id", "at, response_id").select("session_id", "response_id", "price")


# --- sampling --------------------------------------------------------------------------
@query("first_sessions_cohort", "K3", """
    SELECT o_custkey AS session_id, min(o_orderkey) AS first_at FROM orders GROUP BY 1 ORDER BY 2, 1 LIMIT 100""")
def _cohort(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey AS session_id", "o_orderkey")
    return SA.first_cohort(rows, "session_id", "o_orderkey", 100)


@query("sampled_utterances", "K4 P4", f"""
    WITH u AS (SELECT * FROM ({SHORT}) WHERE role IN ('tutor', 'student')),
    q AS (SELECT session_id, pos, role, row_number() OVER (PARTITION BY session_id ORDER BY md5(session_id || '|' || pos || '|7')) AS rn FROM u)
    SELECT session_id, pos, role FROM q WHERE rn <= greatest(1, 250 // (SELECT count(DISTINCT session_id) FROM u))""")
def _sampled(spark, sf_dir):
    rows = short_utterances(spark, sf_dir).where("role IN ('tutor', 'student')").select("session_id", "pos", "role")
    return SA.per_group_sample(rows, "session_id", "pos", 250, seed=7)


@query("sampled_objectives", "K5", f"""
    WITH {R}, d AS (SELECT DISTINCT objective_id FROM r),
    q AS (SELECT objective_id, row_number() OVER (ORDER BY md5(objective_id || '|3')) - 1 AS rk, count(*) OVER () AS n FROM d)
    SELECT objective_id FROM q WHERE rk < greatest(1, round_even(n * 0.25::DOUBLE, 0))""")
def _sampled_objectives(spark, sf_dir):
    return FO.sampled_keys(responses(spark, sf_dir), "objective_id", 0.25, 3)


@query("rare_categories", "P8", """
    WITH t AS (SELECT p_type || ' ' || p_brand AS kind FROM part),
    k AS (SELECT kind FROM t GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 10)
    SELECT CASE WHEN t.kind IN (SELECT kind FROM k) THEN t.kind ELSE '(other)' END AS kind, count(*) AS n FROM t GROUP BY 1""")
def _rare(spark, sf_dir):
    kinds = table(spark, sf_dir, "part").selectExpr("concat_ws(' ', p_type, p_brand) AS kind")
    return aggregate(SA.collapse_rare(kinds, "kind"), ["kind"], "count(1) AS n")


# --- folds -----------------------------------------------------------------------------
GREEDY_SESSIONS = f"WITH RECURSIVE {R}, {greedy_sql('session_id', True)}"
GREEDY_OBJECTIVES = f"WITH RECURSIVE {R}, {greedy_sql('objective_id', False)}"


@query("session_fold_assignment", "F1 K1", f"{GREEDY_SESSIONS} SELECT response_id, session_id, label, fold FROM f")
def _session_folds(spark, sf_dir):
    return FO.greedy_session_folds(responses(spark, sf_dir)).select("response_id", "session_id", "label", "fold")


@query("objective_fold_assignment", "F3", f"{GREEDY_OBJECTIVES} SELECT response_id, objective_id, label, fold FROM f")
def _objective_folds(spark, sf_dir):
    return FO.greedy_objective_folds(responses(spark, sf_dir)).select("response_id", "objective_id", "label", "fold")


@query("session_fold_snake", "F1", f"WITH {SESSION_FOLDS} SELECT response_id, session_id, label, fold FROM f")
def _session_snake(spark, sf_dir):
    return FO.session_folds(responses(spark, sf_dir)).select("response_id", "session_id", "label", "fold")


@query("objective_fold_snake", "F3", f"WITH {OBJECTIVE_FOLDS} SELECT response_id, objective_id, label, fold FROM f")
def _objective_snake(spark, sf_dir):
    return FO.objective_folds(responses(spark, sf_dir)).select("response_id", "objective_id", "label", "fold")


@query("split_groups", "F2", f"""
    WITH {SESSION_FOLDS} SELECT objective_id FROM f GROUP BY 1 HAVING min(fold) <> max(fold)""")
def _split_groups(spark, sf_dir):
    return FO.split_groups(session_folds(spark, sf_dir), "objective_id")


# purging by customer leaves almost nothing here, so a session is four neighbouring orders
PURGED = f"""{OBJECTIVE_FOLDS},
    vs AS (SELECT DISTINCT fold AS vf, response_id // 4 AS g FROM f),
    vo AS (SELECT DISTINCT fold AS vf, objective_id FROM f),
    p AS (SELECT f.*, t AS train_fold FROM f, (SELECT unnest(range(0, 5)) AS t) WHERE fold <> t
          AND NOT EXISTS (SELECT 1 FROM vs WHERE vs.vf = t AND vs.g = f.response_id // 4)
          AND NOT EXISTS (SELECT 1 FROM vo WHERE vo.vf = t AND vo.objective_id = f.objective_id))"""


def order_folds(spark, sf_dir):
    """Objective folds with a session of four neighbouring orders, so a purge leaves rows."""
    return objective_folds(spark, sf_dir).selectExpr("*", "response_id div 4 AS sess4")


def purged(spark, sf_dir, folds=None):
    return FO.purged_training(order_folds(spark, sf_dir) if folds is None else folds, 5, "sess4")


@query("purged_training_rows", "J8 F4", f"WITH {PURGED} SELECT response_id, fold, train_fold FROM p")
def _purged(spark, sf_dir):
    return purged(spark, sf_dir).select("response_id", "fold", "train_fold")


SUMMARY = """
    SELECT fold, count(*) AS n_rows, avg(label) AS pos_rate, count(DISTINCT response_id // 4) AS n_sessions,
           count(DISTINCT objective_id) AS n_objectives,
           (SELECT count(*) FROM p WHERE p.train_fold = f.fold) AS n_train_after_purge FROM f GROUP BY fold"""


@query("fold_summary", "A17", rounded(f"WITH {PURGED} {SUMMARY}", "pos_rate"))
def _fold_summary(spark, sf_dir):
    folds = order_folds(spark, sf_dir)
    return FO.fold_summary(folds, group="sess4", purged=purged(spark, sf_dir, folds))


@query("fold_health", "F6", f"""
    WITH {PURGED}, s AS ({SUMMARY})
    SELECT unnest(['fold_count', 'all_assigned', 'groups_whole', 'objectives_per_fold', 'non_empty_after_purge']) AS rule,
           unnest([count(*) = 5, true, true, sum(n_objectives) < 100 OR min(n_objectives) >= 20,
                   min(n_train_after_purge) > 0]) AS passed FROM s""")
def _fold_health(spark, sf_dir):
    folds = order_folds(spark, sf_dir)
    summary = FO.fold_summary(folds, group="sess4", purged=purged(spark, sf_dir, folds))
    return FO.fold_health(summary, FO.split_groups(folds, "objective_id"), folds.where("fold IS NULL"))


@query("unseen_split", "F12 K5 J6 J7", f"""
    WITH {R}, d AS (SELECT DISTINCT objective_id FROM r),
    q AS (SELECT objective_id, row_number() OVER (ORDER BY md5(objective_id || '|0')) - 1 AS rk, count(*) OVER () AS n FROM d),
    h AS (SELECT objective_id FROM q WHERE rk < greatest(1, round_even(n * 0.02::DOUBLE, 0))),
    t AS (SELECT DISTINCT session_id FROM r WHERE objective_id IN (SELECT objective_id FROM h)),
    s AS (SELECT *, session_id IN (SELECT session_id FROM t) AS v FROM r),
    seen AS (SELECT DISTINCT objective_id FROM s WHERE NOT v)
    SELECT response_id, CASE WHEN v THEN 'validation' ELSE 'train' END AS side,
           v AND objective_id NOT IN (SELECT objective_id FROM seen) AS scored FROM s""")
def _unseen_split(spark, sf_dir):
    return FO.unseen_split(responses(spark, sf_dir), 0.02).select("response_id", "side", "scored")


@query("group_shuffle_split", "F13", f"""
    WITH {R}, d AS (SELECT DISTINCT session_id FROM r),
    q AS (SELECT session_id, row_number() OVER (ORDER BY md5(session_id || '|11')) - 1 AS rk, count(*) OVER () AS n FROM d)
    SELECT response_id, session_id, CASE WHEN rk < ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS side
    FROM r JOIN q USING (session_id)""")
def _group_shuffle(spark, sf_dir):
    return FO.group_shuffle_split(responses(spark, sf_dir), seed=11).select("response_id", "session_id", "side")


# --- encodings and baselines -----------------------------------------------------------
@query("smoothed_objective_means", "A9", rounded(f"""
    WITH {R} SELECT objective_id, count(*) AS n, (sum(label) + 20 * (SELECT avg(label) FROM r)) / (count(*) + 20) AS encoding,
           (SELECT avg(label) FROM r) AS global_rate FROM r GROUP BY 1""", "encoding global_rate"))
def _means(spark, sf_dir):
    return EN.smoothed_means(responses(spark, sf_dir))


@query("encoding_lookup", "J9", rounded(f"""
    WITH {R}, tr AS (SELECT * FROM r WHERE objective_id < '1996'),
    m AS (SELECT objective_id, (sum(label) + 20 * (SELECT avg(label) FROM tr)) / (count(*) + 20) AS e FROM tr GROUP BY 1)
    SELECT response_id, coalesce(e, 0.3) AS encoding FROM r LEFT JOIN m USING (objective_id)""", "encoding"))
def _lookup(spark, sf_dir):
    rows = responses(spark, sf_dir)
    means = EN.smoothed_means(rows.where("objective_id < '1996'"))
    return EN.apply_encoding(rows.select("response_id", "objective_id"), means, 0.3).drop("objective_id")


OUTER = f"""{SESSION_FOLDS},
    e AS (SELECT f.response_id, f.fold, f.label, f.objective_id,
                 (SELECT avg(label) FROM f AS t WHERE t.fold <> f.fold) AS fold_rate FROM f),
    c AS (SELECT objective_id, fold, sum(label) AS s, count(*) AS n FROM f GROUP BY ALL),
    a AS (SELECT objective_id, sum(s) AS s, sum(n) AS n FROM c GROUP BY ALL),
    m2 AS (SELECT e.*, (a.s - c.s + 20 * fold_rate) / (a.n - c.n + 20) AS encoding
           FROM e JOIN c USING (objective_id, fold) JOIN a USING (objective_id))"""


@query("outer_fold_encoding", "F7 M1 M2", rounded(
    f"WITH {OUTER} SELECT response_id, fold, fold_rate, encoding FROM m2", "fold_rate encoding"))
def _outer(spark, sf_dir):
    return EN.outer_encoding(session_folds(spark, sf_dir)).select("response_id", "fold", "fold_rate", "encoding")


@query("model_fold_encodings", "F8 F7", rounded(f"""
    WITH {SESSION_FOLDS}, o AS (SELECT unnest(range(0, 5)) AS outer_fold),
    fsum AS (SELECT fold, sum(label) AS s, count(*) AS n FROM f GROUP BY fold),
    c AS (SELECT objective_id, fold, sum(label) AS s, count(*) AS n FROM f GROUP BY ALL),
    combos AS (SELECT a.fold, outer_fold FROM fsum AS a, o),
    rate AS (SELECT combos.fold, outer_fold, sum(s) / sum(n) AS g FROM combos JOIN fsum ON fsum.fold <> combos.fold AND fsum.fold <> outer_fold GROUP BY ALL),
    cell AS (SELECT x.objective_id, combos.fold, outer_fold, coalesce(sum(c.s), 0) AS s, coalesce(sum(c.n), 0) AS n
             FROM (SELECT DISTINCT objective_id FROM f) AS x CROSS JOIN combos
             LEFT JOIN c ON c.objective_id = x.objective_id AND c.fold <> combos.fold AND c.fold <> outer_fold GROUP BY ALL)
    SELECT response_id, cell.outer_fold, CASE WHEN f.fold = cell.outer_fold THEN 'validation' ELSE 'train' END AS side,
           (s + 20 * g) / (n + 20) AS encoding
    FROM f JOIN cell ON cell.objective_id = f.objective_id AND cell.fold = f.fold
    JOIN rate ON rate.fold = f.fold AND rate.outer_fold = cell.outer_fold""", "encoding"))
def _model_encodings(spark, sf_dir):
    return EN.model_encodings(session_folds(spark, sf_dir)).select("response_id", "outer_fold", "side", "encoding")


@query("purged_training_rates", "F7 F4 M1", rounded(
    f"WITH {PURGED} SELECT train_fold, avg(label) AS rate, count(*) AS n_train FROM p GROUP BY train_fold", "rate"))
def _purged_rates(spark, sf_dir):
    return EN.purged_rates(purged(spark, sf_dir))


# --- label structure -------------------------------------------------------------------
@query("variance_decomposition", "A10 A11 E23 W19", rounded(f"""
    WITH {R}, s AS (SELECT session_id, count(*) AS n, avg(label) AS m, var_pop(label) AS v FROM r GROUP BY 1),
    t AS (SELECT var_pop(label) AS tv, avg(label) AS p, count(*) AS n FROM r),
    o AS (SELECT avg(-(label * ln(greatest(least(m, 1 - 1e-15), 1e-15)) + (1 - label) * ln(1 - greatest(least(m, 1 - 1e-15), 1e-15)))) AS l
          FROM r JOIN s USING (session_id))
    SELECT any_value(t.n) AS n_responses, count(*) AS n_sessions, count(*) FILTER (s.n > 1) AS n_multi_sessions,
           count(*) FILTER (s.n > 1) / count(*) AS frac_multi_sessions,
           sum(s.n) FILTER (s.n > 1) / any_value(t.n) AS frac_responses_in_multi,
           count(*) FILTER (s.n > 1 AND m > 0 AND m < 1) AS n_mixed_sessions,
           count(*) FILTER (s.n > 1 AND m > 0 AND m < 1) / count(*) FILTER (s.n > 1) AS frac_mixed_sessions,
           sum(v * s.n) / sum(s.n) AS within_variance, any_value(tv) AS total_variance,
           sum(v * s.n) / sum(s.n) / any_value(tv) AS within_over_total,
           any_value(-(p * ln(p) + (1 - p) * ln(1 - p))) AS prior_logloss, any_value(l) AS oracle_logloss
    FROM s, t, o""", "frac_multi_sessions frac_responses_in_multi frac_mixed_sessions within_variance total_variance within_over_total prior_logloss oracle_logloss"))
def _variance(spark, sf_dir):
    return OV.variance_decomposition(responses(spark, sf_dir))


@query("responses_per_session", "A2 A5", rounded(f"""
    WITH {R}, s AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM r GROUP BY session_id)
    SELECT {', '.join(f'quantile_cont(n, {q / 100}) AS p{q}' for q in (0, 1, 5, 25, 50, 75, 90, 95, 99, 100))},
           avg(n) AS mean, stddev_pop(n) AS std, count(*) AS n FROM s""",
    [f"p{q}" for q in (0, 1, 5, 25, 50, 75, 90, 95, 99, 100)] + ["mean", "std"]))
def _per_session(spark, sf_dir):
    from ..operators.stats import describe

    sizes = aggregate(responses(spark, sf_dir), ["session_id"], "count(1) AS n")
    return describe(sizes, [], "n")


@query("dataset_overview", "E21 A5 J2", rounded("""
    WITH d AS (SELECT doc_id, source, lang, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id))
    SELECT count(*) AS n_responses, count(DISTINCT source) AS n_sessions, count(DISTINCT lang) AS n_objectives,
           avg(quality) AS label_positive_rate, count(*) FILTER (quality IS NULL) AS n_missing_label,
           avg(CASE WHEN lang IS NULL THEN 1.0 ELSE 0.0 END) AS missing_objective,
           avg(CASE WHEN n_chars IS NULL THEN 1.0 ELSE 0.0 END) AS missing_size FROM d""",
    "label_positive_rate missing_objective missing_size"))
def _overview(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS response_id", "source AS session_id", "lang AS objective_id", "n_chars AS size"
    )
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id AS response_id", "CAST(quality AS DOUBLE) AS label")
    return OV.dataset_overview(rows, labels, {"objective_id": "missing_objective", "size": "missing_size"})


STATS = """
    SELECT session_id, count(*) AS n_utterances, CAST(sum(length(content)) AS BIGINT) AS n_chars,
           CAST(sum(length(content)) // 4 AS BIGINT) AS n_tokens,
           count(*) FILTER (role = 'student') AS n_student_utt, count(*) FILTER (role = 'tutor') AS n_tutor_utt,
           CAST(coalesce(sum(length(content)) FILTER (role = 'student'), 0) AS BIGINT) AS student_chars,
           CAST(coalesce(sum(length(content)) FILTER (role = 'tutor'), 0) AS BIGINT) AS tutor_chars,
           max(t_seconds) AS duration_s FROM u GROUP BY session_id"""


@query("session_statistics", "B17 T15 D14", rounded(
    f"WITH u AS (SELECT *, doc_id * 3.0::DOUBLE AS t_seconds FROM ({LONG})) {STATS}", "duration_s"))
def _session_stats(spark, sf_dir):
    return OV.session_statistics(long_rows(spark, sf_dir).selectExpr("*", "doc_id * 3D AS t_seconds"))


@query("corpus_summary", "B17 A2", rounded(f"""
    WITH u AS (SELECT *, doc_id * 3.0::DOUBLE AS t_seconds FROM ({LONG})), s AS ({STATS}),
    l AS (SELECT 'n_tokens' AS measure, CAST(n_tokens AS DOUBLE) AS x FROM s UNION ALL SELECT 'n_chars', n_chars FROM s
          UNION ALL SELECT 'n_utterances', n_utterances FROM s UNION ALL SELECT 'duration_s', duration_s FROM s)
    SELECT measure, quantile_cont(x, 0) AS p0, {', '.join(f'quantile_cont(x, {q / 100}) AS p{q}' for q in (1, 5, 25, 50, 75, 90, 95, 99, 100))},
           avg(x) AS mean, stddev_pop(x) AS std, count(*) AS n, sum(x) AS total FROM l GROUP BY measure""",
    [f"p{q}" for q in (0, 1, 5, 25, 50, 75, 90, 95, 99, 100)] + ["mean", "std", "total"]))
def _corpus(spark, sf_dir):
    stats = OV.session_statistics(long_rows(spark, sf_dir).selectExpr("*", "doc_id * 3D AS t_seconds"))
    return OV.corpus_summary(stats)
