"""Turn labels, dialogue moves and the session-scoped feedback and trajectory blocks."""

from __future__ import annotations

from ..functions import text as X
from ..plans.dialogue import (
    FEEDBACK_COLUMNS, TRAJECTORY_COLUMNS, labelled_turns, session_feedback, session_trajectory,
)
from .inputs import LONG, SHORT, long_rows, numbered, short_utterances
from .registry import query, rounded
from .sessions import div, phrases_sql, quoted


def label_sql(text: str) -> str:
    low = f"lower(coalesce({text}, ''))"
    n = lambda m: f"({phrases_sql(low, m)})"
    return (
        f"CASE WHEN {n(X.CORRECTION_MARKERS)} > {n(X.AFFIRM_MARKERS)} THEN 'correct' "
        f"WHEN {n(X.AFFIRM_MARKERS)} > 0 THEN 'affirm' "
        f"WHEN {n(X.REEXPLAIN_MARKERS)} > 0 OR length({low}) > 200 THEN 'reexplain' ELSE 'other' END"
    )


def rule_sql(text: str, tests: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN '{m}'" for m, t in tests) + f" ELSE '{default}' END"


def move_sql(role: str, text: str) -> str:
    has = lambda p: f"regexp_matches({text}, {quoted(p)})"
    tutor = rule_sql(text, [
        ("managing", has(X.MOVE_MANAGING)), ("checking", has(X.MOVE_CHECKING)),
        ("correcting", has(X.MOVE_CORRECTING)), ("affirming", has(X.MOVE_AFFIRMING)),
        ("scaffolding", has(X.MOVE_SCAFFOLDING)), ("questioning", f"contains({text}, '?')"),
    ], "explaining")
    student = rule_sql(text, [
        ("expressing_confusion", has(X.MOVE_CONFUSED)), ("asking", f"contains({text}, '?')"),
        ("acknowledging", has(X.MOVE_ACKNOWLEDGING)), ("off_task", f"length({text}) < 3"),
    ], "answering")
    return (f"CASE WHEN {role} = 'tutor' THEN {tutor} WHEN {role} = 'student' THEN {student} "
            "ELSE 'managing' END")


TRIM = r"regexp_replace(content, '^\s+|\s+$', '', 'g')"


@query("tutor_turn_labels", "C1 C2 P4", f"""
    SELECT session_id, pos, {label_sql('content')} AS label FROM ({SHORT}) WHERE role = 'tutor'""")
def _labels(spark, sf_dir):
    turns = short_utterances(spark, sf_dir).where("role = 'tutor'")
    return turns.selectExpr("session_id", "pos", f"{X.tutor_turn_label('content')} AS label")


def whole_words_sql(text: str, phrases) -> str:
    # RE2 has no look-around; a phrase that ends in punctuation takes the next character instead
    tail = lambda p: r"\b" if p[-1].isalpha() else "($|[^A-Za-z0-9_])"
    return " + ".join(f"len(regexp_extract_all({text}, {quoted(chr(92) + 'b' + p + tail(p))}))" for p in phrases)


def label_whole_words_sql(text: str) -> str:
    low = f"lower(coalesce({text}, ''))"
    n = lambda m: f"({whole_words_sql(low, m)})"
    return (
        f"CASE WHEN {n(X.CORRECTION_MARKERS)} > {n(X.AFFIRM_MARKERS)} THEN 'correct' "
        f"WHEN {n(X.AFFIRM_MARKERS)} > 0 THEN 'affirm' "
        f"WHEN {n(X.REEXPLAIN_MARKERS)} > 0 OR length({low}) > 200 THEN 'reexplain' ELSE 'other' END"
    )


@query("tutor_turn_labels_whole_words", "C1", f"""
    SELECT session_id, pos, {label_whole_words_sql('content')} AS label FROM ({SHORT}) WHERE role = 'tutor'""")
def _labels_bounded(spark, sf_dir):
    turns = short_utterances(spark, sf_dir).where("role = 'tutor'")
    return turns.selectExpr(
        "session_id", "pos", f"{X.tutor_turn_label('content', word_bounded=True)} AS label"
    )


@query("move_labels", "C3 P4", f"""
    SELECT session_id, pos, role, {move_sql('role', 'tc')} AS move
    FROM (SELECT *, {TRIM} AS tc FROM ({SHORT}))""")
def _moves(spark, sf_dir):
    return short_utterances(spark, sf_dir).selectExpr(
        "session_id", "pos", "role", f"{X.move_label('role', 'content')} AS move"
    )


RAW = ("CASE pos % 4 WHEN 0 THEN 'Affirming.' WHEN 1 THEN ' asking: maybe' WHEN 2 THEN 'nonsense' END")


@query("checked_external_labels", "C4", f"""
    WITH u AS (SELECT *, {TRIM} AS tc, {RAW} AS raw FROM ({SHORT})),
    f AS (SELECT *, regexp_replace(string_split_regex(lower(trim(coalesce(raw, ''))), '\\s+')[1],
                                   '^[.,:;]+|[.,:;]+$', '', 'g') AS first FROM u)
    SELECT session_id, pos, role,
           CASE WHEN role = 'tutor' AND first IN {X.TUTOR_MOVES} THEN first
                WHEN role <> 'tutor' AND first IN {X.STUDENT_MOVES} THEN first
                ELSE {move_sql('role', 'tc')} END AS move
    FROM f""")
def _checked(spark, sf_dir):
    rows = short_utterances(spark, sf_dir).selectExpr("*", f"{RAW} AS raw")
    return rows.selectExpr(
        "session_id", "pos", "role", f"{X.accepted_label('raw', 'role', 'content')} AS move"
    )


MOVES = tuple(dict.fromkeys(X.TUTOR_MOVES + X.STUDENT_MOVES))


@query("move_distribution", "C5 A13", f"""
    WITH m AS (SELECT role, {move_sql('role', 'tc')} AS move FROM (SELECT *, {TRIM} AS tc FROM ({LONG})))
    SELECT role, {', '.join(f"count(*) FILTER (move = '{m}') AS {m}" for m in MOVES)}
    FROM m GROUP BY role""")
def _distribution(spark, sf_dir):
    moves = long_rows(spark, sf_dir).selectExpr(
        "role", f"{X.move_label('role', 'content')} AS move"
    )
    return moves.groupBy("role").pivot("move", list(MOVES)).count().na.fill(0)


def base_sql(rows: str, keys: str) -> str:
    """CTEs up to ``base``: one row per scope with every count the two blocks need.

    ``rows`` yields keys, pos, role, content; the walk is restated with window functions.
    """
    islands = {
        "a": "label = 'affirm'",
        "c": "label = 'correct'",
        "r": "label IN ('affirm', 'correct', 'reexplain')",
        "x": "label IN ('affirm', 'reexplain')",
    }
    count = lambda t: (
        f"coalesce(sum(CASE WHEN {t} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY pos "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    )
    thirds = {
        1: "pos < greatest(n // 3, 1)",
        2: "pos >= n // 3 AND pos < greatest((2 * n) // 3, n // 3 + 1)",
        3: "pos >= (2 * n) // 3",
    }
    third = ", ".join(
        f"count(*) FILTER (({t}) AND role = 'tutor') AS tutor_{i}, "
        f"count(*) FILTER (({t}) AND label = 'correct') AS correct_{i}, "
        f"count(*) FILTER (({t}) AND label = 'affirm') AS affirm_{i}, "
        f"count(*) FILTER (({t}) AND role = 'student') AS student_{i}, "
        f"coalesce(sum(len) FILTER (({t}) AND role = 'student'), 0) AS chars_{i}"
        for i, t in thirds.items()
    )
    on = f"USING ({keys})"
    return f"""
    l AS (SELECT {keys}, pos, role, length(content) AS len,
                 CASE WHEN role = 'tutor' THEN {label_sql('content')} END AS label FROM ({rows})),
    k AS (SELECT *, lag(role) OVER (PARTITION BY {keys} ORDER BY pos) AS pr,
                 count(*) OVER (PARTITION BY {keys}) AS n,
                 {', '.join(f"{count(t)} AS i_{i}" for i, t in islands.items())} FROM l),
    ia AS (SELECT {keys}, i_a, count(*) FILTER (role = 'student') AS ns,
                  count(*) FILTER (label = 'correct') AS nc, count(*) FILTER (label = 'affirm') AS na
           FROM k GROUP BY {keys}, i_a),
    ra AS (SELECT {keys}, max(ns) AS unaffirmed_run, max(nc) AS correction_run,
                  count(*) FILTER (nc > 0 AND na > 0) AS repairs FROM ia GROUP BY {keys}),
    ic AS (SELECT {keys}, i_c, count(*) FILTER (label = 'affirm') AS na FROM k GROUP BY {keys}, i_c),
    rc AS (SELECT {keys}, max(na) AS affirm_run FROM ic GROUP BY {keys}),
    ir AS (SELECT {keys}, i_r, count(*) FILTER (role = 'student') AS ns,
                  count(*) FILTER (label = 'affirm') AS na FROM k GROUP BY {keys}, i_r),
    rr AS (SELECT {keys}, coalesce(avg(ns) FILTER (na > 0 AND ns > 0), 0.0) AS mean_attempts,
                  coalesce(max(ns) FILTER (na > 0 AND ns > 0), 0) AS max_attempts,
                  count(*) FILTER (na > 0 AND ns > 0) AS episodes FROM ir GROUP BY {keys}),
    ix AS (SELECT {keys}, i_x, count(*) FILTER (label = 'correct') AS nc FROM k GROUP BY {keys}, i_x),
    rx AS (SELECT {keys}, max(nc) AS correction_streak FROM ix GROUP BY {keys}),
    st AS (SELECT {keys}, len, row_number() OVER (PARTITION BY {keys} ORDER BY pos) - 1 AS i
           FROM k WHERE role = 'student'),
    rs AS (SELECT {keys},
                  CASE WHEN count(*) < 3 THEN 0.0 ELSE regr_slope(len, CAST(i AS DOUBLE)) * (count(*) - 1) END AS len_slope,
                  CASE WHEN count(*) < 3 OR var_pop(len) = 0 THEN 0.0 ELSE regr_r2(len, CAST(i AS DOUBLE)) END AS len_r2
           FROM st GROUP BY {keys}),
    g AS (SELECT {keys}, count(*) AS n, count(*) FILTER (role = 'tutor') AS n_tutor,
                 count(*) FILTER (role = 'student') AS n_student,
                 count(*) FILTER (label = 'affirm') AS n_affirm,
                 count(*) FILTER (label = 'correct') AS n_correct,
                 count(*) FILTER (label = 'reexplain') AS n_reexplain,
                 count(*) FILTER (pr = 'student' AND label = 'affirm') AS after_affirm,
                 count(*) FILTER (pr = 'student' AND label = 'correct') AS after_correct,
                 count(*) FILTER (pr = 'student' AND label = 'reexplain') AS after_reexplain,
                 coalesce(max(pos) FILTER (label = 'correct'), -1) AS last_correct,
                 coalesce(max(pos) FILTER (label = 'affirm'), -1) AS last_affirm,
                 coalesce(arg_max(CASE label WHEN 'affirm' THEN 1.0 WHEN 'correct' THEN -1.0 ELSE 0.0 END, pos)
                            FILTER (role = 'tutor' AND pr = 'student'), 0.0) AS valence,
                 {third} FROM k GROUP BY {keys}),
    base AS (SELECT g.*, ra.* EXCLUDE ({keys}), rc.* EXCLUDE ({keys}), rr.* EXCLUDE ({keys}),
                    rx.* EXCLUDE ({keys}), coalesce(len_slope, 0.0) AS len_slope,
                    coalesce(len_r2, 0.0) AS len_r2
             FROM g JOIN ra {on} JOIN rc {on} JOIN rr {on} JOIN rx {on} LEFT JOIN rs {on})"""


def feedback_sql(keys: str, p: str, source: str = "base") -> str:
    responded = "after_affirm + after_correct + after_reexplain"
    place = lambda c: f"CASE WHEN {c} >= 0 THEN {c} / greatest(n - 1, 1) ELSE -1.0 END"
    cols = {
        "n_affirm": "CAST(n_affirm AS DOUBLE)", "n_correct": "CAST(n_correct AS DOUBLE)",
        "n_reexplain": "CAST(n_reexplain AS DOUBLE)", "affirm_rate": div("n_affirm", "n_tutor"),
        "correct_rate": div("n_correct", "n_tutor"), "reexplain_rate": div("n_reexplain", "n_tutor"),
        "corrective_ratio": div("n_correct", "n_correct + n_affirm"),
        "mean_attempts_before_affirm": "mean_attempts",
        "max_attempts_before_affirm": "CAST(max_attempts AS DOUBLE)",
        "n_affirmed_episodes": "CAST(episodes AS DOUBLE)",
        "reexplain_after_attempt_rate": div("after_reexplain", responded),
        "correct_after_attempt_rate": div("after_correct", responded),
        "affirm_after_attempt_rate": div("after_affirm", responded),
        "repair_rate": div("repairs", "n_correct"), "n_repairs": "CAST(repairs AS DOUBLE)",
        "n_unrepaired_corrections": "CAST(n_correct - repairs AS DOUBLE)",
        "last_correction_pos": place("last_correct"), "last_affirm_pos": place("last_affirm"),
        "ends_on_affirm": "CAST(sign(last_affirm - last_correct) AS DOUBLE)",
        "max_correction_streak": "CAST(correction_streak AS DOUBLE)",
    }
    return f"SELECT {keys}, " + ", ".join(f"{e} AS {p}{c}" for c, e in cols.items()) + f" FROM {source}"


def trajectory_sql(keys: str, p: str = "traj_", source: str = "base") -> str:
    rate = lambda w, i: div(f"{w}_{i}", f"tutor_{i}")
    size = lambda i: div(f"chars_{i}", f"student_{i}")
    cols = {"student_len_slope": "len_slope", "student_len_r2": "len_r2",
            "n_student_turns": "CAST(n_student AS DOUBLE)"}
    for i in (1, 2, 3):
        cols[f"correct_rate_t{i}"] = f"CASE WHEN n > 0 THEN {rate('correct', i)} END"
        cols[f"affirm_rate_t{i}"] = f"CASE WHEN n > 0 THEN {rate('affirm', i)} END"
        cols[f"mean_student_len_t{i}"] = f"CASE WHEN n > 0 THEN {size(i)} END"
    end = lambda c: f"CASE WHEN {c} >= 0 THEN (n - 1 - {c}) / greatest(n - 1, 1) ELSE 1.0 END"
    cols |= {
        "correct_rate_delta": f"{rate('correct', 3)} - {rate('correct', 1)}",
        "affirm_rate_delta": f"{rate('affirm', 3)} - {rate('affirm', 1)}",
        "student_len_delta": f"{size(3)} - {size(1)}",
        "last_correction_from_end": end("last_correct"), "last_affirm_from_end": end("last_affirm"),
        "ends_on_affirm": "CASE WHEN last_affirm > last_correct THEN 1.0 ELSE 0.0 END",
        "ends_on_correction": "CASE WHEN last_correct > last_affirm THEN 1.0 ELSE 0.0 END",
        "final_exchange_valence": "valence",
        "max_unaffirmed_student_run": "CAST(unaffirmed_run AS DOUBLE)",
        "max_correction_run": "CAST(correction_run AS DOUBLE)",
        "max_affirm_run": "CAST(affirm_run AS DOUBLE)",
    }
    return f"SELECT {keys}, " + ", ".join(f"{e} AS {p}{c}" for c, e in cols.items()) + f" FROM {source}"


FBS = [f"fbs_{c}" for c in FEEDBACK_COLUMNS]
TRAJ = [f"traj_{c}" for c in TRAJECTORY_COLUMNS]


@query("session_feedback", "B10 W8 W9 W10 W11 W12",
       rounded(f"WITH {base_sql(LONG, 'session_id')} {feedback_sql('session_id', 'fbs_')}", FBS))
def _feedback(spark, sf_dir):
    return session_feedback(*numbered(spark, sf_dir, labelled_turns(long_rows(spark, sf_dir), "doc_id")))


@query("session_trajectory", "B11 W13 W14 W15 W16 W17 A6 A7",
       rounded(f"WITH {base_sql(LONG, 'session_id')} {trajectory_sql('session_id')}", TRAJ))
def _trajectory(spark, sf_dir):
    return session_trajectory(*numbered(spark, sf_dir, labelled_turns(long_rows(spark, sf_dir), "doc_id")))


@query("session_feedback_short", "B10",
       rounded(f"WITH {base_sql(SHORT, 'session_id')} {feedback_sql('session_id', 'fbs_')}", FBS))
def _feedback_short(spark, sf_dir):
    return session_feedback(short_utterances(spark, sf_dir), chunked=True)


@query("session_trajectory_short", "B11",
       rounded(f"WITH {base_sql(SHORT, 'session_id')} {trajectory_sql('session_id')}", TRAJ))
def _trajectory_short(spark, sf_dir):
    return session_trajectory(short_utterances(spark, sf_dir), chunked=True)


@query("role_profile", "A14 A5 T5", rounded(f"""
    WITH u AS ({LONG}), t AS (SELECT count(*) AS n_all FROM u)
    SELECT role, count(*) AS n_utterances, count(*) / max(n_all) AS share_of_utterances,
           quantile_cont(CAST(length(content) AS DOUBLE), 0.5) AS median_chars,
           avg(length(content)) AS mean_chars, max(length(content)) AS max_chars,
           avg(CASE WHEN length(content) > 200 THEN 1.0 ELSE 0.0 END) AS frac_long,
           sum(len(regexp_extract_all(content, '(?i)\\[unclear\\]'))) / count(*) AS unclear_rate,
           count(DISTINCT content) AS n_distinct_strings,
           CASE WHEN avg(CASE WHEN length(content) > 200 THEN 1.0 ELSE 0.0 END) > 0.01
                THEN 'contains_real_speech' ELSE 'likely_noise_only' END AS verdict
    FROM u, t GROUP BY role""", "share_of_utterances median_chars mean_chars frac_long unclear_rate"))
def _role_profile(spark, sf_dir):
    from ..plans.overview import role_profile

    return role_profile(long_rows(spark, sf_dir))
