"""Session-level feature blocks."""

from __future__ import annotations

from ..functions import text as X
from ..plans.linguistic import session_linguistics, utterance_text_counts
from ..plans.structural import session_structure, turn_lengths
from ..plans.temporal import session_timing
from ..session import cut
from .inputs import LONG, SHORT, TIMED, long_rows, numbered, short_utterances, timed_utterances
from .registry import query, robust_sql, rounded

RS = ("median", "trimmean", "iqr", "p90")
STRUCT_COLUMNS = (
    ["struct_n_utterances"]
    + [f"struct_{a}_{r}" for r in X.ROLES for a in ("n", "chars", "frac_utt", "mean_len")]
    + [f"struct_len_{r}_{s}" for r in X.ROLES for s in RS]
    + ["struct_student_talk_ratio", "struct_student_turn_ratio", "struct_total_chars",
       "struct_role_switches", "struct_switch_rate"]
    + [f"struct_runlen_{s}" for s in RS]
    + ["struct_background_char_frac"]
)
TEMP_COLUMNS = (
    ["temp_duration_s", "temp_frac_timestamped"] + [f"temp_gap_{s}" for s in RS]
    + ["temp_n_long_pauses", "temp_long_pause_rate"]
    + [f"temp_student_latency_{s}" for s in RS]
    + ["temp_n_student_responses", "temp_student_latency_slope", "temp_utt_per_min"]
    + [f"temp_utt_frac_third{i}" for i in (1, 2, 3)]
)
LING_RATES = (
    "q_rate", "excl_rate", "unclear_rate", "false_start_rate", "selfcorr_rate", "hedge_rate",
    "affirm_rate", "negate_rate", "filler_rate", "check_rate", "repetition_rate", "mean_words",
    "type_token_ratio",
)
LING_COLUMNS = (
    [f"ling_{r}_{c}" for r in X.ROLES for c in LING_RATES]
    + [f"ling_{r}_words_{s}" for r in X.ROLES for s in RS]
    + ["ling_student_len_slope", "ling_student_len_r2", "ling_student_len_last_first_ratio",
       "ling_unclear_density_all", "ling_q_ratio_student_tutor"]
)


def div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


def structure_sql(source: str) -> str:
    per_role = ", ".join(
        f"CAST(n_{r} AS DOUBLE) AS struct_n_{r}, CAST(c_{r} AS DOUBLE) AS struct_chars_{r}, "
        f"{div(f'n_{r}', 'n')} AS struct_frac_utt_{r}, {div(f'c_{r}', f'n_{r}')} AS struct_mean_len_{r}, "
        + robust_sql(f"l_{r}", f"struct_len_{r}")
        for r in X.ROLES
    )
    gather = ", ".join(
        f"count(*) FILTER (role = '{r}') AS n_{r}, "
        f"coalesce(sum(length(content)) FILTER (role = '{r}'), 0) AS c_{r}, "
        f"list(CAST(length(content) AS DOUBLE)) FILTER (role = '{r}') AS l_{r}"
        for r in X.ROLES
    )
    return f"""
    WITH u AS ({source}),
    f AS (SELECT session_id, pos, CASE WHEN role <> lag(role) OVER w THEN 1 ELSE 0 END AS ch
          FROM u WINDOW w AS (PARTITION BY session_id ORDER BY pos)),
    r AS (SELECT session_id, sum(ch) OVER (PARTITION BY session_id ORDER BY pos) AS run, ch FROM f),
    runs AS (SELECT session_id, run, count(*) AS len FROM r GROUP BY ALL),
    rl AS (SELECT session_id, list(CAST(len AS DOUBLE)) AS l_run, count(*) - 1 AS switches
           FROM runs GROUP BY session_id),
    g AS (SELECT session_id, count(*) AS n, sum(length(content)) AS c, {gather} FROM u GROUP BY session_id)
    SELECT session_id, CAST(n AS DOUBLE) AS struct_n_utterances, {per_role},
           {div('c_student', 'c_student + c_tutor')} AS struct_student_talk_ratio,
           {div('n_student', 'n_student + n_tutor')} AS struct_student_turn_ratio,
           CAST(c AS DOUBLE) AS struct_total_chars,
           CAST(switches AS DOUBLE) AS struct_role_switches, {div('switches', 'n')} AS struct_switch_rate,
           {robust_sql('l_run', 'struct_runlen')},
           {div('c_background', 'c')} AS struct_background_char_frac
    FROM g JOIN rl USING (session_id)"""


@query("session_structure", "B1 A1 A3 A4 W1 W2", rounded(structure_sql(SHORT), STRUCT_COLUMNS))
def _structure(spark, sf_dir):
    return session_structure(short_utterances(spark, sf_dir))


@query("session_structure_long", "B1 A1 W2", rounded(structure_sql(LONG), STRUCT_COLUMNS))
def _structure_long(spark, sf_dir):
    narrow = turn_lengths(long_rows(spark, sf_dir), "doc_id")
    return session_structure(*numbered(spark, sf_dir, narrow))


TIMING_SQL = f"""
    WITH u AS ({TIMED}),
    p AS (SELECT *, t_seconds - lag(t_seconds) OVER w AS d, lag(role) OVER w AS pr
          FROM u WINDOW w AS (PARTITION BY session_id ORDER BY pos)),
    x AS (SELECT *, CASE WHEN d BETWEEN 0 AND 120 THEN d END AS gap,
                 CASE WHEN d BETWEEN 0 AND 120 AND role = 'student' AND pr = 'tutor' THEN d END AS lat
          FROM p),
    s AS (SELECT session_id, min(t_seconds) AS lo, max(t_seconds) AS hi FROM u GROUP BY session_id),
    li AS (SELECT session_id, lat, row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS i
           FROM x WHERE lat IS NOT NULL),
    ls AS (SELECT session_id, CASE WHEN count(*) < 5 THEN 0.0
                  ELSE regr_slope(lat, CAST(i AS DOUBLE)) * (count(*) - 1) END AS sl
           FROM li GROUP BY session_id),
    g AS (SELECT session_id, count(*) AS n, count(t_seconds) AS nt, any_value(hi - lo) AS dur,
                 count(*) FILTER (gap > 10) AS lp, list(gap) FILTER (gap IS NOT NULL) AS lg,
                 list(lat) FILTER (lat IS NOT NULL) AS ll, count(gap) AS ng, count(lat) AS nl,
                 count(*) FILTER (t_seconds >= lo AND t_seconds < lo + (hi - lo) / 3) AS a1,
                 count(*) FILTER (t_seconds >= lo + (hi - lo) / 3 AND t_seconds < lo + 2 * (hi - lo) / 3) AS a2,
                 count(*) FILTER (t_seconds >= lo + 2 * (hi - lo) / 3 AND t_seconds < hi) AS a3
          FROM x JOIN s USING (session_id) GROUP BY session_id)
    SELECT session_id, dur AS temp_duration_s, {div('nt', 'n')} AS temp_frac_timestamped,
           {robust_sql('lg', 'temp_gap')}, CAST(lp AS DOUBLE) AS temp_n_long_pauses,
           {div('lp', 'ng')} AS temp_long_pause_rate, {robust_sql('ll', 'temp_student_latency')},
           CAST(nl AS DOUBLE) AS temp_n_student_responses,
           coalesce(sl, 0.0) AS temp_student_latency_slope, {div('n', 'dur / 60.0')} AS temp_utt_per_min,
           CASE WHEN nt > 10 AND dur > 0 THEN a1 / greatest(a1 + a2 + a3, 1) ELSE 0.0 END AS temp_utt_frac_third1,
           CASE WHEN nt > 10 AND dur > 0 THEN a2 / greatest(a1 + a2 + a3, 1) ELSE 0.0 END AS temp_utt_frac_third2,
           CASE WHEN nt > 10 AND dur > 0 THEN a3 / greatest(a1 + a2 + a3, 1) ELSE 0.0 END AS temp_utt_frac_third3
    FROM g LEFT JOIN ls USING (session_id)"""


@query("session_timing", "B3 P5 W3 W4 W5 W6 A6", rounded(TIMING_SQL, TEMP_COLUMNS))
def _timing(spark, sf_dir):
    return session_timing(*timed_utterances(spark, sf_dir))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def phrases_sql(text: str, phrases) -> str:
    return " + ".join(
        f"(length({text}) - length(replace({text}, {quoted(p)}, ''))) // {len(p)}" for p in phrases
    )


def matches_sql(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {quoted(pattern)}))"


def linguistics_sql(source: str) -> str:
    words = f"regexp_extract_all(bare, {quoted(X.WORD)})"
    sums = ("q_rate", "excl_rate", "unclear_rate", "false_start_rate", "selfcorr_rate", "hedge_rate",
            "affirm_rate", "negate_rate", "filler_rate", "check_rate")
    rates = []
    for c in sums:
        if c in ("hedge_rate", "affirm_rate", "negate_rate", "filler_rate"):
            rates.append(f"{div(f's_{c}', 'greatest(nw, 1)')} * 100.0 AS {c}")
        elif c == "check_rate":
            rates.append(f"{div(f's_{c}', 'n')} * 100.0 AS {c}")
        else:
            rates.append(f"{div(f's_{c}', 'n')} AS {c}")
    rates += [
        "CASE WHEN nw < 2 THEN 0.0 ELSE reps / (nw - 1) END AS repetition_rate",
        f"{div('nw', 'n')} AS mean_words",
        f"{div('nd', 'nw')} AS type_token_ratio",
    ]
    wide = ", ".join(
        f"coalesce(max({c}) FILTER (role = '{r}'), 0.0) AS ling_{r}_{c}"
        for r in X.ROLES for c in LING_RATES
    )
    spread = ", ".join(
        f"coalesce(max(w_{s}) FILTER (role = '{r}'), 0.0) AS ling_{r}_words_{s}"
        for r in X.ROLES for s in RS
    )
    return f"""
    WITH u AS ({source}),
    b AS (SELECT *, lower(content) AS low,
                 regexp_replace(lower(content), {quoted(X.BRACKET)}, ' ', 'g') AS bare FROM u),
    t AS (SELECT session_id, pos, role, length(content) AS len, {words} AS ws,
                 CAST(contains(content, '?') AS INT) AS q_rate, CAST(contains(content, '!') AS INT) AS excl_rate,
                 {matches_sql('content', X.UNCLEAR)} AS unclear_rate,
                 {matches_sql('bare', X.FALSE_START)} AS false_start_rate,
                 {matches_sql('low', X.SELF_CORRECTION)} AS selfcorr_rate,
                 {phrases_sql('low', X.HEDGE)} AS hedge_rate, {phrases_sql('low', X.AFFIRM)} AS affirm_rate,
                 {phrases_sql('low', X.NEGATE)} AS negate_rate, {phrases_sql('low', X.FILLER)} AS filler_rate,
                 {phrases_sql('low', X.UNDERSTAND_CHECK)} AS check_rate
          FROM b),
    sr AS (SELECT session_id, role, count(*) AS n, {', '.join(f'sum({c}) AS s_{c}' for c in sums)},
                  sum(len(ws)) AS nw, list(CAST(len(ws) AS DOUBLE)) AS lw
           FROM t WHERE role IN ('tutor', 'student', 'background') GROUP BY ALL),
    w AS (SELECT session_id, role, pos, generate_subscripts(ws, 1) AS j, unnest(ws) AS word FROM t),
    wn AS (SELECT session_id, role, word,
                  lag(word) OVER (PARTITION BY session_id, role ORDER BY pos, j) AS before FROM w),
    wa AS (SELECT session_id, role, count(DISTINCT word) AS nd, count(*) FILTER (word = before) AS reps
           FROM wn GROUP BY ALL),
    v0 AS (SELECT sr.*, coalesce(nd, 0) AS nd, coalesce(reps, 0) AS reps
           FROM sr LEFT JOIN wa USING (session_id, role)),
    v AS (SELECT session_id, role, {', '.join(rates)}, {robust_sql('lw', 'w')} FROM v0),
    st AS (SELECT session_id, len, row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS i,
                  count(*) OVER (PARTITION BY session_id) AS k
           FROM t WHERE role = 'student'),
    tr AS (SELECT session_id,
                  CASE WHEN count(*) >= 5 THEN regr_slope(len, CAST(i AS DOUBLE)) * (count(*) - 1) ELSE 0.0 END AS sl,
                  CASE WHEN count(*) < 5 OR var_pop(len) = 0 THEN 0.0 ELSE regr_r2(len, CAST(i AS DOUBLE)) END AS r2,
                  CASE WHEN count(*) < 5 THEN 0.0
                       ELSE {div('avg(len) FILTER (i >= k - greatest(1, k // 4))', 'avg(len) FILTER (i < greatest(1, k // 4))')} END AS lf
           FROM st GROUP BY session_id),
    al AS (SELECT session_id, sum(unclear_rate) / count(*) AS ling_unclear_density_all FROM t GROUP BY session_id),
    wd AS (SELECT session_id, {wide}, {spread} FROM v GROUP BY session_id)
    SELECT al.*, coalesce(sl, 0.0) AS ling_student_len_slope, coalesce(r2, 0.0) AS ling_student_len_r2,
           coalesce(lf, 0.0) AS ling_student_len_last_first_ratio, wd.* EXCLUDE (session_id),
           {div('ling_student_q_rate', 'ling_tutor_q_rate')} AS ling_q_ratio_student_tutor
    FROM al LEFT JOIN tr USING (session_id) LEFT JOIN wd USING (session_id)"""


@query("session_linguistics", "B2 T1 T2 T3 T4 T5 T6 T7 T8 T9 A6 A7 W7",
       rounded(linguistics_sql(SHORT), LING_COLUMNS))
def _linguistics(spark, sf_dir):
    return session_linguistics(short_utterances(spark, sf_dir))


@query("session_linguistics_long", "B2 T7 T8 A7 W7", rounded(linguistics_sql(LONG), LING_COLUMNS))
def _linguistics_long(spark, sf_dir):
    rows = long_rows(spark, sf_dir)
    read = cut(utterance_text_counts(rows, "doc_id", words=True))
    counts, chunked = numbered(spark, sf_dir, read.drop("words"))
    return session_linguistics(rows, chunked, counts, read.select("session_id", "role", "words"))
