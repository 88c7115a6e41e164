"""Tutor-feedback (20 columns) and trajectory (23 columns) features of a stretch of dialogue.

The stretch is a session, or the topic-relevant passages of one.  Walking the turns with
counters needs no per-row state: a running count never falls, so its value at the last
resetting turn is the running maximum over resetting turns, and a streak is the difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.scalars import safe_div
from ..functions import text as X
from ..operators.ordered import Sequence, aggregate, by_position, scan
from ..operators.stats import slope
from ..session import cut

AFFIRM, CORRECT = "(label <=> 'affirm')", "(label <=> 'correct')"
REEXPLAIN = "(label <=> 'reexplain')"
STUDENT = "(role = 'student')"


def one_if(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1L ELSE 0L END"


# running count -> the turns that reset a streak of it
STREAKS = {
    "correct_by_affirm": ("n_correct", AFFIRM),
    "correct_by_praise_or_explain": ("n_correct", f"({AFFIRM} OR {REEXPLAIN})"),
    "affirm_by_correct": ("n_affirm", CORRECT),
    "student_by_affirm": ("n_student", AFFIRM),
    "student_by_any": ("n_student", f"({AFFIRM} OR {CORRECT} OR {REEXPLAIN})"),
}


def labelled_turns(utterances: DataFrame, *keep: str) -> DataFrame:
    """Narrow rows for the dialogue features; the text is reduced to a label and a length.

    The lower-cased text and the marker counts are columns of their own, so each is
    evaluated once per tutor turn.  ``keep`` names the order columns (default ``pos``).
    """
    keep = keep or ("pos",)
    staged = utterances.selectExpr(
        "session_id", *keep, "role", "length(coalesce(content, '')) AS len",
        "CASE WHEN role = 'tutor' THEN lower(coalesce(content, '')) END AS low",
    ).selectExpr(
        "*", f"{X.phrase_count('low', X.CORRECTION_MARKERS)} AS _c",
        f"{X.phrase_count('low', X.AFFIRM_MARKERS)} AS _a",
    )
    explained = f"{X.phrase_count('low', X.REEXPLAIN_MARKERS)} > 0"
    label = (
        "CASE WHEN low IS NULL THEN NULL WHEN _c > _a THEN 'correct' WHEN _a > 0 THEN 'affirm' "
        f"WHEN length(low) > {X.LONG_TURN_CHARS} OR {explained} THEN 'reexplain' ELSE 'other' END"
    )
    return staged.selectExpr("session_id", *keep, "role", "len", f"{label} AS label")


def walked(turns: DataFrame, keys: tuple[str, ...], chunked: bool) -> DataFrame:
    """Turns with the previous role, counts so far (this row included) and streak bases.

    ``base_*`` is the count at the last resetting turn before the row.
    """
    seq = Sequence(keys, ("pos",), by_position(chunked, keys).chunk)
    flags = {"n_correct": CORRECT, "n_affirm": AFFIRM, "n_student": STUDENT}
    counted = scan(
        turns, seq, prev={"prev_role": "role"},
        running={f"_{n}": one_if(test) for n, test in flags.items()}, totals={"n": ("sum", "1L")},
    ).selectExpr(
        *turns.columns, "prev_role", "n", "_n_student AS student_idx",
        *[f"_{n} + {one_if(test)} AS {n}" for n, test in flags.items()],
    )
    bases = {f"base_{s}": f"CASE WHEN {reset} THEN {count} END" for s, (count, reset) in STREAKS.items()}
    return scan(counted, seq, peak=bases)


def since(streak: str) -> str:
    """The streak's count at a row since the last resetting turn before it."""
    return f"({STREAKS[streak][0]} - coalesce(base_{streak}, 0))"


def streak_aggregates() -> list[str]:
    attempted = f"{AFFIRM} AND {since('student_by_any')} > 0"
    repaired = f"{AFFIRM} AND {since('correct_by_affirm')} > 0"
    longest = lambda s, on: f"coalesce(max(CASE WHEN {on} THEN {since(s)} END), 0)"
    return [
        f"coalesce(avg(CASE WHEN {attempted} THEN {since('student_by_any')} END), 0D) AS mean_attempts",
        f"coalesce(max(CASE WHEN {attempted} THEN {since('student_by_any')} END), 0) AS max_attempts",
        f"count_if({attempted}) AS episodes",
        f"count_if({repaired}) AS repairs",
        f"{longest('correct_by_praise_or_explain', CORRECT)} AS correction_streak",
        f"{longest('student_by_affirm', STUDENT)} AS unaffirmed_run",
        f"{longest('correct_by_affirm', CORRECT)} AS correction_run",
        f"{longest('affirm_by_correct', AFFIRM)} AS affirm_run",
    ]


THIRDS = (
    "pos < greatest(n div 3, 1)",
    "pos >= n div 3 AND pos < greatest(2 * n div 3, n div 3 + 1)",
    "pos >= 2 * n div 3",
)


def dialogue_base(turns: DataFrame, keys: tuple[str, ...], chunked: bool) -> DataFrame:
    """One row per scope with every count both blocks are built from."""
    rows = walked(cut(turns) if chunked else turns, keys, chunked)
    reply = "role = 'tutor' AND prev_role = 'student'"
    valence = f"CASE WHEN {AFFIRM} THEN 1D WHEN {CORRECT} THEN -1D ELSE 0D END"
    steep, fit = slope(f"(CASE WHEN {STUDENT} THEN len END)", "student_idx", 3)
    per_third = []
    for i, inside in enumerate(THIRDS, start=1):
        per_third += [
            f"count_if(({inside}) AND role = 'tutor') AS tutor_{i}",
            f"count_if(({inside}) AND {CORRECT}) AS correct_{i}",
            f"count_if(({inside}) AND {AFFIRM}) AS affirm_{i}",
            f"count_if(({inside}) AND {STUDENT}) AS student_{i}",
            f"coalesce(sum(CASE WHEN ({inside}) AND {STUDENT} THEN len END), 0) AS chars_{i}",
        ]
    return aggregate(
        rows, keys,
        "count(1) AS n",
        "count_if(role = 'tutor') AS n_tutor",
        f"count_if{STUDENT} AS n_student",
        f"count_if{AFFIRM} AS n_affirm", f"count_if{CORRECT} AS n_correct",
        f"count_if{REEXPLAIN} AS n_reexplain",
        f"count_if({reply} AND {AFFIRM}) AS after_affirm",
        f"count_if({reply} AND {CORRECT}) AS after_correct",
        f"count_if({reply} AND {REEXPLAIN}) AS after_reexplain",
        f"coalesce(max(CASE WHEN {CORRECT} THEN pos END), -1) AS last_correct",
        f"coalesce(max(CASE WHEN {AFFIRM} THEN pos END), -1) AS last_affirm",
        f"coalesce(max_by(CASE WHEN {reply} THEN {valence} END, CASE WHEN {reply} THEN pos END), 0D) AS valence",
        f"{steep} AS len_slope", f"{fit} AS len_r2",
        *per_third,
        *streak_aggregates(),
    )


def feedback_columns(prefix: str) -> list[str]:
    """Feedback columns over ``dialogue_base`` rows."""
    responded = "after_affirm + after_correct + after_reexplain"
    place = lambda c: f"CASE WHEN {c} >= 0 THEN {c} / greatest(n - 1, 1) ELSE -1D END"
    cols = {
        "n_affirm": "CAST(n_affirm AS DOUBLE)",
        "n_correct": "CAST(n_correct AS DOUBLE)",
        "n_reexplain": "CAST(n_reexplain AS DOUBLE)",
        "affirm_rate": safe_div("n_affirm", "n_tutor"),
        "correct_rate": safe_div("n_correct", "n_tutor"),
        "reexplain_rate": safe_div("n_reexplain", "n_tutor"),
        "corrective_ratio": safe_div("n_correct", "n_correct + n_affirm"),
        "mean_attempts_before_affirm": "mean_attempts",
        "max_attempts_before_affirm": "CAST(max_attempts AS DOUBLE)",
        "n_affirmed_episodes": "CAST(episodes AS DOUBLE)",
        "reexplain_after_attempt_rate": safe_div("after_reexplain", responded),
        "correct_after_attempt_rate": safe_div("after_correct", responded),
        "affirm_after_attempt_rate": safe_div("after_affirm", responded),
        # a correction is repaired when an affirmation follows before the next correction
        "repair_rate": safe_div("repairs", "n_correct"),
        "n_repairs": "CAST(repairs AS DOUBLE)",
        "n_unrepaired_corrections": "CAST(n_correct - repairs AS DOUBLE)",
        "last_correction_pos": place("last_correct"),
        "last_affirm_pos": place("last_affirm"),
        "ends_on_affirm": "CAST(sign(last_affirm - last_correct) AS DOUBLE)",
        "max_correction_streak": "CAST(correction_streak AS DOUBLE)",
    }
    return [f"{e} AS {prefix}{c}" for c, e in cols.items()]


def trajectory_columns(prefix: str = "traj_") -> list[str]:
    """Order-sensitive columns; the per-third ones are null on an empty scope (``n = 0``)."""
    rate = lambda what, i: safe_div(f"{what}_{i}", f"tutor_{i}")
    length = lambda i: safe_div(f"chars_{i}", f"student_{i}")
    from_end = lambda c: (
        f"CASE WHEN {c} >= 0 THEN (n - 1 - {c}) / greatest(n - 1, 1) ELSE 1D END"
    )
    cols = {
        "student_len_slope": "len_slope",
        "student_len_r2": "len_r2",
        "n_student_turns": "CAST(n_student AS DOUBLE)",
    }
    for i in (1, 2, 3):
        for name, e in (("correct_rate", rate("correct", i)), ("affirm_rate", rate("affirm", i)),
                        ("mean_student_len", length(i))):
            cols[f"{name}_t{i}"] = f"CASE WHEN n > 0 THEN {e} END"
    cols |= {
        "correct_rate_delta": f"{rate('correct', 3)} - {rate('correct', 1)}",
        "affirm_rate_delta": f"{rate('affirm', 3)} - {rate('affirm', 1)}",
        "student_len_delta": f"{length(3)} - {length(1)}",
        "last_correction_from_end": from_end("last_correct"),
        "last_affirm_from_end": from_end("last_affirm"),
        "ends_on_affirm": "CASE WHEN last_affirm >= 0 AND last_affirm > last_correct THEN 1D ELSE 0D END",
        "ends_on_correction": "CASE WHEN last_correct >= 0 AND last_correct > last_affirm THEN 1D ELSE 0D END",
        "final_exchange_valence": "valence",
        "max_unaffirmed_student_run": "CAST(unaffirmed_run AS DOUBLE)",
        "max_correction_run": "CAST(correction_run AS DOUBLE)",
        "max_affirm_run": "CAST(affirm_run AS DOUBLE)",
    }
    return [f"{e} AS {prefix}{c}" for c, e in cols.items()]


FEEDBACK_COLUMNS = (
    "n_affirm", "n_correct", "n_reexplain", "affirm_rate", "correct_rate", "reexplain_rate",
    "corrective_ratio", "mean_attempts_before_affirm", "max_attempts_before_affirm",
    "n_affirmed_episodes", "reexplain_after_attempt_rate", "correct_after_attempt_rate",
    "affirm_after_attempt_rate", "repair_rate", "n_repairs", "n_unrepaired_corrections",
    "last_correction_pos", "last_affirm_pos", "ends_on_affirm", "max_correction_streak",
)
TRAJECTORY_COLUMNS = (
    "student_len_slope", "student_len_r2", "n_student_turns", "correct_rate_t1", "affirm_rate_t1",
    "mean_student_len_t1", "correct_rate_t2", "affirm_rate_t2", "mean_student_len_t2",
    "correct_rate_t3", "affirm_rate_t3", "mean_student_len_t3", "correct_rate_delta",
    "affirm_rate_delta", "student_len_delta", "last_correction_from_end", "last_affirm_from_end",
    "ends_on_affirm", "ends_on_correction", "final_exchange_valence",
    "max_unaffirmed_student_run", "max_correction_run", "max_affirm_run",
)

SESSION = ("session_id",)


def session_feedback(turns: DataFrame, chunked: bool, prefix: str = "fbs_") -> DataFrame:
    """``turns`` are utterances or already labelled turns."""
    base = dialogue_base(labelled_or_label(turns), SESSION, chunked)
    return base.selectExpr(*SESSION, *feedback_columns(prefix))


def session_trajectory(turns: DataFrame, chunked: bool, prefix: str = "traj_") -> DataFrame:
    base = dialogue_base(labelled_or_label(turns), SESSION, chunked)
    return base.selectExpr(*SESSION, *trajectory_columns(prefix))


def labelled_or_label(turns: DataFrame) -> DataFrame:
    """Narrow labelled turns, from utterances or from rows that already carry labels."""
    return turns.select("session_id", "pos", "role", "len", "label") if "label" in turns.columns \
        else labelled_turns(turns)
