"""Talk-structure features per session (35 columns, prefix ``struct_``)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.scalars import safe_div
from ..functions.text import ROLES
from ..operators.ordered import aggregate, by_position, has_large_groups, neighbours, scan
from ..operators.stats import histogram, robust_rows, robust_wide, row_ranks
from ..session import cut


def turn_lengths(utterances: DataFrame, *keep: str) -> DataFrame:
    """Narrow rows: role and length; the text is dropped here."""
    size = "len" if "len" in utterances.columns else "length(coalesce(content, '')) AS len"
    return utterances.selectExpr("session_id", *(keep or ("pos",)), "role", size)


def totals_of(change: str) -> list[str]:
    """Counts and ratios of a session from rows with ``role, len`` and a change flag."""
    total = "sum(len)"
    n = {r: f"count_if(role = '{r}')" for r in ROLES}
    chars = {r: f"coalesce(sum(CASE WHEN role = '{r}' THEN len END), 0)" for r in ROLES}
    basics = ["CAST(count(1) AS DOUBLE) AS struct_n_utterances"]
    for r in ROLES:
        basics += [
            f"CAST({n[r]} AS DOUBLE) AS struct_n_{r}",
            f"CAST({chars[r]} AS DOUBLE) AS struct_chars_{r}",
            f"{safe_div(n[r], 'count(1)')} AS struct_frac_utt_{r}",
            f"{safe_div(chars[r], n[r])} AS struct_mean_len_{r}",
        ]
    return basics + [
        f"{safe_div(chars['student'], chars['student'] + ' + ' + chars['tutor'])} AS struct_student_talk_ratio",
        f"{safe_div(n['student'], n['student'] + ' + ' + n['tutor'])} AS struct_student_turn_ratio",
        f"CAST({total} AS DOUBLE) AS struct_total_chars",
        f"CAST(sum({change}) AS DOUBLE) AS struct_role_switches",
        f"{safe_div(f'sum({change})', 'count(1)')} AS struct_switch_rate",
        f"{safe_div(chars['background'], total)} AS struct_background_char_frac",
    ]


def session_structure(utterances: DataFrame, chunked: bool | None = None) -> DataFrame:
    """One row per session.  Small sessions: one exchange, three sorts, one aggregate."""
    chunked = has_large_groups(utterances) if chunked is None else chunked
    if chunked:
        return _chunked_structure(turn_lengths(utterances))
    by = "OVER (PARTITION BY session_id ORDER BY pos)"
    rows = (
        turn_lengths(utterances)
        .selectExpr(
            "*", f"CASE WHEN role <> lag(role) {by} THEN 1L ELSE 0L END AS change",
            f"NOT (lead(role) {by} <=> role) AS ends",
        )
        .selectExpr("*", f"pos - coalesce(max(CASE WHEN change = 1 THEN pos END) {by}, 0) + 1 AS run_len")
        .selectExpr("*", *row_ranks(["session_id", "role"], "len", "l", "true"))
        .selectExpr("*", *row_ranks(["session_id"], "run_len", "r", "ends"))
    )
    spread = [e for r in ROLES for e in robust_rows("len", "l", f"role = '{r}'", f"struct_len_{r}")]
    return aggregate(rows, ["session_id"], *totals_of("change"), *spread,
                     *robust_rows("run_len", "r", "ends", "struct_runlen"))


def speaker_changes(utterances: DataFrame, chunked: bool) -> DataFrame:
    """``change`` is 1 on rows whose role differs from the row before (0 on the first)."""
    return neighbours(turn_lengths(utterances), {"prev_role": "role"}, chunked).selectExpr(
        "*", "CASE WHEN role <> prev_role THEN 1L ELSE 0L END AS change"
    )


def speaker_runs(utterances: DataFrame, chunked: bool) -> DataFrame:
    """Length of every maximal run of one role: ``session_id, run_id, run_len``."""
    numbered = scan(speaker_changes(utterances, chunked), by_position(chunked),
                    running={"before": "change"})
    return aggregate(
        numbered.selectExpr("session_id", "before + change AS run_id"),
        ["session_id", "run_id"], "count(1) AS run_len",
    )


def _chunked_structure(lengths: DataFrame) -> DataFrame:
    """Sessions of any size: narrow rows are written once, then read by three jobs."""
    narrow = cut(lengths)
    flagged = speaker_changes(narrow, True)
    totals = aggregate(flagged, ["session_id"], *totals_of("change"))
    known = ", ".join(f"'{r}'" for r in ROLES)
    sizes = histogram(narrow.where(f"role IN ({known})"), ["session_id", "role"], "len")
    runs = speaker_runs(narrow, True).selectExpr("session_id", "'_run' AS role", "run_len")
    spread = robust_wide(
        sizes.unionByName(histogram(runs, ["session_id", "role"], "run_len")),
        ["session_id"], "role", {**{r: f"struct_len_{r}" for r in ROLES}, "_run": "struct_runlen"}, True,
    )
    return totals.join(spread, "session_id")
