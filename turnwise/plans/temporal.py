"""Timing features per session (18 columns, prefix ``temp_``)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.scalars import num, safe_div
from ..operators.ordered import aggregate, by_position, has_large_groups, neighbours, scan
from ..operators.stats import ROBUST, histogram, robust_rows, robust_wide, row_ranks, slope
from ..session import cut

MAX_GAP_S = 120.0  # fixed value: largest plausible pause
LONG_PAUSE_S = 10.0  # fixed value


def gaps(utterances: DataFrame, chunked: bool, max_gap: float = MAX_GAP_S) -> DataFrame:
    """Plausible time gaps between neighbouring rows.

    ``gap`` is null when either time is missing or the pause is outside ``[0, max_gap]``;
    ``latency`` is the same value on a student row that directly follows a tutor row.
    """
    slim = utterances.select("session_id", "pos", "role", "t_seconds")
    pairs = neighbours(slim, {"prev_role": "role", "prev_t": "t_seconds"}, chunked)
    delta = "t_seconds - prev_t"
    return pairs.selectExpr(
        "*", f"CASE WHEN {delta} BETWEEN 0 AND {num(max_gap)} THEN {delta} END AS gap"
    ).selectExpr(
        "*", "CASE WHEN role = 'student' AND prev_role = 'tutor' THEN gap END AS latency"
    )


def session_timing(
    utterances: DataFrame, chunked: bool | None = None, max_gap: float = MAX_GAP_S
) -> DataFrame:
    chunked = has_large_groups(utterances) if chunked is None else chunked
    measured = gaps(utterances, chunked, max_gap)
    if chunked:
        measured = cut(measured)  # read by the scan and by the histograms
    placed = scan(
        measured,
        by_position(chunked),
        running={"latency_idx": "CASE WHEN latency IS NOT NULL THEN 1L ELSE 0L END"},
        totals={"t_min": ("min", "t_seconds"), "t_max": ("max", "t_seconds")},
    )
    stems = {"gap": "temp_gap", "latency": "temp_student_latency"}
    spread = []
    if not chunked:
        for value, stem in stems.items():
            known = f"{value} IS NOT NULL"
            placed = placed.selectExpr("*", *row_ranks(["session_id"], value, value, known))
            spread += robust_rows(value, value, known, stem)
    span = "(t_max - t_min)"
    edges = ["t_min", f"(t_min + {span} / 3)", f"(t_min + 2 * {span} / 3)", "t_max"]
    third = [f"count_if(t_seconds >= {edges[i]} AND t_seconds < {edges[i + 1]})" for i in range(3)]
    duration = "coalesce(max(t_max) - max(t_min), 0D)"
    long_pauses = f"count_if(gap > {num(LONG_PAUSE_S)})"
    totals = aggregate(
        placed,
        ["session_id"],
        f"{duration} AS temp_duration_s",
        f"{safe_div('count(t_seconds)', 'count(1)')} AS temp_frac_timestamped",
        f"CAST({long_pauses} AS DOUBLE) AS temp_n_long_pauses",
        f"{safe_div(long_pauses, 'count(gap)')} AS temp_long_pause_rate",
        "CAST(count(latency) AS DOUBLE) AS temp_n_student_responses",
        f"{slope('latency', 'latency_idx', 5)[0]} AS temp_student_latency_slope",
        f"{safe_div('count(1)', duration + ' / 60D')} AS temp_utt_per_min",
        *[
            f"CASE WHEN count(t_seconds) > 10 AND {duration} > 0 "
            f"THEN {third[i]} / greatest({' + '.join(third)}, 1) ELSE 0D END AS temp_utt_frac_third{i + 1}"
            for i in range(3)
        ],
        *spread,
    )
    if not chunked:
        return totals
    kinds = measured.selectExpr(
        "session_id", "stack(2, 'gap', gap, 'latency', latency) AS (kind, x)"
    )
    wide = robust_wide(
        histogram(kinds, ["session_id", "kind"], "x"), ["session_id"], "kind", stems, True
    )
    names = [f"{stem}_{s}" for stem in stems.values() for s in ROBUST]
    return totals.join(wide, "session_id", "left").fillna(0.0, subset=names)
