"""How a session's time is divided between its objectives (12 columns, prefix ``lopos_``)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.scalars import safe_div
from ..operators.ordered import CHUNK_ROWS, Sequence, aggregate, scan
from ..operators.retrieval import PAIR
from ..session import cut

POSITION_COLUMNS = (
    "n_competing_los", "start_pos", "end_pos", "centre_pos", "utt_share", "ordinal",
    "ordinal_frac", "overlap_with_others", "duration_s", "minute_share",
    "gap_to_session_end_s", "gap_to_session_end_utt",
)


def overlap_area(spans: DataFrame, weights: DataFrame, chunked: bool) -> DataFrame:
    """Rows of each pair's spans counted once per response whose spans cover them.

    A sweep over span borders: with D the number of open spans, the covered area up to a
    border x is ``x * sum(delta) - sum(delta * x_i)`` over the borders before it.  Ties add
    nothing, so no pairs of spans are ever formed.
    """
    borders = spans.join(weights, PAIR).selectExpr(
        *PAIR, "span", "stack(2, w_start, m, -1L, w_end, -m, 1L) AS (x, delta, side)"
    )
    seq = Sequence(
        ("session_id",), ("x", "objective_id", "span", "side"),
        (f"x div {CHUNK_ROWS}",) if chunked else (),
    )
    swept = scan(borders, seq, running={"d": "delta", "dx": "delta * x"})
    return aggregate(swept, PAIR, "sum(side * (x * d - dx)) AS area")


def ordinals(centres: DataFrame, chunked: bool) -> DataFrame:
    """Responses of the session whose span centre lies strictly before this pair's."""
    hist = aggregate(centres, ["session_id", "centre"], "sum(m) AS cnt")
    seq = Sequence(("session_id",), ("centre",),
                   (f"floor(centre / {CHUNK_ROWS})",) if chunked else ())
    ranked = scan(hist, seq, running={"ordinal": "cnt"}, totals={"n_placed": ("sum", "cnt")})
    return centres.join(ranked.drop("cnt"), ["session_id", "centre"])


def objective_positions(
    responses: DataFrame, spans: DataFrame, utterances: DataFrame, chunked: bool = False
) -> DataFrame:
    """One row per ``(session_id, objective_id)`` of ``responses``.

    ``utterances`` needs ``session_id, pos, n_rows, t_seconds``.  A pair without spans gets
    the neutral values.
    """
    spans = cut(spans)  # a few rows per pair, read by the extent and by the sweep
    weights = aggregate(responses, PAIR, "count(1) AS m")
    competing = aggregate(responses, ["session_id"], "count(1) AS n_competing_los")
    extent = aggregate(
        spans, PAIR,
        "min(w_start) AS s", "max(w_end) AS e", "sum(w_end - w_start) AS covered",
        "greatest(max(n_rows), 1) AS n",
    ).join(weights, PAIR).selectExpr("*", "(s + e) / 2D AS centre")
    placed = ordinals(extent, chunked).join(overlap_area(spans, weights, chunked), PAIR)

    times = utterances.select("session_id", "pos", "t_seconds")
    clock = aggregate(
        times, ["session_id"], "min(t_seconds) AS t_min", "max(t_seconds) AS t_max"
    )
    at = lambda name, where: times.selectExpr(
        "session_id", f"pos AS {where}", f"t_seconds AS {name}")
    timed = (
        placed.selectExpr("*", "e - 1 AS last")
        .join(at("t_s", "s"), ["session_id", "s"], "left")
        .join(at("t_e", "last"), ["session_id", "last"], "left")
        .join(clock, "session_id", "left")
        .selectExpr("*", "coalesce(t_s, t_min) AS from_t", "coalesce(t_e, t_max) AS to_t")
    )
    lasting = "coalesce(greatest(to_t - from_t, 0D), 0D)"
    values = timed.selectExpr(
        *PAIR,
        "s / n AS start_pos", "e / n AS end_pos", "centre / n AS centre_pos",
        f"{safe_div('covered', 'n')} AS utt_share",
        "CAST(ordinal AS DOUBLE) AS ordinal",
        f"{safe_div('ordinal', 'greatest(n_placed - 1, 1)')} AS ordinal_frac",
        f"{safe_div('area - covered', 'greatest(covered, 1)')} AS overlap_with_others",
        f"{lasting} AS duration_s",
        f"coalesce({lasting} / greatest(t_max - t_min, 1D), 0D) AS minute_share",
        "coalesce(greatest(t_max - to_t, 0D), 0D) AS gap_to_session_end_s",
        f"{safe_div('n - e', 'n')} AS gap_to_session_end_utt",
    )
    half = ("start_pos", "end_pos", "centre_pos")
    rest = [c for c in POSITION_COLUMNS if c not in (*half, "n_competing_los")]
    return (
        weights.join(competing, "session_id").join(values, PAIR, "left")
        .selectExpr(
            *PAIR, "CAST(n_competing_los AS DOUBLE) AS lopos_n_competing_los",
            *[f"coalesce({c}, 0.5D) AS lopos_{c}" for c in half],
            *[f"coalesce({c}, 0D) AS lopos_{c}" for c in rest],
        )
    )
