"""Sliding passages over a session, counted in rows, and the spans picked from them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .ordered import aggregate

SIZE, STRIDE, TOP_K = 20, 10, 3  # fixed values: passage length, step and passages kept


def regular_count(n: str, size: int, stride: int) -> str:
    """Passages on the stride grid; a session not longer than a passage has one."""
    return f"(CASE WHEN {n} <= {size} THEN 1L ELSE ({n} - {size}) div {stride} + 1 END)"


def has_tail(n: str, size: int, stride: int) -> str:
    """Whether rows after the last grid passage need an extra passage at the very end."""
    return f"({n} > {size} AND ({n} - {size}) % {stride} <> 0)"


def window_count(n: str, size: int = SIZE, stride: int = STRIDE) -> str:
    return f"({regular_count(n, size, stride)} + CASE WHEN {has_tail(n, size, stride)} THEN 1L ELSE 0L END)"


def window_start(idx: str, n: str, size: int = SIZE, stride: int = STRIDE) -> str:
    return (
        f"(CASE WHEN {n} <= {size} THEN 0L WHEN {idx} >= {regular_count(n, size, stride)} "
        f"THEN {n} - {size} ELSE {idx} * {stride} END)"
    )


def window_end(idx: str, n: str, size: int = SIZE, stride: int = STRIDE) -> str:
    return f"least({window_start(idx, n, size, stride)} + {size}, {n})"


def windows_holding(low: str, high: str, n: str, size: int = SIZE, stride: int = STRIDE) -> str:
    """Array of the passages that contain every position from ``low`` to ``high``.

    It follows from the positions and the session length alone, so membership is computed
    row by row: at most ``ceil(size / stride) + 1`` entries, whatever the session's length.
    """
    empty = "cast(array() AS array<bigint>)"
    first = f"greatest(({high} - {size} + {stride}) div {stride}, 0L)"
    last = f"least({low} div {stride}, {regular_count(n, size, stride)} - 1)"
    grid = f"CASE WHEN {last} >= {first} THEN sequence({first}, {last}) ELSE {empty} END"
    tail = (
        f"CASE WHEN {has_tail(n, size, stride)} AND {low} >= {n} - {size} "
        f"THEN array({regular_count(n, size, stride)}) ELSE {empty} END"
    )
    return f"(CASE WHEN {n} <= {size} THEN array(0L) ELSE concat({grid}, {tail}) END)"


def window_members(utterances: DataFrame, size: int = SIZE, stride: int = STRIDE) -> DataFrame:
    """Every utterance once per passage that contains it."""
    inside = windows_holding("pos", "pos", "n_rows", size, stride)
    return utterances.selectExpr("*", f"explode({inside}) AS window_idx").selectExpr(
        "*",
        f"{window_start('window_idx', 'n_rows', size, stride)} AS w_start",
        f"{window_end('window_idx', 'n_rows', size, stride)} AS w_end",
    )


def joined_text(keys: list[str], separator: str, *carried: str) -> list[str]:
    """Aggregates joining ``content`` in ``pos`` order for groups of bounded size."""
    ordered = "transform(array_sort(collect_list(struct(pos, content))), x -> x.content)"
    return [f"concat_ws('{separator}', {ordered}) AS content", *[f"max({c}) AS {c}" for c in carried]]


def window_texts(utterances: DataFrame, size: int = SIZE, stride: int = STRIDE) -> DataFrame:
    """``session_id, window_idx, w_start, w_end, n_rows, content``; at most ``size`` rows each."""
    members = window_members(
        utterances.select("session_id", "pos", "n_rows", "content"), size, stride
    )
    return aggregate(
        members, ["session_id", "window_idx"],
        *joined_text(["session_id", "window_idx"], " ", "w_start", "w_end", "n_rows"),
    )


def merge_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Merge spans of a key that overlap or touch (start <= previous end).

    A key holds at most the ``k`` spans that were picked for it.
    """
    by = f"PARTITION BY {', '.join(keys)} ORDER BY w_start, w_end"
    reach = f"max(w_end) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    marked = spans.selectExpr(
        *keys, "n_rows", "w_start", "w_end", f"CASE WHEN w_start <= {reach} THEN 0 ELSE 1 END AS opens"
    ).selectExpr("*", f"sum(opens) OVER ({by} ROWS UNBOUNDED PRECEDING) AS span")
    return aggregate(
        marked, [*keys, "span"],
        "min(w_start) AS w_start", "max(w_end) AS w_end", "max(n_rows) AS n_rows",
    )


def span_positions(spans: DataFrame, *keep: str) -> DataFrame:
    """One row per position inside ``[w_start, w_end)``; spans are short."""
    return spans.selectExpr(*keep, "explode(sequence(w_start, w_end - 1)) AS pos")
