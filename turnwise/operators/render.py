"""Ordered text rendering with a size bound on every output row."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.scalars import evenly_spaced
from ..functions.text import role_tag, stripped
from .ordered import aggregate, by_position, scan
from .retrieval import PAIR
from .windows import span_positions


def budgeted_text(lines: DataFrame, keys: list[str], max_chars: int, chunked: bool) -> DataFrame:
    """Join ``line`` in ``pos`` order with newlines, cut to ``max_chars``.

    Lines that start past the budget are dropped before anything is gathered, so a row
    never holds more than the budget plus one line.
    """
    placed = scan(
        lines.select(*keys, "pos", "line"), by_position(chunked, tuple(keys)),
        running={"offset": "length(line) + 1L"},
    ).where(f"offset < {max_chars}")
    joined = "concat_ws('\\n', transform(array_sort(collect_list(struct(pos, line))), x -> x.line))"
    return aggregate(placed, keys, f"left({joined}, {max_chars}) AS text")


def session_text(utterances: DataFrame, max_chars: int, chunked: bool) -> DataFrame:
    """``role: content`` lines of a session within a character budget."""
    lines = utterances.selectExpr("session_id", "pos", "concat(role, ': ', content) AS line")
    return budgeted_text(lines, ["session_id"], max_chars, chunked)


def role_text(utterances: DataFrame, part_chars: int, chunked: bool) -> DataFrame:
    """Each role's utterances of a session joined in order, as parts of ``part_chars`` characters.

    Every character is kept and no row holds more than one part: ``session_id, role, part, text``.
    """
    keys = ["session_id", "role"]
    placed = scan(
        utterances.selectExpr(*keys, "pos", "content AS line"), by_position(chunked, tuple(keys)),
        running={"offset": "length(line) + 1L"},
    ).selectExpr(
        *keys, "pos", "CASE WHEN offset = 0 THEN line ELSE concat('\\n', line) END AS piece",
        "greatest(offset - 1, 0L) AS at",
    )
    size = f"{part_chars}L"
    cells = placed.selectExpr(
        "*", f"explode(sequence(at div {size}, greatest(at, at + length(piece) - 1) div {size})) AS part")
    pieces = cells.selectExpr(
        *keys, "part", "pos", f"greatest(part * {size} - at, 0L) AS low", f"least((part + 1) * {size} - at, length(piece)) AS high", "piece",
    ).selectExpr(*keys, "part", "pos", "substr(piece, CAST(low + 1 AS INT), CAST(high - low AS INT)) AS piece")
    joined = "concat_ws('', transform(array_sort(collect_list(struct(pos, piece))), x -> x.piece))"
    return aggregate(pieces, [*keys, "part"], f"{joined} AS text")


def tagged_passages(spans: DataFrame, utterances: DataFrame) -> DataFrame:
    """Role-tagged dialogue of each pair's merged spans; blank turns are left out."""
    rows = span_positions(spans, *PAIR).join(
        utterances.select("session_id", "pos", "role", "content"), ["session_id", "pos"]
    )
    blank = f"{stripped('content')} <> ''"
    line = stripped(f"concat({role_tag('role')}, ' ', content)")
    joined = (
        "concat_ws('\\n', transform(filter(array_sort(collect_list(struct(pos, keep, line))), "
        "x -> x.keep), x -> x.line))"
    )
    return aggregate(
        rows.selectExpr(*PAIR, "pos", f"{blank} AS keep", f"{line} AS line"), PAIR,
        f"{joined} AS text",
    )


def bounded_document(
    spans: DataFrame, utterances: DataFrame, pairs: DataFrame,
    max_chars: int = 8000, context_turns: int = 96,
) -> DataFrame:
    """Relevant dialogue first, then evenly spaced lesson context, at most ``max_chars``.

    ``pairs`` carries ``n_rows``.
    """
    lines = utterances.selectExpr(
        "session_id", "pos", "concat('<', lower(role), '> ', content) AS line"
    )
    joined = "concat_ws('\\n', transform(array_sort(collect_list(struct(pos, line))), x -> x.line))"
    local = aggregate(
        span_positions(spans, *PAIR).distinct().join(lines, ["session_id", "pos"]), PAIR,
        f"left(concat('<relevant_dialogue>\\n', {joined}), {max_chars}) AS local",
    )
    spaced = pairs.select("session_id", "n_rows").distinct().selectExpr(
        "session_id", f"explode({evenly_spaced('n_rows', context_turns)}) AS pos"
    )
    context = aggregate(
        spaced.join(lines, ["session_id", "pos"]), ["session_id"],
        f"left(concat('<lesson_context>\\n', {joined}), {max_chars}) AS context",
    )
    room = f"greatest({max_chars} - length(local) - 1, 0)"
    whole = stripped(f"concat(local, '\\n', left(context, {room}))")
    return (
        pairs.select(*PAIR).join(context, "session_id").join(local, PAIR, "left")
        .selectExpr(*PAIR, "coalesce(local, '') AS local", "context")
        .selectExpr(*PAIR, f"CASE WHEN length(local) >= {max_chars} THEN local ELSE {whole} END AS text")
    )


def spaced_chunks(tokens: str, chunk: int, most: int) -> str:
    """Fixed-size slices of a token array, at most ``most`` of them, evenly spaced."""
    count = f"CAST(ceil(size({tokens}) / {chunk}D) AS BIGINT)"
    return (
        f"transform({evenly_spaced(count, most)}, i -> slice({tokens}, CAST(i * {chunk} + 1 AS INT), {chunk}))"
    )
