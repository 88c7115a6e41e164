"""Ordered analytics that stay distributed when one group holds most of the rows.

A plain window over a session sends the whole session to one task.  That is the cheapest
plan while sessions are small (one exchange serves every step keyed on the session), and it
cannot work for a session of billions of rows.  ``has_large_groups`` measures this with a
key-only count, and the operators then follow one of two forms with equal results:

* plain: windows over the group;
* chunked: groups are cut into chunks that are monotone in the group's order.  Work inside
  a chunk is a window over ``(keys, chunk)``; what crosses a chunk boundary (running sums,
  the last row, totals) is reduced to one small row per chunk, accumulated over the chunks
  of a group and joined back on ``(keys, chunk)``.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

CHUNK_ROWS = 65_536
GROUP_ROWS = 1_000_000  # largest group one task may sort
GROUP_BYTES = 256 << 20  # the same in bytes, where rows are wide


@dataclass(frozen=True)
class Sequence:
    """Group keys, a total order inside each group, and how groups are cut.

    ``order`` holds non-null columns, or sort items such as ``x ASC NULLS LAST`` for scans
    that do not look at the preceding row.

    ``chunk`` holds SQL expressions that never decrease along the order.  Empty means each
    group is known to be small (measured, or bounded by construction).
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunk: tuple[str, ...] = ()


def has_large_groups(df: DataFrame, keys: tuple[str, ...] = ("session_id",), limit: int = GROUP_ROWS,
                     size: str | None = None, most_bytes: int = GROUP_BYTES) -> bool:
    """Whether any group exceeds ``limit`` rows, or ``most_bytes`` of ``size`` (bytes of a row, as SQL).

    Reads the key columns and what ``size`` names; rows that carry text or vectors should name it.
    """
    sizes = aggregate(df, keys, "count(1) AS n", f"sum({size or '0L'}) AS b")
    return bool(sizes.where(f"n > {limit} OR b > {most_bytes}").limit(1).count())


def spread(df: DataFrame) -> DataFrame:
    """Use every core on an input that has fewer splits than cores.

    Text work is CPU-bound, and a small file with one row group is one task.  Inputs with
    enough splits are left alone, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


BROADCAST_BYTES = 64 << 20  # largest lookup side that is sent to every executor


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A lookup table, written once, and marked for broadcast only if its rows measure small.

    Bytes are those of the rows as JSON text, which is more than they take in memory.  Beyond the
    limit the hint is left out and Spark shuffles both sides instead.
    """
    from pyspark.sql.functions import broadcast

    from ..session import cut

    kept = cut(df)
    size = kept.selectExpr("coalesce(sum(octet_length(to_json(struct(*)))), 0) AS size").first()["size"]
    return broadcast(kept) if size <= limit else kept


def by_position(chunked: bool, keys: tuple[str, ...] = ("session_id",),
                chunk_rows: int | None = None) -> Sequence:
    """Rows of a group in ``pos`` order, cut every ``chunk_rows`` positions when asked."""
    return Sequence(keys, ("pos",), (f"pos div {chunk_rows or CHUNK_ROWS}",) if chunked else ())


def _over(partition: list[str] | tuple[str, ...], order: str = "", frame: str = "") -> str:
    by = f"PARTITION BY {', '.join(partition)}" if partition else ""
    return f"OVER ({by} {('ORDER BY ' + order) if order else ''} {frame})"


BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def scan(
    df: DataFrame,
    seq: Sequence,
    *,
    prev: Mapping[str, str] | None = None,
    running: Mapping[str, str] | None = None,
    peak: Mapping[str, str] | None = None,
    totals: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Add columns that depend on a row's place in its group.

    ``prev``     value of an expression on the preceding row (null on the first row);
    ``running``  sum of an expression over all preceding rows (0 on the first row);
    ``peak``     largest value of an expression over all preceding rows (null if none);
    ``totals``   ``(aggregate, expression)`` over the whole group: sum, min or max.
    """
    prev, running, totals = dict(prev or {}), dict(running or {}), dict(totals or {})
    peak = dict(peak or {})
    order = ", ".join(seq.order)
    if not seq.chunk:
        rows, before = _over(seq.keys, order), _over(seq.keys, order, BEFORE)
        return df.selectExpr(
            "*",
            *[f"lag({e}) {rows} AS {n}" for n, e in prev.items()],
            *[f"coalesce(sum({e}) {before}, 0) AS {n}" for n, e in running.items()],
            *[f"max({e}) {before} AS {n}" for n, e in peak.items()],
            *[f"{a}({e}) {_over(seq.keys)} AS {n}" for n, (a, e) in totals.items()],
        )

    cells = [f"_cell{i}" for i in range(len(seq.chunk))]
    cut = df.selectExpr("*", *[f"{e} AS {c}" for e, c in zip(seq.chunk, cells)])
    partition = [*seq.keys, *cells]
    parts = [f"sum({e}) AS _r_{n}" for n, e in running.items()]
    parts += [f"max({e}) AS _p_{n}" for n, e in peak.items()]
    parts += [f"{a}({e}) AS _t_{n}" for n, (a, e) in totals.items()]
    if prev:
        last = ", ".join(f"'{n}', {e}" for n, e in prev.items())
        parts.append(f"max_by(named_struct({last}), struct({order})) AS _last")
    summary = _aggregate(cut, partition, parts)
    along = ", ".join(cells)
    carry = summary.selectExpr(
        *partition,
        *[f"coalesce(sum(_r_{n}) {_over(seq.keys, along, BEFORE)}, 0) AS _c_{n}" for n in running],
        *[f"max(_p_{n}) {_over(seq.keys, along, BEFORE)} AS _q_{n}" for n in peak],
        *([f"lag(_last) {_over(seq.keys, along)} AS _before"] if prev else []),
        *[f"{a}(_t_{n}) {_over(seq.keys)} AS {n}" for n, (a, _) in totals.items()],
    )
    rows, before = _over(partition, order), _over(partition, order, BEFORE)
    return cut.join(carry, partition).selectExpr(
        *df.columns,
        *[
            f"CASE WHEN row_number() {rows} = 1 THEN _before.{n} ELSE lag({e}) {rows} END AS {n}"
            for n, e in prev.items()
        ],
        *[f"_c_{n} + coalesce(sum({e}) {before}, 0) AS {n}" for n, e in running.items()],
        *[f"greatest(_q_{n}, max({e}) {before}) AS {n}" for n, e in peak.items()],
        *totals,
    )


def _aggregate(df: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    from pyspark.sql.functions import expr

    return df.groupBy(*keys).agg(*[expr(p) for p in parts])


def aggregate(df: DataFrame, keys: list[str] | tuple[str, ...], *parts: str) -> DataFrame:
    """``groupBy(keys).agg`` with SQL text."""
    return _aggregate(df, list(keys), list(parts))


def neighbours(
    df: DataFrame,
    prev: Mapping[str, str],
    chunked: bool,
    keys: tuple[str, ...] = ("session_id",),
    chunk_rows: int | None = None,
) -> DataFrame:
    """Preceding-row values for a dense 0-based ``pos``.

    In chunked form the last row of every full chunk is also sent to the next chunk, where
    it only serves as the predecessor of that chunk's first row and is then dropped; one
    window and no join.
    """
    if not chunked:
        return scan(df, by_position(False, keys), prev=prev)
    chunk_rows = chunk_rows or CHUNK_ROWS
    here = f"pos div {chunk_rows}"
    cut = df.selectExpr(
        "*",
        f"explode(CASE WHEN (pos + 1) % {chunk_rows} = 0 THEN array({here}, {here} + 1) "
        f"ELSE array({here}) END) AS _cell",
    )
    rows = _over([*keys, "_cell"], "pos")
    return (
        cut.selectExpr("*", *[f"lag({e}) {rows} AS {n}" for n, e in prev.items()])
        .where(f"_cell = {here}")
        .drop("_cell")
    )


def with_positions(
    df: DataFrame,
    order: tuple[str, ...],
    chunked: bool,
    keys: tuple[str, ...] = ("session_id",),
    bucket_width: int | None = None,
    totals: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Dense 0-based ``pos`` and group size ``n_rows``; nulls last.

    In chunked form groups are cut on the leading order column (numeric), where that is null on the
    second one, and where both are null on the texts after them, so a group of any size is numbered
    by many tasks.
    """
    chunk: tuple[str, ...] = ()
    if chunked:
        far, width = 2**62, bucket_width or CHUNK_ROWS
        chunk = (f"coalesce(CAST(floor({order[0]} / {width}) AS BIGINT), {far})",)
        if len(order) > 1 and dict(df.dtypes)[order[1]] in ("double", "float", "bigint", "int"):
            chunk += (f"CASE WHEN {order[0]} IS NULL THEN "
                      f"coalesce(CAST(floor({order[1]} / {width}) AS BIGINT), {far}) ELSE 0L END",)
            chunk += _text_cells(order)
    return scan(
        df,
        Sequence(keys, tuple(f"{c} ASC NULLS LAST" for c in order), chunk),
        running={"pos": "1L"},
        totals={"n_rows": ("sum", "1L"), **(totals or {})},
    )


def _text_cells(order: tuple[str, ...], letters: int = 3) -> tuple[str, ...]:
    """Cells of rows without numbers: the first text's leading letters; where it is null, the texts
    between in full and the last one's leading letters."""
    texts, bare = order[2:], f"{order[0]} IS NULL AND {order[1]} IS NULL"
    if not texts:
        return ()
    first = f"CASE WHEN {texts[0]} IS NULL THEN '2' ELSE concat('1', substr({texts[0]}, 1, {letters})) END"
    cells = [f"CASE WHEN {bare} THEN {first} ELSE '0' END"]
    for i, text in enumerate(texts[1:], 1):
        value = text if i < len(texts) - 1 else f"substr({text}, 1, {letters})"
        cells.append(f"CASE WHEN {bare} AND {texts[0]} IS NULL THEN "
                     f"CASE WHEN {text} IS NULL THEN '2' ELSE concat('1', {value}) END ELSE '0' END")
    return tuple(cells)
