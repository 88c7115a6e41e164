"""Histogram trees by gradient boosting, all runs of a report grown in shared passes.

A run is a set of columns, an assignment of rows to folds and the fold it holds out; runs whose assignments agree on
every row are grown once.  Rows are binned once and packed into blocks, in which rows of equal bins are one cell: a
run's margin depends on the bins only, so a pass looks at rows just to draw and count them, and at cells for the rest.
Each pass sums gradient, Hessian and count by (run, open leaf, feature, bin) inside tasks, adds these tables up by
run and keeps one best split for each open leaf; so a pass costs the same job for one run or for a hundred.  Growth is
by leaves: of all leaves with a known split those of greatest gain go first.  Missing values have a bin of their own
and take the better side.

Driver and task binaries hold trees, borders and at most ``DIRECT_BYTES`` of tables, whatever the number of rows.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from collections.abc import Sequence as Seq
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard
from .ordered import aggregate, spread

#: Partial tables that one merging task takes at once.
MERGED = 64
#: Of the quantile sketch: borders are exact up to some 50,000 rows and off by at most one row in 100,000 beyond.
ACCURACY = 100_000
#: Trees that tasks apply on the fly before the margins of the cells are written anew.
PENDING = 8
#: Most bytes of partial tables that the driver adds up itself; more are added up in tasks.
DIRECT_BYTES = 32 << 20
#: Rows of a block, and blocks that a reader holds at once.
BLOCK_ROWS, GROUP_BLOCKS = 1 << 16, 8
#: Bins and margins of the cells, by feature and by run, and the cell, sides by assignment, draw and label of the rows.
PARTS = {"codes": "u1", "margins": "<f8", "cell": "<i4", "sides": "<i4", "draw": "<i8", "label": "<f8"}
SPLITS = ("run int, leaf int, feature int, border int, missing_left boolean, gain double, n double, g double, h double, "
          "n_left double, g_left double, h_left double, loss double, n_valid double")
Split = namedtuple("Split", [c.split()[0] for c in SPLITS.split(", ")])


@dataclass(frozen=True)
class Run:
    """``columns`` are features of the model; rows of ``held`` under ``assignment`` validate, negative ones take no part."""

    name: str
    assignment: str
    held: int
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Trees:
    """How trees grow and stop.  Without ``patience`` all rounds are kept."""

    rounds: int = 200
    rate: float = 0.1
    leaves: int = 8
    depth: int = 3
    least_rows: int = 20
    ridge: float = 1.0
    bins: int = 32
    patience: int | None = 5
    row_share: float = 0.8
    column_share: float = 1.0
    seed: int = 0


@dataclass
class Node:
    """A leaf, or a split once ``feature`` is set: values up to the border go left."""

    value: float
    feature: int = -1
    border: int = 0
    missing_left: bool = False
    left: int = -1
    right: int = -1
    gain: float = 0.0


@dataclass
class Forest:
    """What boosting has learnt: borders of all features, and base value, trees and kept number of each run."""

    features: tuple[str, ...]
    borders: list[list[float]]
    runs: list[Run]
    base: list[float]
    trees: list[list[list[Node]]] = field(default_factory=list)
    kept: list[int] = field(default_factory=list)
    losses: list[list[float]] = field(default_factory=list)

    def gains(self) -> list[tuple[str, str, float, int]]:
        """(run, feature, gain, splits) of the kept trees."""
        out = []
        for run, trees, n in zip(self.runs, self.trees, self.kept, strict=True):
            for c in run.columns:
                own = [x.gain for t in trees[:n] for x in t if x.feature >= 0 and self.features[x.feature] == c]
                out.append((run.name, c, float(sum(own)), len(own)))
        return out


def borders_of(rows: DataFrame, features: Seq[str], bins: int) -> list[list[float]]:
    """Borders of about equally full bins from a quantile sketch; see ``ACCURACY``."""
    points = ", ".join(f"{i / bins!r}D" for i in range(1, bins))
    row = aggregate(rows, [], *[f"percentile_approx(nullif(CAST({c} AS DOUBLE), double('NaN')), array({points}), {ACCURACY}) AS b{i}"
                                for i, c in enumerate(features)]).first()
    return [sorted(set(row[f"b{i}"] or [])) for i in range(len(features))]


def binned(rows: DataFrame, key: str, features: Seq[str], assignments: Seq[str], borders: list[list[float]], bins: int) -> DataFrame:
    """(key, draw, label, bins, sides): a byte for each feature, a number for each assignment."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = [np.array(b) for b in borders]
        for batch in batches:
            codes = np.empty((batch.num_rows, len(edges)), np.uint8)
            for j, edge in enumerate(edges):
                x = batch.column(3 + j).to_numpy(zero_copy_only=False).astype(float)
                codes[:, j] = np.where(np.isnan(x), bins, np.searchsorted(edge, x, side="left"))
            sides = np.stack([batch.column(3 + len(edges) + j).to_numpy(zero_copy_only=False) for j in range(len(assignments))], axis=1)
            blobs = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (codes, sides.astype("<i4"))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *blobs], names=["key", "draw", "label", "bins", "sides"])

    chosen = rows.selectExpr(f"{key} AS key", f"xxhash64({key}) AS draw", "CAST(label AS DOUBLE) AS label", *[f"CAST({c} AS DOUBLE)" for c in features],
                             *[f"{_side(a)} AS side_{i}" for i, a in enumerate(assignments)])
    return chosen.mapInArrow(run, f"key {kind}, draw long, label double, bins binary, sides binary")


def _side(assignment: str) -> str:
    return f"coalesce(CAST({assignment} AS INT), -1)"


def _matrix(column: pa.Array | pa.ChunkedArray, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def packed(table: DataFrame, base: Seq[float]) -> DataFrame:
    """Labelled rows of ``binned`` as blocks, written once; a column for each of ``PARTS``, as bytes.

    Rows are dealt by ranges of bins, so that equal ones meet, and of draws, so that no task takes all rows of one cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches, BLOCK_ROWS):
            codes, sides = _matrix(rows["bins"], "u1"), _matrix(rows["sides"], "<i4")
            kinds, cell = np.unique(codes.view(f"V{codes.shape[1]}").ravel(), return_inverse=True)
            own = kinds.view("u1").reshape(len(kinds), -1).T, np.repeat(np.array(base, float), len(kinds)), cell, sides.T, *(
                rows[c].to_numpy() for c in ("draw", "label"))
            yield _block([x.astype(kind) for x, kind in zip(own, PARTS.values(), strict=True)])

    known = table.select("draw", "label", "bins", "sides").where("label IS NOT NULL AND NOT isnan(label)")
    dealt = known.repartitionByRange(max(1, table.rdd.getNumPartitions()), "bins", "draw").sortWithinPartitions("bins")
    return _written(dealt.mapInArrow(run, ", ".join(f"{c} binary" for c in PARTS)))


def _written(blocks: DataFrame) -> DataFrame:
    return cut(blocks, **{"parquet.block.row.count.limit": str(GROUP_BLOCKS)})


def _gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Batches put together to ``least`` rows and more."""
    held, size = [], 0
    for batch in batches:
        held, size = [*held, batch], size + batch.num_rows
        if size >= least:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _block(parts: Seq[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=list(PARTS))


def _opened(batch: pa.RecordBatch, features: int) -> Iterator[list[np.ndarray]]:
    """``PARTS`` of each block: features x cells, runs x cells, rows, assignments x rows, rows, rows."""
    for i in range(batch.num_rows):
        codes, margins, cell, sides, draw, label = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in PARTS.items())
        codes = codes.reshape(features, -1)
        yield [codes, margins.reshape(-1, codes.shape[1]), cell, sides.reshape(-1, len(cell)), draw, label]


def _plain(tree: list[Node]) -> np.ndarray:
    """A tree as numbers, which travel lighter than nodes."""
    return np.array([(n.value, n.feature, n.border, n.missing_left, n.left, n.right) for n in tree], float)


class Shape:
    """A tree for routing whole batches: each split is looked up for all rows in one column of codes."""

    def __init__(self, tree: list[Node] | np.ndarray, missing: int):
        self.value, feature, border, missing_left, left, right = (tree if isinstance(tree, np.ndarray) else _plain(tree)).T
        codes = np.arange(256)
        self.goes_left = np.where(codes == missing, missing_left[:, None] > 0, codes <= border[:, None])
        self.nodes = list(zip(feature.astype(int).tolist(), left.astype(int).tolist(), right.astype(int).tolist(), strict=True))

    def leaves(self, columns: np.ndarray) -> np.ndarray:
        """The leaf of every row; ``columns`` are features x rows."""
        def below(i: int) -> np.ndarray:
            feature, left, right = self.nodes[i]
            return np.int32(i) if feature < 0 else np.where(self.goes_left[i].take(columns[feature]), below(left), below(right))

        return np.broadcast_to(below(0), columns.shape[1:])

    def values(self, columns: np.ndarray) -> np.ndarray:
        return self.value.take(self.leaves(columns))


def _drawn(draw: np.ndarray, seed: int, number: int, share: float) -> np.ndarray:
    """Rows that train a tree: a hash of row and tree."""
    x = draw.view(np.uint64) ^ np.uint64((seed * 1_000_003 + number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(11)).astype(float) < share * float(1 << 53)


def split_gains(table: np.ndarray, ridge: float, least_rows: int) -> np.ndarray:
    """Gain of every split (leaf, feature, border, missing right or left); minus infinity where a side is too small.

    ``table`` is (leaf, feature, bin, [g, h, n]); the last bin holds the missing values.
    """
    total = table.sum(axis=2)[:, :, None, None]
    left = np.cumsum(table[:, :, :-1], axis=2)[:, :, :, None]
    left = np.concatenate([left, left + table[:, :, -1][:, :, None, None]], axis=3)
    right = total - left
    worth = lambda x: x[..., 0] ** 2 / (x[..., 1] + ridge)
    gain = (worth(left) + worth(right) - worth(total)) / 2
    return np.where((left[..., 2] >= least_rows) & (right[..., 2] >= least_rows), gain, -np.inf)


Active = dict[int, tuple[list[np.ndarray], list[Node], list[int], tuple[int, ...]]]


def histograms(blocks: DataFrame, forest: Forest, active: Active, number: int, how: Trees, losses: bool) -> DataFrame:
    """(run, part, table): each task's tables.

    ``active`` names for each run its trees not yet in the margins, the growing tree, its open leaves and the columns it may split.
    """
    names, width = list(dict.fromkeys(r.assignment for r in forest.runs)), len(forest.features)
    place = {r: (names.index(forest.runs[r].assignment), forest.runs[r].held) for r in active}
    sent = {r: (pending, _plain(tree), leaves, columns) for r, (pending, tree, leaves, columns) in active.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        part, tables = pyspark.TaskContext.get().partitionId(), {
            r: np.zeros((len(leaves), len(columns), how.bins + 1, 3)) for r, (_, _, leaves, columns) in sent.items()}
        loss = {r: np.zeros(2) for r in sent}
        shapes = {r: ([Shape(t, how.bins) for t in pending], Shape(tree, how.bins)) for r, (pending, tree, _, _) in sent.items()}
        for codes, margins, cell, sides, draw, y in (block for batch in batches for block in _opened(batch, width)):
            sampled, counted = _drawn(draw, how.seed, number, how.row_share), {}
            for r, (_, tree, leaves, columns) in sent.items():
                if place[r] not in counted:
                    side, held = sides[place[r][0]], place[r][1]
                    counted[place[r]] = [_counted(cell, y, (side >= 0) & chosen, codes.shape[1])
                                         for chosen in ((side != held) & sampled, (side == held) if losses else False)]
                (n, positive), (judged, right) = counted[place[r]]
                margin = margins[r]
                for done in shapes[r][0]:
                    margin = margin + how.rate * done.values(codes)
                p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
                if losses:
                    q = np.clip(p, 1e-15, 1 - 1e-15)
                    loss[r] += [-(right * np.log(q) + (judged - right) * np.log1p(-q)).sum(), judged.sum()]
                leaf = np.full(len(tree), -1)
                leaf[leaves] = np.arange(len(leaves))
                leaf = leaf[shapes[r][1].leaves(codes)]
                own = np.flatnonzero((n > 0) & (leaf >= 0))
                p, n, at = p[own], n[own], leaf[own] * (how.bins + 1)
                sums = n * p - positive[own], n * p * (1 - p), n
                for j, column in enumerate(columns):
                    code = at + codes[column][own]
                    for k, w in enumerate(sums):
                        tables[r][:, j, :, k] += np.bincount(code, w, len(leaves) * (how.bins + 1)).reshape(len(leaves), -1)
        yield pa.RecordBatch.from_arrays([
            pa.array(list(sent), pa.int32()), pa.array([part] * len(sent), pa.int32()),
            pa.array([loss[r].tobytes() + tables[r].tobytes() for r in sent], pa.binary())], names=["run", "part", "table"])

    return blocks.select(*PARTS).mapInArrow(run, "run int, part int, table binary")


def _counted(cell: np.ndarray, label: np.ndarray, chosen: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and sum of labels of the chosen rows of each cell."""
    own = np.flatnonzero(chosen)
    return np.bincount(cell[own], minlength=cells).astype(float), np.bincount(cell[own], label[own], cells)


def _merged(parts: DataFrame, n: int) -> DataFrame:
    """Sums of partial tables, in order of their parts, at most ``MERGED`` at once."""

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("part").to_numpy(), kind="stable")
        blobs = table.column("table").to_pylist()
        total = np.zeros(len(blobs[0]) // 8)
        for i in order:
            total += np.frombuffer(blobs[i], "<f8")
        return pa.table({"run": table.column("run").slice(0, 1), "part": pa.array([int(table.column("part")[0].as_py()) // MERGED], pa.int32()),
                         "table": pa.array([total.tobytes()], pa.binary())})

    while n > MERGED:
        parts, n = parts.groupBy("run", F.expr(f"part div {MERGED}")).applyInArrow(lambda _, t: add(t), "run int, part int, table binary"), -(-n // MERGED)
    return parts.groupBy("run").applyInArrow(add, "run int, part int, table binary")


def _best(r: int, blob: bytes, leaves: list[int], columns: tuple[int, ...], how: Trees) -> Iterator[Split]:
    """The best split of every open leaf; of equal ones the first feature, border and missing side."""
    values = np.frombuffer(blob, "<f8")
    table = values[2:].reshape(len(leaves), len(columns), how.bins + 1, 3)
    gains = split_gains(table, how.ridge, how.least_rows).reshape(len(leaves), -1)
    for i, leaf in enumerate(leaves):
        f, b, m = np.unravel_index(int(np.argmax(gains[i])), (len(columns), how.bins, 2))
        g, h, n = table[i, f].sum(axis=0)
        left = table[i, f, :b + 1].sum(axis=0) + m * table[i, f, -1]
        yield Split(r, leaf, columns[f], int(b), bool(m), float(gains[i].max()), n, g, h, left[2], left[0], left[1], *values[:2])


def best_splits(parts: DataFrame, shapes: dict[int, tuple[list[int], tuple[int, ...]]], how: Trees, tasks: int) -> list[Split]:
    """The best splits of the summed tables of ``tasks`` tasks."""
    size = 8 * sum(2 + 3 * len(leaves) * len(columns) * (how.bins + 1) for leaves, columns in shapes.values())
    if tasks * size <= DIRECT_BYTES:
        found, total = parts.toArrow().sort_by("part"), {}
        for r, blob in zip(found.column("run").to_pylist(), found.column("table").to_pylist(), strict=True):
            total[r] = total.get(r, 0.0) + np.frombuffer(blob, "<f8")
        return [s for r in sorted(total) for s in _best(r, total[r].tobytes(), *shapes[r], how)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [s for r, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True) for s in _best(r, blob, *shapes[r], how)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=list(names))

    names, kinds = zip(*((n, {"int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}[t])
                         for n, t in (p.split() for p in SPLITS.split(", "))), strict=True)
    return _merged(parts, tasks).mapInArrow(run, SPLITS).collect()


def alike(rows: DataFrame, runs: Seq[Run]) -> tuple[list[Run], list[int]]:
    """The runs that differ, and the place of each run among them; assignments equal on every row are one."""
    names = list(dict.fromkeys(r.assignment for r in runs))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[:i]]
    equal = aggregate(rows, [], "count(1) AS n", *[f"coalesce(bool_and({_side(a)} = {_side(b)}), true) AS e{i}" for i, (a, b) in enumerate(pairs)]).first()
    first = {a: a for a in names}
    for i, (a, b) in reversed(list(enumerate(pairs))):  # the earliest last
        if equal[f"e{i}"]:
            first[a] = b
    known: dict[tuple, int] = {}
    place = [known.setdefault((first[r.assignment], r.held, tuple(sorted(set(r.columns)))), len(known)) for r in runs]
    own = [runs[place.index(k)] for k in range(len(known))]
    return [replace(r, assignment=first[r.assignment]) for r in own], place


def prepared(rows: DataFrame, key: str, runs: Seq[Run], how: Trees) -> tuple[DataFrame, Forest, list[int]]:
    """Binned rows, written once, the forest of the runs that differ, without trees, and the place of each run among them.

    Each run starts at the log odds of its training rows.
    """
    features = tuple(dict.fromkeys(c for r in runs for c in r.columns))
    runs, place = alike(rows, runs)
    names = list(dict.fromkeys(r.assignment for r in runs))
    inside = [f"label IS NOT NULL AND {r.assignment} >= 0 AND {r.assignment} <> {r.held}" for r in runs]
    rates = aggregate(rows, [], *[f"avg(CASE WHEN {w} THEN CAST(label AS DOUBLE) END) AS r{i}" for i, w in enumerate(inside)]).first()
    rate = [min(max(0.5 if rates[f"r{i}"] is None else rates[f"r{i}"], 1e-6), 1 - 1e-6) for i in range(len(runs))]
    borders = borders_of(rows, features, how.bins)
    forest = Forest(features, borders, list(runs), [float(np.log(p / (1 - p))) for p in rate], [[] for _ in runs], [0] * len(runs), [[] for _ in runs])
    return cut(binned(spread(rows), key, features, names, borders, how.bins)), forest, place


def boost(rows: DataFrame, key: str, runs: Seq[Run], how: Trees = Trees()) -> tuple[DataFrame, Forest]:
    """Held-out predictions (run, key, label, pred) of all runs, and the trees.

    A run stops once its held-out loss has not fallen for ``patience`` trees and keeps those up to the least loss.  Rows
    without a label are predicted, but neither train nor judge.
    """
    table, forest, same = prepared(rows, key, runs, how)
    blocks = packed(table, forest.base)
    tasks = blocks.rdd.getNumPartitions()
    pending: list[list[np.ndarray]] = [[] for _ in forest.runs]
    growing, place = set(range(len(forest.runs))), {c: i for i, c in enumerate(forest.features)}
    for number in range(how.rounds + 1):
        trees = {r: [Node(0.0)] for r in growing}
        known: dict[int, dict[int, tuple]] = {r: {} for r in growing}
        fresh, columns = {r: [0] for r in growing}, {r: _columns(place, forest.runs[r], how, number) for r in growing}
        for level in range(how.depth):
            active = {r: (pending[r], trees[r], leaves, columns[r]) for r, leaves in fresh.items() if leaves and r in growing}
            if not active:
                break
            parts = histograms(blocks, forest, active, number, how, level == 0)
            for row in best_splits(parts, {r: (a[2], a[3]) for r, a in active.items()}, how, tasks):
                known[row.run][row.leaf] = row
                if level == 0:
                    forest.losses[row.run].append(row.loss / row.n_valid if row.n_valid else 0.0)
            if level == 0:
                growing = {r for r in growing if _goes_on(forest, r, number, how)}
            fresh = {r: _grow(trees[r], known[r], how) for r in active if r in growing}
        if not growing:
            break
        for r in growing:
            forest.trees[r].append(trees[r])
            pending[r].append(_plain(trees[r]))
        if max(map(len, pending)) >= PENDING:
            before, blocks = blocks, _written(_moved(blocks, pending, len(forest.features), how))
            discard(before)
            tasks = blocks.rdd.getNumPartitions()
            pending = [[] for _ in forest.runs]
    discard(blocks)
    out = cut(_predicted(table, key, forest, how, [[r.name for r, k in zip(runs, same, strict=True) if k == i] for i in range(len(forest.runs))]))
    discard(table)
    return out, replace(forest, runs=list(runs), **{c: [getattr(forest, c)[k] for k in same] for c in ("base", "trees", "kept", "losses")})


def _columns(place: dict[str, int], run: Run, how: Trees, number: int) -> tuple[int, ...]:
    """Columns that a tree may split: all, or a seeded share."""
    own = sorted(place[c] for c in run.columns)
    n = max(1, round(how.column_share * len(own)))
    return tuple(own if n == len(own) else sorted(np.random.default_rng([how.seed, number]).choice(own, n, replace=False).tolist()))


def _goes_on(forest: Forest, r: int, number: int, how: Trees) -> bool:
    """Whether another tree is grown; the last one had no split if it is a single leaf."""
    losses = forest.losses[r]
    best = int(np.argmin(losses)) if how.patience is not None else number
    forest.kept[r] = best
    stuck = bool(forest.trees[r]) and len(forest.trees[r][-1]) == 1 and how.row_share >= 1 and how.column_share >= 1
    return number < how.rounds and not stuck and (how.patience is None or number - best < how.patience)


def _grow(tree: list[Node], known: dict[int, tuple], how: Trees) -> list[int]:
    """Split the leaves of greatest gain, as many as may be; the new leaves."""
    room = how.leaves - sum(n.feature < 0 for n in tree)
    fresh = []
    for leaf in sorted((x for x in known if known[x].gain > 1e-12), key=lambda x: (-known[x].gain, x))[:max(room, 0)]:
        s = known.pop(leaf)
        node = tree[leaf]
        node.feature, node.border, node.missing_left, node.gain = s.feature, s.border, s.missing_left, s.gain
        node.left, node.right = len(tree), len(tree) + 1
        tree += [Node(-s.g_left / (s.h_left + how.ridge)), Node(-(s.g - s.g_left) / (s.h - s.h_left + how.ridge))]
        fresh += [node.left, node.right]
    return fresh


def _moved(blocks: DataFrame, pending: list[list[np.ndarray]], features: int, how: Trees) -> DataFrame:
    """Blocks with the pending trees in their margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = [[Shape(t, how.bins) for t in trees] for trees in pending]
        for codes, margins, *rest in (block for batch in batches for block in _opened(batch, features)):
            margins = margins.copy()
            for r, trees in enumerate(shapes):
                for tree in trees:
                    margins[r] += how.rate * tree.values(codes)
            yield _block([codes, margins, *rest])

    return blocks.select(*PARTS).mapInArrow(run, blocks.schema)


def _predicted(table: DataFrame, key: str, forest: Forest, how: Trees, called: list[list[str]]) -> DataFrame:
    """Rows that a run holds out under its trees; ``called`` are the names of all runs alike."""
    names = list(dict.fromkeys(r.assignment for r in forest.runs))
    runs, base = [(own, names.index(r.assignment), r.held) for r, own in zip(forest.runs, called, strict=True)], forest.base
    kept = [[_plain(t) for t in trees[:n]] for trees, n in zip(forest.trees, forest.kept, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = [[Shape(t, how.bins) for t in trees] for trees in kept]
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, sides = _matrix(batch.column(2), "u1"), _matrix(batch.column(3), "<i4")
            for (own, at, held), start, trees in zip(runs, base, shapes, strict=True):
                mine = np.flatnonzero(sides[:, at] == held)
                margin, cells = np.full(len(mine), start), np.ascontiguousarray(codes[mine].T)
                for tree in trees:
                    margin += how.rate * tree.values(cells)
                columns = *(batch.column(k).take(pa.array(mine)) for k in (0, 1)), pa.array(1 / (1 + np.exp(-margin)))
                for name in own:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(mine), pa.string()), *columns], names=["run", key, "label", "pred"])

    return table.select("key", "label", "bins", "sides").mapInArrow(run, f"run string, {key} {dict(table.dtypes)['key']}, label double, pred double")


def root_gains(rows: DataFrame, key: str, runs: Seq[Run], how: Trees) -> DataFrame:
    """Every split that the first tree of each run may begin with: run, feature, border, missing_left, n_left, gain."""
    table, forest, same = prepared(rows, key, runs, how)
    blocks = packed(table, forest.base)
    place = {c: i for i, c in enumerate(forest.features)}
    columns = {r: _columns(place, run, how, 0) for r, run in enumerate(forest.runs)}
    parts = histograms(blocks, forest, {r: ([], [Node(0.0)], [0], columns[r]) for r in columns}, 0, how, losses=False)
    tables = _merged(parts, blocks.rdd.getNumPartitions())
    names, features, borders = [r.name for r in runs], forest.features, forest.borders

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                sums = np.frombuffer(blob, "<f8")[2:].reshape(1, len(columns[r]), how.bins + 1, 3)
                gains, n = split_gains(sums, how.ridge, how.least_rows)[0], np.cumsum(sums[0, :, :-1, 2], axis=1)
                found = [(features[columns[r][f]], borders[columns[r][f]][b], bool(m), int(n[f, b] + m * sums[0, f, -1, 2]), gains[f, b, m])
                         for f, b, m in zip(*np.nonzero(np.isfinite(gains)), strict=True) if b < len(borders[columns[r][f]])]
                out += [(name, *s) for name, k in zip(names, same, strict=True) if k == r for s in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)],
                                                 names=["run", "feature", "border", "missing_left", "n_left", "gain"])

    return cut(tables.mapInArrow(run, "run string, feature string, border double, missing_left boolean, n_left long, gain double"))
