"""Fold assignment, purging and hold-out splits.

Two ways to keep whole groups in a fold and folds alike.  ``deal`` ranks groups by size and positives
and deals them in a snake: one distributed ranking.  ``greedy`` gives each group, largest first, to the
fold where it leaves the least variance of the folds' totals.  That is a walk, but groups of equal
(rows, positives) meet the same choices, so it walks over classes of equal groups and settles a class
of any size in a few phases; the groups themselves are only ranked within their class.
"""

from __future__ import annotations

from collections.abc import Iterator
from collections.abc import Sequence as Seq

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.scalars import seeded_hash
from ..session import cut
from .ordered import Sequence, aggregate, scan, small_side


def snake(rank: str, k: int) -> str:
    return f"(CASE WHEN ({rank} div {k}) % 2 = 0 THEN {rank} % {k} ELSE {k - 1} - {rank} % {k} END)"


def deal(groups: DataFrame, order: tuple[str, ...], k: int, seed: int, key: str) -> DataFrame:
    """Add ``fold`` to one-row-per-group ``groups``.

    ``order`` holds numeric columns, largest first; ties follow a seeded hash.  The global
    rank is a chunked scan over (order values, hash prefix).
    """
    negated = [f"_n{i}" for i in range(len(order))]
    ready = groups.selectExpr(
        "*", *[f"-CAST({c} AS BIGINT) AS {n}" for c, n in zip(order, negated)],
        f"{seeded_hash(key, seed=seed)} AS _h",
    )
    seq = Sequence((), (*negated, "_h"), (*negated, "substr(_h, 1, 3)"))
    ranked = scan(ready, seq, running={"_rank": "1L"})
    return ranked.selectExpr(*groups.columns, f"{snake('_rank', k)} AS fold")


def phases(costs: list[int], ties: list[int], step: int, weight: int, count: int) -> list[tuple[int, list[int]]]:
    """Who receives ``count`` equal groups: ``(first rank, cycle of folds)``, each cycle repeated until the next.

    A group goes to the fold of least cost (then the least of ``ties``, then the first) and raises them by
    ``step`` and ``weight``.  Folds within one step of the least take turns until they reach the next
    one, so the phases are at most two for each fold, whatever the count.
    """
    out, costs, ties, given = [], list(costs), list(ties), 0
    while given < count:
        least = min(costs)
        turn = sorted((j for j in range(len(costs)) if costs[j] < least + step), key=lambda j: (costs[j], ties[j], j))
        beyond = min((costs[j] for j in range(len(costs)) if j not in turn), default=None)
        rounds = -(-(count - given) // len(turn)) if beyond is None else max(1, (beyond - least) // step)
        out.append((given, turn))
        for j in turn:
            costs[j] += rounds * step
            ties[j] += rounds * weight
        given += rounds * len(turn)
    return out


def _walk(k: int, seeded: bool, total: tuple[int, int]):
    """Phases of classes that arrive in order; ``total``: sums of the two balanced counts."""
    scale = [max(t, k) ** 2 for t in total]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, walked = [[0, 0] for _ in range(k)], [0] * k, 0
        for batch in batches:
            firsts, folds = [], []
            for n, a, b, count in zip(*(batch.column(c).to_pylist() for c in ("n", "a", "b", "n_groups")), strict=True):
                forced = min(count, max(0, k - walked)) if seeded else 0
                plan = [(i, [walked + i]) for i in range(forced)]
                for i in range(forced):
                    held[walked + i] = [held[walked + i][0] + a, held[walked + i][1] + b]
                    rows[walked + i] += n
                weigh = lambda x, y: x * a * scale[1] + y * b * scale[0]  # noqa: E731, B023
                settled = phases([weigh(*h) for h in held], [0] * k if seeded else rows, weigh(a, b), 0 if seeded else n, count - forced)
                for (first, turn), after in zip(settled, [p[0] for p in settled[1:]] + [count - forced]):
                    for i, j in enumerate(turn):
                        got = max(0, after - first - i + len(turn) - 1) // len(turn)
                        held[j] = [held[j][0] + got * a, held[j][1] + got * b]
                        rows[j] += got * n
                plan += [(first + forced, turn) for first, turn in settled]
                walked += count
                firsts.append([p[0] for p in plan])
                folds.append([p[1] for p in plan])
            yield pa.RecordBatch.from_arrays(
                [batch.column("n"), batch.column("n_pos"), pa.array(firsts, pa.list_(pa.int64())), pa.array(folds, pa.list_(pa.list_(pa.int64())))],
                names=["n", "n_pos", "firsts", "turns"])

    return run


def greedy(groups: DataFrame, k: int, seed: int, key: str, stratified: bool) -> DataFrame:
    """Add ``fold`` to one-row-per-group ``groups`` (``key``, ``n`` rows, ``n_pos`` positives).

    Plain: largest groups first, the first ``k`` one to each fold, then the fold where the variance of
    (rows, positives), each over its share of the total, grows least.  ``stratified``: groups that lean
    most to one label first, and (negatives, positives) are balanced; of equal folds the one with fewest
    rows.  Order among equal groups is a seeded hash.  Arithmetic is exact.
    """
    counted = groups.selectExpr(key, "CAST(n AS BIGINT) AS n", "CAST(coalesce(n_pos, 0) AS BIGINT) AS n_pos", f"{seeded_hash(key, seed=seed)} AS _h")
    first = "n - n_pos" if stratified else "n"
    totals = aggregate(counted, [], f"coalesce(sum({first}), 0) AS a", "coalesce(sum(n_pos), 0) AS b").first()
    classes = aggregate(counted, ["n", "n_pos"], "count(1) AS n_groups").selectExpr(
        "n", "n_pos", f"{first} AS a", "n_pos AS b", "n_groups", f"{'abs(n - 2 * n_pos)' if stratified else 'n'} AS _lead")
    ordered = classes.repartition(1).sortWithinPartitions("_lead", "n", "n_pos", ascending=False)
    plan = ordered.drop("_lead").mapInArrow(
        _walk(k, not stratified, (totals["a"], totals["b"])), "n long, n_pos long, firsts array<long>, turns array<array<long>>")
    ranked = scan(counted, Sequence(("n", "n_pos"), ("_h",), ("substr(_h, 1, 3)",)), running={"_rank": "1L"})
    placed = ranked.join(small_side(plan), ["n", "n_pos"]).selectExpr(
        key, "_rank", "size(filter(firsts, f -> f <= _rank)) AS _phase", "firsts", "turns")
    return placed.selectExpr(key, "_rank - element_at(firsts, _phase) AS _at", "element_at(turns, _phase) AS _turn").selectExpr(
        key, "get(_turn, CAST(_at % size(_turn) AS INT)) AS fold")


def greedy_session_folds(responses: DataFrame, k: int = 5, seed: int = 0, group: str = "session_id",
                         label: str = "label") -> DataFrame:
    """Every response with a fold; whole groups, labels stratified greedily."""
    stats = aggregate(responses, [group], "count(1) AS n", f"sum({label}) AS n_pos")
    return responses.join(greedy(stats, k, seed, group, stratified=True), group)


def greedy_objective_folds(responses: DataFrame, k: int = 5, seed: int = 0, group: str = "objective_id",
                           label: str = "label") -> DataFrame:
    """Whole objectives per fold, each to the fold of least variance in rows and positives."""
    stats = aggregate(responses, [group], "count(1) AS n", f"sum({label}) AS n_pos")
    return responses.join(small_side(greedy(stats, k, seed, group, stratified=False)), group)


def session_folds(responses: DataFrame, k: int = 5, seed: int = 0, group: str = "session_id",
                  label: str = "label") -> DataFrame:
    """Every response with a fold; a group never spans folds, positives are balanced."""
    stats = aggregate(responses, [group], "count(1) AS n", f"sum({label}) AS n_pos")
    dealt = deal(stats, ("n_pos", "n"), k, seed, group).select(group, "fold")
    return responses.join(dealt, group)


def objective_folds(responses: DataFrame, k: int = 5, seed: int = 0,
                    group: str = "objective_id", label: str = "label") -> DataFrame:
    """Whole objectives per fold, largest first, rows and positives balanced."""
    stats = aggregate(responses, [group], "count(1) AS n", f"sum({label}) AS n_pos")
    dealt = deal(stats, ("n", "n_pos"), k, seed, group).select(group, "fold")
    return responses.join(small_side(dealt), group)


def objective_scores(responses: DataFrame, seeds: Seq[int], preds: dict[str, str], k: int = 5,
                     group: str = "objective_id", label: str = "label") -> DataFrame:
    """Score counts (``score_counts``) by ``fold_seed, fold, arm, value`` of ``objective_folds`` with every seed.

    A fold holds whole objectives, so responses are counted once by objective, arm (name: expression) and
    score; only these counts and the few objectives are repeated for the seeds.
    """
    arms = ", ".join(f"'{name}', CAST({e} AS DOUBLE)" for name, e in preds.items())
    scored = responses.selectExpr(group, f"CAST({label} AS DOUBLE) AS _y", f"stack({len(preds)}, {arms}) AS (arm, value)")
    sums = ("sum(_y) AS pos", "sum(1D - _y) AS neg", "count(1) AS n", "count(_y) AS n_y")
    counts = cut(aggregate(scored, [group, "arm", "value"], *sums))
    stats = cut(aggregate(responses, [group], "count(1) AS n", f"sum({label}) AS n_pos"))
    dealt = None
    for seed in seeds:
        one = deal(stats, ("n", "n_pos"), k, seed, group).selectExpr(group, f"{seed} AS fold_seed", "fold")
        dealt = one if dealt is None else dealt.unionByName(one)
    placed = counts.join(small_side(dealt), group)
    return cut(aggregate(placed, ["fold_seed", "fold", "arm", "value"], *[f"sum({c}) AS {c}" for c in ("pos", "neg", "n", "n_y")]))


def split_groups(folds: DataFrame, group: str) -> DataFrame:
    """Groups found in more than one fold (empty when the assignment is safe)."""
    seen = aggregate(folds, [group], "min(fold) AS low", "max(fold) AS high")
    return seen.where("low <> high").select(group)


def held_by_fold(folds: DataFrame, group: str, name: str) -> DataFrame:
    """Bit mask of the folds whose validation rows touch the group."""
    return aggregate(folds, [group], f"bit_or(shiftleft(1L, CAST(fold AS INT))) AS {name}")


def purged_training(folds: DataFrame, k: int = 5, group: str = "session_id",
                    objective: str = "objective_id") -> DataFrame:
    """``(response row, train_fold)`` for each fold a row may train.

    A row trains fold f unless its own fold is f or f's validation rows share its session
    or its objective.  The forbidden folds come as two bit masks, so rows are multiplied
    only by the folds they survive in.
    """
    masks = folds.join(held_by_fold(folds, group, "_by_group"), group).join(
        small_side(held_by_fold(folds, objective, "_by_objective")), objective
    )
    mask = "(_by_group | _by_objective | shiftleft(1L, CAST(fold AS INT)))"
    return masks.selectExpr(
        *folds.columns,
        f"explode(filter(sequence(0, {k - 1}), f -> shiftright({mask}, f) & 1L = 0)) AS train_fold",
    )


def fold_summary(folds: DataFrame, group: str = "session_id", objective: str = "objective_id",
                 label: str = "label", purged: DataFrame | None = None) -> DataFrame:
    """Rows, distinct groups and objectives, positive rate and purged-train size per fold."""
    base = aggregate(folds, ["fold"], "count(1) AS n_rows", f"avg({label}) AS pos_rate")
    for column, name in ((group, "n_sessions"), (objective, "n_objectives")):
        distinct = folds.select("fold", column).distinct()
        base = base.join(aggregate(distinct, ["fold"], f"count(1) AS {name}"), "fold")
    if purged is not None:
        left = aggregate(purged, ["train_fold"], "count(1) AS n_train_after_purge")
        base = base.join(left.withColumnRenamed("train_fold", "fold"), "fold", "left").fillna(
            0, subset=["n_train_after_purge"]
        )
    return base


def fold_health(summary: DataFrame, split: DataFrame, unassigned: DataFrame, k: int = 5,
                least_objectives: int = 20, big_catalog: int = 100) -> DataFrame:
    """One row per rule.  ``summary`` is ``fold_summary`` with purging, ``split`` the split groups."""
    broken = aggregate(split, [], "count(1) AS n").scalar()
    loose = aggregate(unassigned, [], "count(1) AS n").scalar()
    facts = aggregate(
        summary, [],
        "count(1) AS folds", "sum(n_objectives) AS objectives", "min(n_objectives) AS fewest",
        "min(n_train_after_purge) AS least_train", "min(n_rows) AS least_rows",
    ).withColumn("broken", broken).withColumn("loose", loose)
    return facts.selectExpr(
        f"stack(5, 'fold_count', folds = {k}, 'all_assigned', loose = 0, 'groups_whole', broken = 0, "
        f"'objectives_per_fold', objectives < {big_catalog} OR fewest >= {least_objectives}, "
        "'non_empty_after_purge', coalesce(least_train, 0) > 0 AND least_rows > 0) AS (rule, passed)"
    )


def hash_ranked(groups: DataFrame, key: str, seed: int) -> DataFrame:
    """Distinct keys with their place ``rank`` in seeded hash order and their number ``n_keys``."""
    keyed = groups.select(key).distinct().selectExpr(key, f"{seeded_hash(key, seed=seed)} AS _h")
    seq = Sequence((), ("_h",), ("substr(_h, 1, 3)",))
    return scan(keyed, seq, running={"rank": "1L"}, totals={"n_keys": ("sum", "1L")}).drop("_h")


def sampled_keys(groups: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """A seeded sample of ``max(1, round(n * fraction))`` distinct keys."""
    ranked = hash_ranked(groups, key, seed)
    return ranked.where(f"rank < greatest(1, bround(n_keys * {fraction}D))").select(key)


def unseen_split(responses: DataFrame, fraction: float = 0.25, seed: int = 0,
                 group: str = "session_id", objective: str = "objective_id") -> DataFrame:
    """Sessions touching a held-out objective validate; ``scored`` marks unseen objectives."""
    held = sampled_keys(responses.where(f"{objective} IS NOT NULL"), objective, fraction, seed)
    touched = responses.join(small_side(held), objective, "left_semi").select(group).distinct()
    sided = responses.join(touched.selectExpr(group, "true AS _v"), group, "left").selectExpr(
        *responses.columns, "coalesce(_v, false) AS validation"
    )
    seen = aggregate(sided, [objective], "bool_or(NOT validation) AS _seen")
    return sided.join(small_side(seen), objective).selectExpr(
        *responses.columns, "CASE WHEN validation THEN 'validation' ELSE 'train' END AS side",
        "validation AND NOT _seen AS scored",
    )


def group_shuffle_split(rows: DataFrame, group: str = "session_id", test: float = 0.2,
                        seed: int = 0) -> DataFrame:
    """Whole groups to test (``ceil(n * test)`` of them) in seeded order, the rest to train."""
    ranked = hash_ranked(rows, group, seed).selectExpr(
        group, f"CASE WHEN rank < ceil(n_keys * {test}D) THEN 'test' ELSE 'train' END AS side"
    )
    return rows.join(ranked, group)
