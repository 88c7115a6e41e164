from __future__ import annotations

import random

import numpy as np
import pytest

from turnwise.operators.ordered import (
    Sequence, has_large_groups, neighbours, scan, small_side, spread, with_positions,
)
from turnwise.operators.stats import (
    auc, balanced, describe, gini, histogram, robust_rows, robust_stats, row_ranks, slope,
)
from turnwise.operators.ordered import aggregate


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(k, p, rng.choice("abc"), rng.randint(0, 5)) for k, n in (("x", 1), ("y", 9), ("z", 17)) for p in range(n)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, pos bigint, role string, v bigint")


def test_scan_chunked_equals_plain(rows):
    args = dict(
        prev={"before": "role", "prev_v": "v"}, running={"so_far": "v"}, peak={"top": "CASE WHEN v > 3 THEN pos END"},
        totals={"total": ("sum", "v"), "low": ("min", "v"), "n": ("sum", "1L")},
    )
    plain = scan(rows, Sequence(("k",), ("pos",)), **args)
    cut = scan(rows, Sequence(("k",), ("pos",), ("pos div 4",)), **args)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, cut.collect()), key=str)


@pytest.mark.parametrize("chunk", [1, 2, 5, 100])
def test_neighbours_halo(rows, chunk):
    plain = neighbours(rows, {"b": "role"}, False, ("k",))
    cut = neighbours(rows, {"b": "role"}, True, ("k",), chunk)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, cut.collect()), key=str)


@pytest.mark.parametrize("chunked", [False, True])
def test_positions_nulls_last_and_dense(spark, chunked):
    data = [("s", 3.0, None, "c"), ("s", None, 9.0, "e"), ("s", 1.0, 5.0, "a"), ("s", None, 2.0, "d"),
            ("s", None, None, "f"), ("s", 1.0, None, "b"), ("t", 70.0, 1.0, "z")]
    df = spark.createDataFrame(data, "session_id string, utterance_idx double, t_seconds double, utterance_id string")
    out = with_positions(df, ("utterance_idx", "t_seconds", "utterance_id"), chunked, bucket_width=2)
    got = {(r.session_id, r.pos): (r.utterance_id, r.n_rows) for r in out.collect()}
    assert [got[("s", i)][0] for i in range(6)] == ["a", "b", "c", "d", "e", "f"]
    assert got[("t", 0)] == ("z", 1) and got[("s", 0)][1] == 6


def test_large_group_probe(rows):
    assert has_large_groups(rows, ("k",), limit=16)
    assert not has_large_groups(rows, ("k",), limit=17)


def test_spread_only_when_needed(spark):
    many = spark.range(100, numPartitions=9)
    assert spread(many).rdd.getNumPartitions() == 9
    assert spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == 4


def test_broadcast_needs_measured_bytes(spark):
    df = spark.range(50)  # {"id":7} is 8 bytes, {"id":17} is 9
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(small_side(df, 440)) and not hinted(small_side(df, 439))


VALUES = {"a": [5.0], "b": [1.0, 2.0], "c": [3.0] * 7, "d": [float(x % 13) * 1.5 for x in range(60)],
          "e": [0.1 * x * x for x in range(31)]}


def expected_robust(x):
    x = np.asarray(x)
    lo, hi = np.percentile(x, [10, 90])
    kept = x[(x >= lo) & (x <= hi)]
    return (np.median(x), kept.mean() if kept.size else np.median(x),
            np.percentile(x, 75) - np.percentile(x, 25), np.percentile(x, 90))


@pytest.mark.parametrize("form", ["hist", "chunked", "rows"])
def test_robust_statistics(spark, form):
    df = spark.createDataFrame([(k, v) for k, vs in VALUES.items() for v in vs], "k string, v double")
    if form == "rows":
        ranked = df.selectExpr("*", *row_ranks(["k"], "v", "t", "true"))
        out = aggregate(ranked, ["k"], *robust_rows("v", "t", "true", "x")).toDF("k", "median", "trimmean", "iqr", "p90")
    else:
        out = robust_stats(histogram(df, ["k"], "v"), ["k"], form == "chunked", cells=5)
    for r in out.collect():
        assert np.allclose([r.median, r.trimmean, r.iqr, r.p90], expected_robust(VALUES[r.k])), r


def test_describe_ignores_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (4.0,), (10.0,)], "v double")
    r = describe(df, [], "v", cells=4).first()
    assert r.n == 3 and np.isclose(r.std, np.std([1, 4, 10])) and np.isclose(r.p25, np.percentile([1, 4, 10], 25))


@pytest.mark.parametrize("y", [[1, 2], [2, 2, 2, 2, 2], [1, 5, 2, 8, 3, 9], [4, 1, 0]])
def test_slope_and_fit(spark, y):
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(y)], "y double, i bigint")
    steep, fit = slope("y", "i", 3)
    r = df.selectExpr(f"{steep} AS s", f"{fit} AS r").first()
    if len(y) < 3:
        assert (r.s, r.r) == (0.0, 0.0)
        return
    x, y = np.linspace(0, 1, len(y)), np.asarray(y, float)
    s = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
    total = ((y - y.mean()) ** 2).sum()
    res = ((y - y.mean() - s * (x - x.mean())) ** 2).sum()
    assert np.isclose(r.s, s) and np.isclose(r.r, 1 - res / total if total else 0.0)


@pytest.mark.parametrize("chunked", [False, True])
def test_gini_counts_absent_zeros(spark, chunked):
    full = {"a": [0, 0, 0.2, 0.2, 0.9], "b": [0.5], "c": [0.3, 0.3]}
    hist = spark.createDataFrame(
        [(k, v, sum(1 for w in vs if w == v), len(vs)) for k, vs in full.items() for v in set(vs) if v > 0],
        "k string, value double, cnt bigint, size bigint")
    got = {r.k: r.gini for r in gini(hist, ["k"], "size", chunked).collect()}
    for k, vs in full.items():
        xs, n = np.sort(vs), len(vs)
        want = 0.0 if n < 2 else 2 * (np.arange(1, n + 1) * xs).sum() / (n * xs.sum()) - (n + 1) / n
        assert np.isclose(got[k], want)


def test_auc_ties_and_single_class(spark, monkeypatch):
    rng = random.Random(3)
    data = [("m", float(rng.random() < 0.4), round(rng.random(), 1)) for _ in range(200)]
    data += [("tied", float(i % 2), 0.5) for i in range(10)] + [("one", 1.0, 0.2), ("one", 1.0, 0.7)]
    df = spark.createDataFrame(data, "k string, y double, p double")
    got = {r.k: r.auc for r in auc(df, ["k"], "y", "p").collect()}
    monkeypatch.setattr("turnwise.operators.stats.GROUP_ROWS", 3)
    assert got == {r.k: r.auc for r in auc(df, ["k"], "y", "p", cells=4).collect()}
    pos = [p for k, y, p in data if k == "m" and y]
    neg = [p for k, y, p in data if k == "m" and not y]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert np.isclose(got["m"], want) and got["tied"] == 0.5 and got["one"] is None


def test_packed_values_spread_over_cells(spark, monkeypatch):
    """Scores within one thousandth of each other still fill many cells, evenly."""
    df = spark.range(5000).selectExpr("0.5D + id * 1e-8 AS value", "id % 2 AS y", "1L AS cnt")
    sizes = [r["count"] for r in balanced(df, 50).groupBy("_cell").count().collect()]
    assert len(sizes) == 50 and max(sizes) < 3 * 5000 / 50
    monkeypatch.setattr("turnwise.operators.stats.GROUP_ROWS", 100)
    got = auc(df.withColumn("p", df.value), [], "y", "p").first().auc
    assert np.isclose(got, (2500 * 2501 / 2) / 2500**2)


def test_large_groups_by_bytes(spark):
    df = spark.createDataFrame([("a", "x" * 100)] * 3 + [("b", "y")], "session_id string, text string")
    size = "octet_length(text)"
    assert has_large_groups(df, size=size, most_bytes=299) and not has_large_groups(df, size=size, most_bytes=300)
    assert not has_large_groups(df)


def test_rows_without_numbers_are_numbered_in_many_cells(spark):
    rng = random.Random(9)
    texts = ["", "ab", "abc1", "abc0", "zz", "é", "b" * 9, None]
    data = [(s, None, None if s == "n" else rng.choice([None, 1.0, 2.0]), None if s == "n" else rng.choice(texts), rng.choice(["t", "s"]),
             rng.choice(texts) or "") for s in ("m", "n") for _ in range(200)]
    df = spark.createDataFrame(data, "session_id string, a double, b double, c string, role string, content string")
    order = ("a", "b", "c", "role", "content")
    got = [{tuple(r[k] for k in ("session_id", "pos")): tuple(r[k] for k in order) for r in with_positions(df, order, form, bucket_width=2).collect()}
           for form in (False, True)]
    assert got[0] == got[1] and len(got[0]) == 400
