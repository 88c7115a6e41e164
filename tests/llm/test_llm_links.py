"""Near duplicates, components and nearest neighbours against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from turnwise.llm import components, cpsjoin, hnsw, vptree


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_hubs_and_loops(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(200, 260)] + [(5, k) for k in range(20, 60)] + [(7, 7), (9, 8), (8, 9), (60, 21)]
    links += [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(160)]
    rng.shuffle(links)
    frame = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = {r.node: r.component for r in components.connected_components(frame).collect()}
    assert got == roots({n for a, b in links if a != b for n in (a, b)}, [x for x in links if x[0] != x[1]])
    assert components.connected_components(frame.limit(0)).count() == 0


def shingle_set(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()


def brute_groups(rows, words):
    sets, held, links = [shingle_set(t, words) for _, t in rows], {}, []
    for i, s in enumerate(sets):
        for g in s:
            held.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for g in s for j in held[g] if j > i).items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                links.append((rows[i][0], rows[j][0]))
    component = roots({i for i, _ in rows}, links)
    return {i: (len(s), component[i], component[i] == i) for (i, _), s in zip(rows, sets, strict=True)}


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, words):
    monkeypatch.setattr(cpsjoin, "SMALL", 6)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, None, "", " \n", "One two", "one TWO", "one two three four", "É é a b", "é é a b"]
    copied, passage = [rng.choice(vocabulary) for _ in range(90)], [rng.choice(vocabulary) for _ in range(50)]
    for _ in range(60):
        one = copied[:]
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
            one[rng.randrange(90)] = rng.choice(vocabulary)
        texts.append(" ".join(one))
    for _ in range(40):
        texts.append(" ".join([rng.choice(vocabulary) for _ in range(40)] + passage))
    rows = [(i * 3 % 997, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, b"") for r in rows], "doc_id long, text string, signature binary").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in cpsjoin.near_duplicates(docs, words, 80).collect()}
    assert got == brute_groups(rows, words)


@pytest.mark.parametrize("recall", [0.9, 0.99])
def test_trees_reach_target_recall_in_nodes_that_stay_large(recall):
    rng = np.random.default_rng(2)
    trees, pairs = cpsjoin.trees_for(80, recall), 1500
    signature, missed = cpsjoin.Signatures(trees), 0
    for _ in range(pairs):
        both, one, other = np.split(rng.integers(0, 1 << 63, 180).astype(np.uint64), [144, 162])  # 144 of 180: 0.8
        rows = np.stack([np.frombuffer(signature(np.concatenate([both, own])), "<u2") for own in (one, other)])
        nodes = cpsjoin._roots(trees)
        for _ in range(cpsjoin.DEPTH + 1):
            below = [cpsjoin._children(nodes, rows, np.full(len(nodes), k))[1] for k in (0, 1)]
            nodes = np.intersect1d(*below)
        missed += not len(nodes)
    assert missed / pairs < 1 - recall + 3 * (recall * (1 - recall) / pairs) ** 0.5
    print(recall, trees, missed / pairs)


def test_near_duplicates_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (4, "A b c d e f")], "doc_id long, text string")
    got = sorted(map(tuple, cpsjoin.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (4, 2, 1, False)], key=str)
    assert [r.doc_id for r in cpsjoin.keep_first(docs).orderBy("doc_id").collect()] == [None, 1, 1]
    assert cpsjoin.near_duplicates(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(0)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + 0.06 * rng.standard_normal(16)).tolist(), 1) for i in range(150)]
    rows += [(300 + i, centre.tolist(), 1) for i in range(40)]
    rows += [(400 + i, rng.standard_normal(16).tolist(), int(rng.integers(0, 3))) for i in range(150)]
    return rows + [(800, None, 1), (801, [0.0] * 16, 1), (802, [float("nan")] + [1.0] * 15, 1), (803, [None] + [1.0] * 15, 1), (804, [], 1),
                   (805, centre.tolist(), None), (806, (2 * centre).tolist(), 1), (807, [float("inf")] * 16, 1)]


def good(vector):
    return vector is not None and any(vector) and all(x is not None and np.isfinite(x) for x in vector)


def test_vector_links_equal_brute_force(spark, vectors):
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").repartition(4)
    found = hnsw.near_duplicate_vectors(frame, shard_rows=64, block_rows=50).collect()
    links, counts = [], Counter()
    for label in (0, 1, 2):
        own = [(i, np.array(v)) for i, v, k in vectors if k == label and good(v)]
        matrix = np.array([v / np.linalg.norm(v) for _, v in own])
        for a, b in zip(*np.nonzero(matrix @ matrix.T >= 0.98), strict=True):
            if a != b:
                links.append((own[a][0], own[b][0]))
                counts[own[a][0]] += 1
    component = roots({i for i, _, _ in vectors}, links)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == {
        i: (counts[i], component[i], component[i] == i) for i, _, _ in vectors}
    assert len(found) == len(vectors)
    assert hnsw.near_duplicate_vectors(frame.limit(0)).count() == 0


def test_graph_search_finds_nearest():
    rng = np.random.default_rng(5)
    points = rng.standard_normal((1500, 12))
    points /= np.linalg.norm(points, axis=1)[:, None]
    graph = hnsw.Graph.loaded(points, hnsw.Graph(points).saved())
    ids, _ = graph.search(points[:100], 64)
    truth = np.argsort(-points[:100] @ points.T, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids.tolist(), truth.tolist(), strict=True)]) > 0.95
    assert (ids[:, 0] == np.arange(100)).all()


@pytest.mark.parametrize("factor,least", [(1.0, 1.0), (1.05, 0.9)])
def test_nearest_equals_brute_force(spark, vectors, factor, least):
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, rank int").repartition(4)
    usable = vptree.usable(frame)
    queries = usable.where("vec_id % 20 = 0")
    answers = vptree.nearest(usable, queries, 20, factor, shard_rows=64, block_rows=10)
    got = {}
    for r in answers.collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    own = [(i, np.array(v)) for i, v, _ in vectors if good(v)]
    hits, total = 0, 0
    for q, v in own:
        if q % 20 == 0:
            ranked = sorted(((float(vptree._products(v[None], w[None])[0]), i) for i, w in own if i != q), key=lambda x: (-x[0], x[1]))[:20]
            answer = [got[q][k] for k in range(1, 21)]
            hits += len({i for _, i in ranked} & {i for i, _ in answer})
            total += 20
            if factor == 1.0:
                assert answer == [(i, s) for s, i in ranked]
    assert hits / total >= least
    assert vptree.recall(answers, usable, queries, 20) >= least
    few = vptree.nearest(usable.where("vec_id < 5"), usable.where("vec_id = 0"), 20)
    assert few.count() == 4
    assert vptree.nearest(usable.limit(0), usable.limit(0), 20).count() == 0


@pytest.mark.parametrize("longest", [100.0, 1e8, 1e200])
def test_nearest_with_one_long_vector(spark, longest):
    rng = np.random.default_rng(4)
    points = rng.standard_normal((2000, 24))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    points[1] *= longest
    points[2] *= 1e-150
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(5000, [1.0, 2.0])], "vec_id long, embedding array<double>")
    usable = vptree.usable(frame.repartition(4))
    queries = usable.where("vec_id % 20 = 0")
    truth = {}
    for q in range(0, 2000, 20):
        scores = vptree._products(np.broadcast_to(points[q], points.shape), points)
        truth[q] = [i for i in np.lexsort((np.arange(2000), -scores)).tolist() if i != q][:20]
    exact = vptree.nearest(usable, queries, 20, 1.0, shard_rows=500).collect()
    found = {q: [r.vec_id for r in sorted(exact, key=lambda r: r.rank) if r.query_id == q] for q in truth}
    assert found == truth
    relaxed = vptree.audited_nearest(usable, queries, 20, shard_rows=500)
    hits = sum(r.vec_id in truth.get(r.query_id, ()) for r in relaxed.collect())
    assert hits >= 0.9 * 20 * len(truth)


def test_exact_search_orders_equal_products_by_id(spark):
    rng = np.random.default_rng(6)
    points = rng.integers(-1, 2, (600, 8)).astype(float)
    points[~points.any(axis=1), 0] = 1
    order = rng.permutation(600)
    usable = vptree.usable(spark.createDataFrame([(int(i), p.tolist()) for i, p in zip(order, points, strict=True)], "vec_id long, embedding array<double>"))
    got = vptree.nearest(usable, usable.where("vec_id % 20 = 0"), 20, 1.0, shard_rows=300).collect()
    by_id = points[np.argsort(order)]
    for q in range(0, 600, 20):
        scores = by_id @ by_id[q]
        truth = [i for i in np.lexsort((np.arange(600), -scores)).tolist() if i != q][:20]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == truth


def test_texts_that_share_too_little_are_not_searched(spark, monkeypatch):
    rng = random.Random(8)
    fresh = iter(range(10**6))
    base = [f"b{i}" for i in range(60)]
    texts = [" ".join(f"u{next(fresh)}" for _ in range(40)) for _ in range(30)]  # nothing shared
    texts += [" ".join(base + [f"u{next(fresh)}" for _ in range(40)]) for _ in range(30)]  # a common passage, 0.4 own
    texts += [" ".join(base), " ".join(base), " ".join(base[:-2])]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [shingle_set(t, 4) for t in dict.fromkeys(texts)]
    held = Counter(g for s in sets for g in s)
    own = sorted(n for s in sets if (n := sum(held[g] == 1 for g in s)))
    assert sorted(r.n_own for r in cpsjoin.own_shingles(docs, 4).collect()) == own
    seen, branched = [], cpsjoin.branch_roots
    monkeypatch.setattr(cpsjoin, "branch_roots", lambda classes, trees: seen.append(classes.count()) or branched(classes, trees))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in cpsjoin.near_duplicates(docs, 4, 80).collect()}
    assert got == brute_groups(rows, 4)
    assert seen == [2]


def test_members_of_one_node_meet_by_size_and_bits(spark):
    rng = np.random.default_rng(3)
    both, rest = rng.integers(0, 1 << 63, 90).astype(np.uint64), rng.integers(0, 1 << 63, (30, 70)).astype(np.uint64)
    sets = [np.concatenate([both, own]) for own in rest] + [np.concatenate([both, rest[0][:66], rest[1][:4] + np.uint64(1)])]
    signature, columns = cpsjoin.Signatures(13), ", ".join(f"{c} long" for c in (*cpsjoin.CARRIED, "component", "common"))
    bits = cpsjoin._bits([signature(s)[:2 * cpsjoin.SKETCH] for s in sets]).tolist()
    rows = [(1, i, 160, 160, *b, i, 2) for i, b in enumerate(bits)] + [(1, 40, 100, 100, *bits[0], 40, 2), (1, 41, 160, 110, *bits[0], 41, 2)]
    met = cpsjoin._across(spark.createDataFrame(rows, columns), 80)
    assert sorted(map(tuple, met.collect())) == [(0, 30)]
