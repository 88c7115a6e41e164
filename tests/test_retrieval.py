from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from conftest import by_key
from turnwise.operators import render as RD
from turnwise.operators import retrieval as RT
from turnwise.operators import windows as WN
from turnwise.plans import alignment as AL
from turnwise.plans import content as CT
from turnwise.plans import position as PO

STOP = ("the", "of")
POOL = "the area of a triangle base height angle sum ratio graph line slope point".split()


def literal_windows(n, size, stride):
    if n <= size:
        return [(0, n)]
    out = [(s, s + size) for s in range(0, n - size + 1, stride)]
    return out if out[-1][1] >= n else out + [(n - size, n)]


@pytest.mark.parametrize("size,stride", [(20, 10), (3, 2), (5, 5), (4, 1)])
def test_windows_cover_every_length(spark, size, stride):
    lengths = [1, 2, 3, 4, 5, 6, 7, 19, 20, 21, 30, 31, 45]
    rows = [(f"n{n}", p, n, str(p)) for n in lengths for p in range(n)]
    df = spark.createDataFrame(rows, "session_id string, pos bigint, n_rows bigint, content string")
    got = {}
    for r in WN.window_texts(df, size, stride).collect():
        got.setdefault(r.session_id, {})[r.window_idx] = (r.w_start, r.w_end, r.content)
    counts = {r.session_id: r.c for r in df.selectExpr("session_id", f"{WN.window_count('n_rows', size, stride)} AS c").collect()}
    for n in lengths:
        want = literal_windows(n, size, stride)
        assert [got[f"n{n}"][i][:2] for i in range(len(want))] == want and len(got[f"n{n}"]) == len(want)
        assert all(w[2] == " ".join(map(str, range(w[0], w[1]))) for w in got[f"n{n}"].values())
        assert counts[f"n{n}"] == len(want)


def test_merge_touching_and_apart(spark):
    rows = [("a", 0, 5), ("a", 5, 8), ("a", 10, 12), ("b", 3, 9), ("b", 4, 6), ("b", 3, 9), ("c", 1, 2)]
    df = spark.createDataFrame([(k, s, e, 50) for k, s, e in rows], "k string, w_start bigint, w_end bigint, n_rows bigint")
    got = sorted((r.k, r.w_start, r.w_end) for r in WN.merge_spans(df, ["k"]).collect())
    assert got == [("a", 0, 8), ("a", 10, 12), ("b", 3, 9), ("c", 1, 2)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    sessions = {f"s{i}": [" ".join(rng.choices(POOL, k=rng.randint(0, 6))) for _ in range(n)]
                for i, n in enumerate([1, 4, 9, 23])}
    goals = {1: "area of a triangle", 2: "slope of the line", 3: "zebra", 4: "", 5: "area of a triangle"}
    rows = [(s, p, len(ts), ("tutor", "student")[p % 2], t, float(p)) for s, ts in sessions.items() for p, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "session_id string, pos bigint, n_rows bigint, role string, content string, t_seconds double")
    objectives = spark.createDataFrame(list(goals.items()), "objective_id bigint, objective_text string")
    pairs = spark.createDataFrame([(s, g, len(ts)) for s, ts in sessions.items() for g in goals],
                                  "session_id string, objective_id bigint, n_rows bigint")
    return df, objectives, pairs, sessions, goals


def grams(text):
    words = [w for w in re.findall(r"\b\w\w+\b", text.lower()) if w not in STOP]
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def literal_sims(sessions, goals, size, stride):
    docs = [grams(t) for t in sorted(set(goals.values()))]
    df = Counter(t for d in docs for t in d)
    idf = {t: math.log((1 + len(docs)) / (1 + c)) + 1 for t, c in df.items()}
    def vec(text):
        v = {t: (1 + math.log(c)) * idf[t] for t, c in grams(text).items() if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}
    out = {}
    for s, ts in sessions.items():
        wins = literal_windows(len(ts), size, stride)
        vs = [vec(" ".join(ts[a:b])) for a, b in wins]
        for g, text in goals.items():
            o = vec(text)
            out[s, g] = [sum(o[t] * v.get(t, 0.0) for t in o) for v in vs]
    return out


@pytest.mark.parametrize("chunked", [False, True])
def test_lexical_relevance_summary_and_topk(corpus, small_chunks, chunked):
    df, objectives, pairs, sessions, goals = corpus
    sims = RT.lexical_similarity(df, pairs, objectives, STOP, chunked, 3, 2, chunk_windows=2)
    want = literal_sims(sessions, goals, 3, 2)
    got = {(r.session_id, r.objective_id, r.window_idx): r.sim for r in sims.collect()}
    for (s, g), values in want.items():
        for i, v in enumerate(values):
            assert np.isclose(got.get((s, g, i), 0.0), v)
    fixed = sims.selectExpr(*RT.PAIR, "window_idx", "round(sim, 9) AS sim")
    top = {}
    for r in RT.top_windows(fixed, pairs, 3, 3, 2).collect():
        top.setdefault((r.session_id, r.objective_id), {})[r.rank] = (r.window_idx, r.w_start, r.w_end)
    summary = by_key(RT.similarity_summary(fixed, pairs, chunked, 3, 2), *RT.PAIR)
    for (s, g), values in want.items():
        best = sorted(range(len(values)), key=lambda i: (-round(values[i], 9), i))[:3]
        wins = literal_windows(len(sessions[s]), 3, 2)
        assert [top[s, g][k + 1] for k in range(len(best))] == [(i, *wins[i]) for i in best]
        x, m = np.asarray(values), summary[s, g]
        assert m["n_windows"] == len(x) and np.isclose(m["sim_mean"], x.mean()) and np.isclose(m["sim_std"], x.std(), atol=1e-7)
        assert np.isclose(m["sim_max"], x.max()) and np.isclose(
            m["sim_frac_above_half_max"], (x >= 0.5 * x.max() - 1e-9).mean() if x.max() > 0 else 0)


@pytest.mark.parametrize("cell", [1, 2, 12])
def test_passage_terms_are_counted_in_as_many_tasks_as_asked(spark, corpus, monkeypatch, cell):
    df, objectives, pairs, sessions, goals = corpus
    monkeypatch.setattr(RT, "CELL", cell)
    counts = RT.passage_term_counts(df, RT.fit_idf(objectives, STOP), STOP, False, 3, 2, parts=7)
    assert counts.rdd.getNumPartitions() == 7  # none are merged, so a task's share does not grow with the input
    got = {(r.session_id, r.window_idx, r.term): r.tf for r in counts.collect()}
    known, want = set().union(*map(grams, goals.values())), {}
    for s, ts in sessions.items():
        for i, (a, b) in enumerate(literal_windows(len(ts), 3, 2)):
            want |= {(s, i, t): n for t, n in grams(" ".join(ts[a:b])).items() if t in known}
    assert got == want
    assert RT.parts_for(spark, 600 * RT.PART_BYTES) == 600 and RT.parts_for(spark, None) >= 1


def test_topic_blocks_and_positions(spark, corpus):
    df, objectives, pairs, sessions, goals = corpus
    sims = RT.lexical_similarity(df, pairs, objectives, STOP, False, 3, 2)
    top = RT.top_windows(sims, pairs, 3, 3, 2)
    spans = AL.topic_spans(top)
    aligned = AL.alignment(sims, top, pairs, df, False, 3, 2)
    assert len(aligned.columns) == 2 + 17 and aligned.count() == pairs.count()
    both = AL.topic_dialogue(spans, df)
    assert both.count() == pairs.count() and len(both.columns) == 2 + 20 + 23
    responses = pairs.selectExpr("*", "explode(sequence(1, CAST(objective_id % 2 + 1 AS INT))) AS copy")
    got = by_key(PO.objective_positions(responses, spans, df), *RT.PAIR)
    own = {}
    for r in spans.collect():
        own.setdefault((r.session_id, r.objective_id), []).append((r.w_start, r.w_end))
    for s, ts in sessions.items():
        answers = [(g, c) for g in goals for c in range(g % 2 + 1)]
        centre = {g: (min(a for a, _ in own[s, g]) + max(b for _, b in own[s, g])) / 2 for g in goals}
        for g in goals:
            overlap = sum(max(0, min(b, d) - max(a, c)) for h, k in answers if (h, k) != (g, 0)
                          for a, b in own[s, g] for c, d in own[s, h])
            covered = sum(b - a for a, b in own[s, g])
            m = got[s, g]
            assert m["lopos_n_competing_los"] == len(answers)
            assert np.isclose(m["lopos_overlap_with_others"], overlap / covered)
            assert m["lopos_ordinal"] == sum(centre[h] < centre[g] for h, _ in answers)
            last = max(b for _, b in own[s, g])
            assert np.isclose(m["lopos_gap_to_session_end_utt"], (len(ts) - last) / len(ts))


def test_pair_without_spans_gets_neutral_values(spark, corpus):
    df, _, pairs, *_ = corpus
    none = spark.createDataFrame([], "session_id string, objective_id bigint, span bigint, w_start bigint, w_end bigint, n_rows bigint")
    r = PO.objective_positions(pairs, none, df).first()
    assert r.lopos_start_pos == r.lopos_centre_pos == 0.5 and r.lopos_utt_share == 0.0 and r.lopos_n_competing_los == 5.0


def test_pooling_and_attention(spark):
    w = [("s", i, [math.cos(a), math.sin(a)]) for i, a in enumerate([0.1, 0.7, 1.5, 3.0])]
    windows = spark.createDataFrame(w, "session_id string, window_idx bigint, vector array<double>")
    goals = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, -1.0])], "objective_id bigint, vector array<double>")
    pairs = spark.createDataFrame([("s", 1), ("s", 2)], "session_id string, objective_id bigint")
    sims = RT.dense_similarity(windows, pairs, goals)
    pooled = by_key(CT.content_pool(sims, 2, 2), "objective_id")
    v = np.array([x[2] for x in w])
    s1 = v @ [1.0, 0.0]
    order = np.argsort(-s1)[:2]
    wt = np.clip(s1[order], 0, None) / np.clip(s1[order], 0, None).sum()
    assert np.allclose([pooled[1]["cont_raw_000"], pooled[1]["cont_raw_001"]], wt @ v[order])
    s2 = v @ [0.0, -1.0]
    order = np.argsort(-s2, kind="stable")[:2]
    assert np.allclose([pooled[2]["cont_raw_000"], pooled[2]["cont_raw_001"]], v[order].mean(axis=0))  # all <= 0
    stats = by_key(CT.attention_statistics(sims.selectExpr("*", "window_idx / 4D AS position"), 0.5), "objective_id")
    a = np.exp(s1 / 0.5) / np.exp(s1 / 0.5).sum()
    assert np.isclose(stats[1]["attention_entropy"], -(a * np.log(a)).sum())
    assert np.isclose(stats[1]["attended_position"], (a * np.arange(4) / 4).sum())


def test_encoder_hook(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "")], "k bigint, content string")
    got = by_key(CT.encode_texts(df, ["k"], lambda batch: [[len(t), 3.0] for t in batch]), "k")
    assert np.allclose(got[1]["vector"], [3 / math.sqrt(18)] * 2) and np.allclose(got[2]["vector"], [0, 1])
    assert CT.hashed_vectors(df, ["k"], 8).count() == 2


def test_rendering(spark, small_chunks):
    rows = [("s", p, 4, r, c) for p, (r, c) in enumerate([("tutor", " hi "), ("student", "yes"), ("background", " "), ("x", "end")])]
    df = spark.createDataFrame(rows, "session_id string, pos bigint, n_rows bigint, role string, content string")
    pairs = spark.createDataFrame([("s", 1, 4)], "session_id string, objective_id bigint, n_rows bigint")
    spans = spark.createDataFrame([("s", 1, 0, 1, 3, 4)], "session_id string, objective_id bigint, span bigint, w_start bigint, w_end bigint, n_rows bigint")
    assert RD.session_text(df, 17, True).first().text == "tutor:  hi \nstude"
    assert RD.tagged_passages(spans, df).first().text == "S: yes"
    doc = RD.bounded_document(spans, df, pairs, 120, 2).first().text
    assert doc == "<relevant_dialogue>\n<student> yes\n<background>  \n<lesson_context>\n<tutor>  hi \n<x> end"
    assert RD.bounded_document(spans, df, pairs, 25, 2).first().text == doc[:25]


@pytest.mark.parametrize("n,k", [(0, 3), (1, 3), (3, 3), (10, 4), (11, 4), (100, 7), (6, 4)])
def test_evenly_spaced(spark, n, k):
    got = spark.range(1).selectExpr(f"{RD.evenly_spaced(f'CAST({n} AS BIGINT)', k)} AS x").first().x
    want = list(range(n)) if n <= k else np.unique(np.linspace(0, n - 1, k).round().astype(int)).tolist()
    assert list(got) == want


def test_no_window_holds_words_or_text_of_topic_rows(spark, tmp_path):
    from turnwise.catalog import inputs as I

    texts = ["alpha beta", "", None, "gamma", "the of", "delta alpha", "", "beta"]
    spark.createDataFrame([(i, t, f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long"
                          ).write.parquet(str(tmp_path / "documents.parquet"))
    rows, chunked = I.topic_utterances(spark, str(tmp_path))
    got = {r["doc_id"]: (r["pos"], r["n_rows"], r["before"] and (r["before"]["pos"], r["before"]["word"])) for r in rows.collect()}
    assert not chunked and got == {0: (0, 4, None), 2: (1, 4, (0, "beta")), 4: (2, 4, (0, "beta")), 6: (3, 4, (0, "beta")),
                                   1: (0, 4, None), 3: (1, 4, None), 5: (2, 4, (1, "gamma")), 7: (3, 4, (2, "alpha"))}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert windows and not any("tokens" in line or "content" in line for line in windows)
    below = plan[plan.index("Window"):]
    projected = next(line for line in below.splitlines() if "Project" in line)
    assert "tokens#" not in projected.split("AS last")[0].split("CASE WHEN")[0] and "content#" not in projected


def test_encoded_passages_shuffle_counts_and_no_text(spark, tmp_path, monkeypatch):
    from turnwise.catalog import inputs as I
    from turnwise.catalog import load_all

    wild = ["Area of A triangle, area", "", "\u212aelvin \u0130stanbul \u03a3\u0391\u03a3 na\u00efve x1 X1", None, "a-b_c d'e 0", "\n\t", "end", "of"]
    texts = [wild[i % 8] for i in range(75)]
    spark.createDataFrame([(i, t, f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long"
                          ).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, "area of a triangle") for i in range(20)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    monkeypatch.setattr(CT, "CACHED", 3)
    out = load_all()["encoded_window_relevance"].build(spark, str(tmp_path))
    rows, _ = I.long_utterances(spark, str(tmp_path))
    plain = {(r[0], r[1]): r[2] for r in CT.hashed_vectors(WN.window_texts(rows), ["session_id", "window_idx"]).collect()}
    goal = CT.hashed_vectors(spark.createDataFrame([(1, "area of a triangle")], "objective_id long, content string"), ["objective_id"]).first()[1]
    got = out.collect()
    assert got and {(r.session_id, r.window_idx) for r in got} == set(plain)
    assert all(np.isclose(r.sim, np.dot(plain[r.session_id, r.window_idx], goal), atol=1e-12) for r in got)
    moved = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "documents.parquet" in line]
    assert not any("text" in line for line in moved)  # texts are read and counted in one scan, written as counts
