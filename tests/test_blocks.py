"""Feature blocks against a literal walk over small dialogues, plain and chunked."""

from __future__ import annotations

import re

import numpy as np
import pytest

from conftest import by_key
from turnwise.functions import text as X
from turnwise.plans.dialogue import session_feedback, session_trajectory
from turnwise.plans.linguistic import session_linguistics
from turnwise.plans.structural import session_structure
from turnwise.plans.temporal import session_timing


def ratio(a, b):
    return a / b if b else 0.0


def label(text):
    low = text.lower()
    hits = lambda words: sum(low.count(w) for w in words)
    if hits(X.CORRECTION_MARKERS) > hits(X.AFFIRM_MARKERS):
        return "correct"
    if hits(X.AFFIRM_MARKERS):
        return "affirm"
    return "reexplain" if hits(X.REEXPLAIN_MARKERS) or len(low) > 200 else "other"


def walk(turns):
    """Straight-line restatement of the dialogue counters."""
    labels = [label(c) if r == "tutor" else None for r, c, _ in turns]
    out = {"attempts": [], "repairs": 0, "streak": 0, "c_run": 0, "a_run": 0, "s_run": 0}
    students = since = open_fix = c = a = s = 0
    valence = 0.0
    for i, ((role, _, _), lab) in enumerate(zip(turns, labels)):
        if role == "student":
            students += 1
            s += 1
            out["s_run"] = max(out["s_run"], s)
        if lab == "affirm":
            if students:
                out["attempts"].append(students)
            out["repairs"] += open_fix
            open_fix = 0
            a, c, s, since = a + 1, 0, 0, 0
            out["a_run"] = max(out["a_run"], a)
        if lab == "correct":
            open_fix, since, c, a = 1, since + 1, c + 1, 0
            out["streak"], out["c_run"] = max(out["streak"], since), max(out["c_run"], c)
        if lab == "reexplain":
            since = 0
        if lab in ("affirm", "correct", "reexplain"):
            students = 0
        if i and role == "tutor" and turns[i - 1][0] == "student":
            valence = {"affirm": 1.0, "correct": -1.0}.get(lab, 0.0)
    return labels, out | {"valence": valence}


@pytest.mark.parametrize("chunked", [False, True])
def test_feedback_and_trajectory(dialogues, small_chunks, chunked):
    frame, sessions = dialogues
    fb = by_key(session_feedback(frame, chunked), "session_id")
    tr = by_key(session_trajectory(frame, chunked), "session_id")
    for sid, turns in sessions.items():
        labels, w = walk(turns)
        n, f, t = len(turns), fb[sid], tr[sid]
        corrects = [i for i, x in enumerate(labels) if x == "correct"]
        affirms = [i for i, x in enumerate(labels) if x == "affirm"]
        tutors = sum(r == "tutor" for r, _, _ in turns)
        assert f["fbs_n_correct"] == len(corrects) and f["fbs_n_affirm"] == len(affirms)
        assert np.isclose(f["fbs_affirm_rate"], ratio(len(affirms), tutors))
        assert f["fbs_n_affirmed_episodes"] == len(w["attempts"])
        assert f["fbs_max_attempts_before_affirm"] == max(w["attempts"], default=0)
        assert np.isclose(f["fbs_mean_attempts_before_affirm"], np.mean(w["attempts"]) if w["attempts"] else 0)
        assert f["fbs_n_repairs"] == w["repairs"]
        assert f["fbs_n_unrepaired_corrections"] == len(corrects) - w["repairs"]
        assert f["fbs_max_correction_streak"] == w["streak"]
        assert np.isclose(f["fbs_last_correction_pos"], corrects[-1] / max(n - 1, 1) if corrects else -1)
        assert t["traj_max_correction_run"] == w["c_run"] and t["traj_max_affirm_run"] == w["a_run"]
        assert t["traj_max_unaffirmed_student_run"] == w["s_run"]
        assert t["traj_final_exchange_valence"] == w["valence"]
        assert np.isclose(t["traj_last_affirm_from_end"], (n - 1 - affirms[-1]) / max(n - 1, 1) if affirms else 1)
        third, two = n // 3, 2 * n // 3
        for i, (s, e) in enumerate([(0, max(third, 1)), (third, max(two, third + 1)), (two, n)], start=1):
            seg = turns[s:e]
            said = [len(c) for r, c, _ in seg if r == "student"]
            assert np.isclose(t[f"traj_mean_student_len_t{i}"], ratio(sum(said), len(said)))
            assert np.isclose(t[f"traj_correct_rate_t{i}"],
                              ratio(labels[s:e].count("correct"), sum(r == "tutor" for r, _, _ in seg)))


@pytest.mark.parametrize("block", [session_structure, session_timing, session_linguistics])
def test_chunked_equals_plain(dialogues, small_chunks, block):
    frame, sessions = dialogues
    plain, cut = by_key(block(frame, False), "session_id"), by_key(block(frame, True), "session_id")
    assert set(plain) == set(cut) == set(sessions)
    for sid in plain:
        assert set(plain[sid]) == set(cut[sid])
        for c, v in plain[sid].items():
            assert v == cut[sid][c] or np.isclose(v, cut[sid][c]), (sid, c, v, cut[sid][c])


def test_column_counts(dialogues):
    frame, _ = dialogues
    sizes = {b: len(b(frame, False).columns) - 1 for b in (session_structure, session_timing, session_linguistics)}
    assert sizes == {session_structure: 35, session_timing: 18, session_linguistics: 56}
    assert len(session_feedback(frame, False).columns) == 21 and len(session_trajectory(frame, False).columns) == 24


def test_structure_and_timing_values(dialogues):
    frame, sessions = dialogues
    st, tm = by_key(session_structure(frame), "session_id"), by_key(session_timing(frame), "session_id")
    for sid, turns in sessions.items():
        roles, times = [r for r, _, _ in turns], [t for _, _, t in turns]
        runs, k = [], 0
        for i, r in enumerate(roles):
            k = k + 1 if i and r == roles[i - 1] else 1
            if i + 1 == len(roles) or roles[i + 1] != r:
                runs.append(k)
        assert st[sid]["struct_role_switches"] == len(runs) - 1
        assert np.isclose(st[sid]["struct_runlen_median"], np.median(runs))
        gaps = [b - a for a, b in zip(times, times[1:]) if a is not None and b is not None and 0 <= b - a <= 120]
        assert np.isclose(tm[sid]["temp_gap_p90"], np.percentile(gaps, 90) if gaps else 0)
        assert tm[sid]["temp_n_long_pauses"] == sum(g > 10 for g in gaps)
        late = [b - a for (ra, _, a), (rb, _, b) in zip(turns, turns[1:]) if ra == "tutor" and rb == "student"
                and a is not None and b is not None and 0 <= b - a <= 120]
        assert tm[sid]["temp_n_student_responses"] == len(late)


def test_linguistic_values(dialogues):
    frame, sessions = dialogues
    got = by_key(session_linguistics(frame), "session_id")
    for sid, turns in sessions.items():
        for role in X.ROLES:
            said = [c for r, c, _ in turns if r == role]
            joined = "\n".join(said).lower()
            words = re.findall(X.WORD, re.sub(X.BRACKET, " ", joined))
            g = lambda c: got[sid][f"ling_{role}_{c}"]  # noqa: E731, B023
            hedges = sum(joined.count(h) for h in X.HEDGE)
            assert np.isclose(g("hedge_rate"), 100 * ratio(hedges, max(len(words), 1)) if said else 0)
            assert np.isclose(g("type_token_ratio"), ratio(len(set(words)), len(words)))
            pairs = sum(a == b for a, b in zip(words, words[1:]))
            assert np.isclose(g("repetition_rate"), ratio(pairs, len(words) - 1) if len(words) > 1 else 0)
            assert np.isclose(g("q_rate"), ratio(sum("?" in c for c in said), len(said)))


@pytest.mark.parametrize("text,want", [
    ("incorrect", "affirm"), ("Not quite, close", "correct"), ("Well done!", "affirm"), ("step by step", "reexplain"),
    ("x" * 201, "reexplain"), ("x" * 200, "other"), ("", "other")])
def test_turn_labels(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.selectExpr(X.tutor_turn_label("t")).first()[0] == want == label(text)


def test_whole_word_option(spark):
    df = spark.createDataFrame([("incorrect",), ("that is correct",)], "t string")
    got = [r[0] for r in df.selectExpr(X.tutor_turn_label("t", word_bounded=True)).collect()]
    assert got == ["correct", "affirm"]


@pytest.mark.parametrize("role,text,move", [
    ("tutor", "Hello, can you hear me?", "managing"), ("tutor", "does that make sense?", "checking"),
    ("tutor", "almost, great", "correcting"), ("tutor", "great", "affirming"), ("tutor", "first do this", "scaffolding"),
    ("tutor", "what is 4?", "questioning"), ("tutor", "adding", "explaining"), ("student", "I'm not sure", "expressing_confusion"),
    ("student", "is it 4?", "asking"), ("student", " Okay. ", "acknowledging"), ("student", "4", "off_task"),
    ("student", "it is four", "answering"), ("background", "hello", "managing")])
def test_moves(spark, role, text, move):
    df = spark.createDataFrame([(role, text)], "r string, t string")
    assert df.selectExpr(X.move_label("r", "t")).first()[0] == move


def test_external_label(spark):
    rows = [("Affirming.", "tutor", "x", "affirming"), ("asking", "tutor", "adding", "explaining"),
            (" answering maybe", "student", "4?", "answering"), (None, "student", "4?", "asking")]
    df = spark.createDataFrame(rows, "raw string, r string, t string, want string")
    assert all(a == b for a, b in df.selectExpr(X.accepted_label("raw", "r", "t"), "want").collect())


def test_phrase_counts_look_before_they_replace(spark):
    from turnwise.functions import text as X

    texts = ["mm mmm mmmm", "", None, "don't know \u00e9t\u00e9 \U0001f600 lost lost", "not quite no", "umum um"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for phrases in (X.FILLER, X.HEDGE, X.NEGATE):
        e = X.phrase_count("t", phrases)
        assert e.count("contains(") == len(phrases)
        got = dict(df.selectExpr("i", f"{e} AS n").collect())
        assert got == {i: None if t is None else sum(t.count(p) for p in phrases) for i, t in enumerate(texts)}
