from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from turnwise.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_chunks(monkeypatch):
    """Cut groups every three rows so chunk borders are exercised."""
    monkeypatch.setattr("turnwise.operators.ordered.CHUNK_ROWS", 3)


SAYINGS = (
    "exactly, well done", "not quite, try again", "we need to add them", "hello there", "ok",
    "um I think it's 4", "incorrect", "no, look again", "why? [unclear] go- on", "yes yes", "",
    "the reason is this", "I don't know", "that's right!", "know know", "[laughs] maybe",
)


@pytest.fixture(scope="session")
def dialogues(spark):
    """Random small dialogues with known rows: (frame, {session: [(role, text, t)]})."""
    rng = random.Random(5)
    sessions, rows = {}, []
    for i, n in enumerate([1, 2, 3, 4, 5, 7, 11, 20, 31]):
        turns, t = [], 0.0
        for _ in range(n):
            t += rng.choice([-1.0, 0.0, 2.5, 11.0, 120.0, 121.0])
            turns.append((rng.choice(["tutor", "student", "student", "background"]),
                          rng.choice(SAYINGS), None if rng.random() < 0.15 else t))
        sessions[f"s{i}"] = turns
        rows += [(f"s{i}", p, n, r, c, x) for p, (r, c, x) in enumerate(turns)]
    frame = spark.createDataFrame(
        rows, "session_id string, pos bigint, n_rows bigint, role string, content string, t_seconds double")
    return frame, sessions


def by_key(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict() for r in df.collect()}
