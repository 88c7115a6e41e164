"""The registry, and a sample of queries against DuckDB at the smallest scale."""

from __future__ import annotations

import os
import re
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as entry_point  # noqa: E402
from check_oracle import TABLES, compare  # noqa: E402
from turnwise.catalog import load_all  # noqa: E402

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables absent")


def test_registry_shape():
    names, sql = entry_point.queries(), entry_point.oracle_sql()
    assert set(sql) <= set(names) and len(names) >= 100
    assert all(re.fullmatch(r"[a-z][a-z0-9_]*", n) for n in names)
    assert set(load_all()) <= set(names) and not any(n == "pipeline" or re.match(r"op\d", n) for n in load_all())


def test_entry_runs(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", [
    "session_timing", "session_trajectory", "topic_time_share", "model_fold_encodings", "within_fold_auc",
    "normalized_utterances", "promotion_gate", "content_pool",
])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    ok, note, _ = compare(spark, con, load_all()[name], SMALL)
    assert ok, note
