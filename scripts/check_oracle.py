"""Run registered queries against DuckDB on one scale folder and report differences.

usage: python scripts/check_oracle.py [name-substring ...]   (CHECK_SF_DIR overrides the folder)
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from turnwise.catalog import load_all  # noqa: E402
from turnwise.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6f}"
        return str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, con, q, sf_dir):
    start = time.time()
    df = q.build(spark, sf_dir)
    got_rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if q.sql is None:
        return True, f"rows={len(got_rows)} (no sql)", seconds
    start = time.time()
    rel = con.execute(q.sql)
    columns = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    want_rows = rel.fetchall()
    duck = time.time() - start
    got, got_cols = canonical(df.columns, got_rows)
    want, want_cols = canonical(columns, want_rows)
    if got_cols != want_cols:
        return False, f"columns differ: {set(got_cols) ^ set(want_cols)}", seconds
    same_type = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = {n: (t, types[n]) for n, t in df.dtypes if same_type.get(t, t) != types[n]
           and not t.startswith("array")}
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}", seconds
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        cells = [(c, a, b) for c, a, b in zip(got_cols, g, w) if a != b]
        return False, f"{len(bad)}/{len(got)} rows differ, e.g. {cells[:6]} row={g[-1]}", seconds
    return True, f"rows={len(got)} duck={duck:.2f}s" + (f" TYPES {odd}" if odd else ""), seconds


def main() -> int:
    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    failures = 0
    for name, q in load_all().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, note, seconds = compare(spark, con, q, sf_dir)
        except Exception as exc:  # report and go on with the next query
            ok, note, seconds = False, f"{type(exc).__name__}: {str(exc)[:700]}", 0.0
        failures += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {seconds:6.2f}s {note}", flush=True)
    print(f"{failures} failing")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
