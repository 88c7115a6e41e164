from __future__ import annotations

import json

import numpy as np
import pytest

from turnwise.functions.scalars import elapsed_seconds
from turnwise.operators.quality import prediction_sink
from turnwise.sources import files as FS


def test_routing_by_header_not_name(spark, tmp_path):
    (tmp_path / "zz.csv").write_text('response_id,session_id,learning_objective_id,learning_objective\nr1,s1,o1,"add, ""big"" numbers"\n')
    (tmp_path / "other order.csv").write_text("session_id,response_id,learning_objective\ns2,r2,subtract\n")
    (tmp_path / "a.csv").write_text("response_id,is_correct\nr1,1\nr2,0\n")
    (tmp_path / "b1.csv").write_text("response_id,probability\n" + "".join(f"r{i},0.5\n" for i in range(50)))
    (tmp_path / "b2.csv").write_text("response_id,probability\nr0,0.5\n")
    (tmp_path / "junk.csv").write_text("x,y\n1,2\n")
    tables, problems = FS.route_tables(spark, str(tmp_path))
    got = {r.response_id: (r.session_id, r.learning_objective) for r in tables["features"].collect()}
    assert got == {"r1": ("s1", 'add, "big" numbers'), "r2": ("s2", "subtract")}
    assert FS.canonical_label(tables["labels"]).agg({"correct": "sum"}).first()[0] == 1.0
    sized = FS.full_and_smoke(tables["format"]).first()
    assert (sized.full_file, sized.full_rows, sized.smoke_file, sized.smoke_rows) == ("b1.csv", 50, "b2.csv", 1)
    assert [r.subject.rpartition("/")[2] for r in problems.collect()] == ["junk.csv"]


def test_missing_tables_are_reported(spark, tmp_path):
    (tmp_path / "a.csv").write_text("response_id,label\nr1,1\n")
    tables, problems = FS.route_tables(spark, str(tmp_path))
    assert list(tables) == ["labels"] and sorted(r.subject for r in problems.collect()) == ["features", "format"]


def test_a_file_that_breaks_fails_unless_skipping_is_asked_for(spark, tmp_path):
    import gzip

    text = "utterance_id,role,content,timestamp\n" + "".join(f"{i},tutor,{i * 7919 % 104729} words,0:00:01\n" for i in range(20_000))
    (tmp_path / "whole.csv").write_text(text)
    packed = gzip.compress(text.encode())
    sub = tmp_path / "sub"
    sub.mkdir()
    (sub / "x.csv.gz").write_bytes(packed[: len(packed) // 2])
    schema = ["utterance_id", "role", "content", "timestamp"]
    broken = FS.read_csv_group(spark, str(sub), schema, pattern="*.gz")
    with pytest.raises(Exception):
        broken.count()
    assert FS.read_csv_group(spark, str(sub), schema, skip_broken=True, pattern="*.gz").count() < 20_000


def test_label_aliases(spark):
    df = spark.createDataFrame([(1, 1)], "response_id int, label int")
    assert FS.canonical_label(df).first().correct == 1.0
    with pytest.raises(KeyError):
        FS.canonical_label(df.withColumnRenamed("label", "target"))


def test_transcripts_to_one_table(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    (raw / "s1.csv").write_text('session_id,utterance_id,role,content,timestamp\ns1,1, Tutor ,"two\nlines",0:00:05\ns1,0,STUDENT,"say ""hi""",0:00:01.5\n')
    (raw / "s2.csv").write_text("utterance_id,role,content,timestamp\n0,,hello,bad\nx,student,last,0:00:09\n")
    (raw / "s3.csv").write_text("timestamp,role,utterance_id,session_id,content\n0:01:00,tutor,0,s3,None\n")
    (raw / "empty one.csv").write_text("utterance_id,role,content,timestamp\n")
    parsed = FS.read_transcripts(spark, str(raw))
    assert [r.source_file for r in FS.unread_files(spark, str(raw), parsed).collect()] == ["empty one.csv"]
    rows = FS.normalize(parsed)
    FS.write_table(rows, str(out), partitions=2)
    back = spark.read.parquet(str(out))
    got = {(r.session_id, r.pos): (r.role, r.content, r.t_seconds) for r in back.collect()}
    assert got == {
        ("s1", 0): ("student", 'say "hi"', 1.5), ("s1", 1): ("tutor", "two\nlines", 5.0),
        ("s2", 0): ("unknown", "hello", None), ("s2", 1): ("student", "last", 9.0), ("s3", 0): ("tutor", "None", 60.0),
    }
    report = FS.transcript_report(back).first()
    assert report.n_sessions == 3 and report.n_utterances == 5 and report.roles == ["student", "tutor", "unknown"]
    assert any(".zstd." in p.name for p in out.iterdir())


@pytest.mark.parametrize("text,want", [
    ("0:00:00", 0.0), ("1:23:45", 5025.0), ("0:05:09", 309.0), ("12:00:01", 43201.0), ("bad", None), (None, None),
    (" 0:00:01.25 ", 1.25), ("0:99:99", 99 * 60 + 99.0), ("1:2:3:4", None), ("0:0:1.", None)])
def test_elapsed(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").selectExpr(elapsed_seconds("t")).first()[0]
    assert got == want if want is None else np.isclose(got, want)


def test_run_records_skip_bad_lines(spark, tmp_path):
    good = {"task": "a", "ts": "1", "tier": "cpu", "wall_seconds": 3.0, "units": 0.1, "metrics": {"experiment": "e", "logloss": 0.5}}
    (tmp_path / "ledger.jsonl").write_text(json.dumps(good) + "\n{broken\n" + json.dumps({**good, "task": "b"}) + "\n")
    rows = FS.read_runs(spark, str(tmp_path)).collect()
    assert sorted(r.task for r in rows) == ["a", "b"] and rows[0].metrics.logloss == 0.5


def test_predictions_csv_in_order(spark, tmp_path):
    want = spark.createDataFrame([(f"r{i}", i) for i in range(40)], "response_id string, pos int").repartition(5)
    made = spark.createDataFrame([(f"r{i}", i / 100) for i in range(40)], "response_id string, probability double")
    path = tmp_path / "p"
    FS.write_predictions(prediction_sink(want, made, 0.5), str(path))
    lines = []
    for part in sorted(p for p in path.iterdir() if p.suffix == ".csv"):
        lines += part.read_text().strip().splitlines()[1:]
    assert [line.split(",")[0] for line in lines] == [f"r{i}" for i in range(40)]


def test_folder_with_one_header_is_read_whole(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"t {i}.csv").write_text("utterance_id,role,content,timestamp\n0,tutor,a,0:00:01\n1,student,b,0:00:02\n")
    rows = FS.read_transcripts(spark, str(tmp_path))
    assert sorted({r.session_id for r in rows.collect()}) == ["t 0", "t 1", "t 2"] and rows.count() == 6


def test_broken_files_are_left_out_whole_and_counted(spark, tmp_path):
    head = "utterance_id,role,content,timestamp\n"
    (tmp_path / "s1.csv").write_text(head + '0,tutor,"a, ""b""\nc",0:00:01\n1,student,ok,0:00:02\n')
    (tmp_path / "s 2+x.csv").write_text("session_id," + head + "z9,0,tutor,hello,0:00:01\n,1,student,there,\n")
    (tmp_path / "many.csv").write_text(head + "0,tutor,fine,0:00:01\n1,tutor,a,b,c,0:00:02\n")
    (tmp_path / "few.csv").write_text(head + "0,tutor\n1,tutor,fine,0:00:01\n")
    (tmp_path / "only head.csv").write_text(head)
    (tmp_path / "nothing.csv").write_text("")
    (tmp_path / "other.csv").write_text("x,y\n1,2\n")
    rows, status = FS.consolidate_transcripts(spark, str(tmp_path))
    got = {r.source_file.rpartition("/")[2]: (r.status, r.n_rows, r.n_bad) for r in status.collect()}
    assert got == {"s1.csv": ("read", 2, 0), "s 2+x.csv": ("read", 2, 0), "many.csv": ("broken", 2, 1), "few.csv": ("broken", 2, 1),
                   "only head.csv": ("empty", 0, 0), "other.csv": ("no header", 0, 0)}
    texts = sorted((r.session_id, r.utterance_id, r.content) for r in rows.collect())
    assert texts == [("s 2+x", "1", "there"), ("s1", "0", 'a, "b"\nc'), ("s1", "1", "ok"), ("z9", "0", "hello")]
    with pytest.raises(FileNotFoundError):
        FS.consolidate_transcripts(spark, str(tmp_path / "s1.csv").replace("s1.csv", "other.csv"))
