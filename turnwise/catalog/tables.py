"""Normalised utterances, parsed times, routing by size and the design matrix."""

from __future__ import annotations

import uuid

from ..functions.scalars import elapsed_seconds
from ..plans.dialogue import session_feedback
from ..plans.matrix import build_matrix
from ..plans.structural import session_structure
from ..operators.ordered import aggregate, has_large_groups
from ..session import shared_folder
from ..sources.files import consolidate_transcripts, full_and_smoke, normalize
from .dialogue import FBS, base_sql, feedback_sql
from .inputs import SHORT, short_utterances, table
from .registry import query, rounded
from .sessions import STRUCT_COLUMNS, structure_sql

MESSY = """
    CAST(conv_id AS VARCHAR) AS session_id,
    CASE WHEN (conv_id + turn) % 9 = 4 THEN 'x' ELSE CAST(7 - turn AS VARCHAR) END AS utterance_id,
    CASE WHEN (conv_id + turn) % 5 = 2 THEN NULL WHEN turn % 2 = 0 THEN ' ' || upper(role) || '  ' ELSE role END AS role,
    CASE WHEN (conv_id * turn) % 7 = 3 THEN NULL ELSE text END AS content,
    CASE WHEN turn % 4 = 3 THEN 'bad' ELSE '0:0' || (turn % 8) || ':' || (10 + conv_id % 50) || CASE WHEN turn % 2 = 1 THEN '.25' ELSE '' END END AS timestamp"""
TIME_SQL = r"""
    CASE WHEN regexp_matches({t}, '^\s*(\d+):(\d{{1,2}}):(\d{{1,2}})(?:\.(\d+))?\s*$') THEN
         CAST(regexp_extract({t}, '^\s*(\d+):(\d{{1,2}}):(\d{{1,2}})(?:\.(\d+))?\s*$', 1) AS DOUBLE) * 3600
       + CAST(regexp_extract({t}, '^\s*(\d+):(\d{{1,2}}):(\d{{1,2}})(?:\.(\d+))?\s*$', 2) AS DOUBLE) * 60
       + CAST(regexp_extract({t}, '^\s*(\d+):(\d{{1,2}}):(\d{{1,2}})(?:\.(\d+))?\s*$', 3) AS DOUBLE)
       + CASE WHEN regexp_extract({t}, '^\s*(\d+):(\d{{1,2}}):(\d{{1,2}})(?:\.(\d+))?\s*$', 4) = '' THEN 0
              ELSE CAST('0.' || regexp_extract({t}, '^\s*(\d+):(\d{{1,2}}):(\d{{1,2}})(?:\.(\d+))?\s*$', 4) AS DOUBLE) END END"""


@query("normalized_utterances", "S5 S6 K1", rounded(f"""
    WITH m AS (SELECT {MESSY} FROM conversations),
    n AS (SELECT session_id, utterance_id, lower(trim(coalesce(role, 'unknown'))) AS role, coalesce(content, '') AS content,
                 try_cast(utterance_id AS DOUBLE) AS utterance_idx, {TIME_SQL.format(t='timestamp')} AS t_seconds FROM m)
    SELECT session_id, utterance_id, role, md5(content) AS content_md5, utterance_idx, t_seconds,
           row_number() OVER (PARTITION BY session_id ORDER BY utterance_idx NULLS LAST, t_seconds NULLS LAST,
                              utterance_id, role, content) - 1 AS pos,
           count(*) OVER (PARTITION BY session_id) AS n_rows FROM n""", "utterance_idx t_seconds"))
def _normalized(spark, sf_dir):
    raw = table(spark, sf_dir, "conversations").selectExpr(
        *[p.replace("VARCHAR", "STRING") for p in _split(MESSY)])
    return normalize(raw).selectExpr(
        "session_id", "utterance_id", "role", "md5(content) AS content_md5", "utterance_idx", "t_seconds", "pos", "n_rows")


def _split(text: str) -> list[str]:
    return [line.strip().rstrip(",") for line in text.strip().splitlines()]


STAMP = """CASE event_id % 6 WHEN 0 THEN '0:00:0' || (event_id % 10) WHEN 1 THEN ' ' || (event_id % 30) || ':75:61 '
    WHEN 2 THEN '1:2:3.' || (event_id % 1000) WHEN 3 THEN 'bad' WHEN 4 THEN '12:00:01:5' ELSE NULL END"""


@query("elapsed_times", "S6", rounded(
    f"SELECT event_id, {TIME_SQL.format(t='s')} AS t_seconds FROM (SELECT event_id, {STAMP} AS s FROM events)", "t_seconds"))
def _elapsed(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{STAMP} AS s")
    return rows.selectExpr("event_id", f"{elapsed_seconds('s')} AS t_seconds")


@query("full_and_smoke_file", "S2", """
    WITH s AS (SELECT 'orders_' || o_orderpriority || '.csv' AS source_file, count(*) AS n FROM orders GROUP BY 1)
    SELECT arg_max(source_file, n) AS full_file, max(n) AS full_rows, arg_min(source_file, n) AS smoke_file, min(n) AS smoke_rows FROM s""")
def _full_smoke(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("concat('orders_', o_orderpriority, '.csv') AS source_file")
    return full_and_smoke(rows)


@query("design_matrix", "B16 J4", rounded(f"""
    WITH {base_sql(SHORT, 'session_id')}, bst AS ({structure_sql(SHORT)}), bfb AS ({feedback_sql('session_id', 'fbs_')}),
    b AS (SELECT session_id || '-' || pos AS response_id, session_id FROM ({SHORT}) WHERE role = 'student')
    SELECT b.response_id, bst.*, bfb.* EXCLUDE (session_id) FROM b JOIN bst USING (session_id) JOIN bfb USING (session_id)""",
    STRUCT_COLUMNS + FBS))
def _matrix(spark, sf_dir):
    turns = short_utterances(spark, sf_dir)
    chunked = has_large_groups(turns)
    base = turns.where("role = 'student'").selectExpr("concat_ws('-', session_id, pos) AS response_id", "session_id")
    matrix, features = build_matrix(base, [
        ("structural", session_structure(turns, chunked), "session_id"),
        ("feedback", session_feedback(turns, chunked), "session_id"),
    ])
    return matrix.select("response_id", "session_id", *features)


#: Conversations dealt to sixty files: some of another kind, some with a line of too many cells, two headers.
FILES = 60
KIND = "CASE WHEN grp % 11 = 5 THEN 'no header' WHEN grp % 7 = 3 THEN 'broken' ELSE 'read' END"


def mixed_files(spark, sf_dir) -> str:
    """All conversations as mixed session files in the shared folder; gives the folder."""
    quoted = lambda c: f"concat('\"', replace({c}, '\"', '\"\"'), '\"')"
    one = f"concat_ws(',', conv_id, turn, role, {quoted('text')})"
    other = f"concat_ws(',', role, conv_id, {quoted('text')}, turn, '0:00:01')"
    turns = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "role", "coalesce(text, '') AS text", f"conv_id % {FILES} AS grp")
    lines = turns.selectExpr("grp", "1 AS ord", f"CASE WHEN grp % 11 = 5 THEN concat_ws(',', conv_id, turn) WHEN grp % 2 = 0 THEN {one} ELSE {other} END AS line")
    heads = turns.select("grp").distinct().selectExpr("grp", "0 AS ord", "CASE WHEN grp % 11 = 5 THEN 'x,y' "
        "WHEN grp % 2 = 0 THEN 'session_id,utterance_id,role,content' ELSE 'role,session_id,content,utterance_id,timestamp' END AS line")
    bad = heads.where(f"{KIND} = 'broken'").selectExpr("grp", "2 AS ord", "'1,2,3,4,5,6,7,8' AS line")
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex[:12]}"
    every = heads.union(lines).union(bad).repartition(FILES, "grp").sortWithinPartitions("grp", "ord")
    every.select("grp", "line").write.partitionBy("grp").text(folder)
    return folder


GROUPED = f"""
    g AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, conv_id % {FILES} AS grp FROM conversations),
    k AS (SELECT *, {KIND} AS status FROM g)"""


@query("transcript_file_status", "S1 S4", f"""
    WITH {GROUPED}, f AS (SELECT grp, status, count(*) AS n FROM k GROUP BY ALL)
    SELECT status, count(*) AS n_files, CAST(sum(CASE status WHEN 'read' THEN n WHEN 'broken' THEN n + 1 ELSE 0 END) AS BIGINT) AS n_rows,
           count(*) FILTER (status = 'broken') AS n_bad FROM f GROUP BY status""")
def _file_status(spark, sf_dir):
    _, status = consolidate_transcripts(spark, mixed_files(spark, sf_dir), "*.txt")
    return aggregate(status, ["status"], "count(1) AS n_files", "sum(n_rows) AS n_rows", "sum(n_bad) AS n_bad")


@query("consolidated_utterances", "S4 S5 S8", rounded(f"""
    WITH {GROUPED} SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS VARCHAR) AS utterance_id, lower(trim(role)) AS role,
           md5(text) AS content_md5, CASE WHEN grp % 2 = 1 THEN 1.0::DOUBLE END AS t_seconds,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM k WHERE status = 'read'""", "t_seconds"))
def _consolidated(spark, sf_dir):
    rows, _ = consolidate_transcripts(spark, mixed_files(spark, sf_dir), "*.txt")
    return normalize(rows).selectExpr("session_id", "utterance_id", "role", "md5(content) AS content_md5", "t_seconds", "pos")
