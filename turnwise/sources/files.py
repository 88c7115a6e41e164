"""Reading transcripts, responses, labels and run records; writing tables and predictions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.scalars import elapsed_seconds, lit
from ..functions.text import normalized_role
from ..operators.ordered import aggregate, has_large_groups, with_positions
from ..session import cut

LABEL_ALIASES = ("is_correct", "correct", "label")  # fixed values: accepted label columns
TRANSCRIPT_COLUMNS = ("session_id", "utterance_id", "role", "content", "timestamp")
CSV = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"'}


def canonical_label(df: DataFrame, aliases: Iterable[str] = LABEL_ALIASES) -> DataFrame:
    """Rename the first known label column to ``correct`` (double); fail if there is none."""
    for name in aliases:
        if name in df.columns:
            kept = [c for c in df.columns if c != name]
            return df.selectExpr(*kept, f"CAST({name} AS DOUBLE) AS correct")
    raise KeyError(f"no label column among {tuple(aliases)}; columns are {df.columns}")


def csv_headers(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """``file, columns`` of every CSV below a folder; only the first line of a file is split.

    Headers are small; the files themselves are read later, by group.
    """
    raw = (
        spark.read.format("text").option("wholetext", "false").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(path)
    )
    first = raw.selectExpr("_metadata.file_path AS file", "_metadata.file_block_start AS at", "value") \
        .where("at = 0")
    head = aggregate(
        first.selectExpr("file", "monotonically_increasing_id() AS line", "value"), ["file"],
        "min_by(value, line) AS header",
    )
    clean = "transform(split(header, ','), c -> trim(BOTH '\"' FROM trim(regexp_replace(c, '\\uFEFF', ''))))"
    return head.selectExpr("file", f"{clean} AS columns")


#: What the header of each logical table must have: all names, one of the names, a name with the prefix.
TABLES = {
    "features": {"all": ("response_id", "session_id"), "prefix": "learning_objective"},
    "labels": {"all": ("response_id",), "one_of": LABEL_ALIASES},
    "format": {"all": ("response_id", "probability")},
}


def logical_table(columns: str = "columns") -> str:
    """SQL: the logical table of a header array; the first of ``TABLES`` that fits, else null."""
    def fits(rule: dict) -> str:
        parts = [f"array_contains({columns}, {lit(c)})" for c in rule["all"]]
        if "one_of" in rule:
            parts.append(f"arrays_overlap({columns}, array({', '.join(map(lit, rule['one_of']))}))")
        if "prefix" in rule:
            parts.append(f"exists({columns}, c -> startswith(c, {lit(rule['prefix'])}))")
        return " AND ".join(parts)

    return "CASE " + " ".join(f"WHEN {fits(rule)} THEN {lit(name)}" for name, rule in TABLES.items()) + " END"


def read_csv_group(spark: SparkSession, path: str, columns: list[str], headers: DataFrame | None = None,
                   skip_broken: bool = False, pattern: str = "*.csv") -> DataFrame:
    """Files below ``path`` with one header, every column as text; ``headers`` (file, columns) picks them.

    Without ``headers`` every file is taken.  A file that breaks while it is read fails the job,
    because its first rows would otherwise pass for the whole file; ``skip_broken`` drops the rest of it.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    options = {**CSV, "enforceSchema": str(headers is not None).lower(), "ignoreCorruptFiles": str(skip_broken).lower(),
               "recursiveFileLookup": "true", "pathGlobFilter": pattern}
    rows = spark.read.options(**options).schema(schema).csv(path).selectExpr(
        "*", "url_decode(replace(_metadata.file_name, '+', '%2B')) AS source_file", "_metadata.file_path AS _file")
    if headers is not None:
        wanted = f"array({', '.join(map(lit, columns))})"
        rows = rows.join(headers.where(f"columns = {wanted}").selectExpr("file AS _file"), "_file", "left_semi")
    return rows.drop("_file")


def route_tables(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Route a folder of mixed CSVs to logical tables by header; also gives a table of problems.

    CSV columns bind by position, so the folder is read once per distinct header and the parts are
    united by name.  The driver sees the distinct headers; file names stay in Spark.
    """
    headers = csv_headers(spark, path).selectExpr("*", f"{logical_table()} AS kind")
    parts: dict[str, list[DataFrame]] = {}
    for row in headers.where("kind IS NOT NULL").select("kind", "columns").distinct().orderBy("kind", "columns").collect():
        parts.setdefault(row["kind"], []).append(read_csv_group(spark, path, list(row["columns"]), headers))
    tables = {}
    for kind, frames in parts.items():
        merged = frames[0]
        for frame in frames[1:]:
            merged = merged.unionByName(frame, allowMissingColumns=True)
        tables[kind] = merged
    absent = ", ".join(f"({lit(k)})" for k in TABLES if k not in tables)
    problems = headers.where("kind IS NULL").selectExpr("'header fits no table' AS problem", "file AS subject")
    if absent:
        problems = problems.unionByName(spark.sql(f"SELECT 'no file for table' AS problem, k AS subject FROM VALUES {absent} AS t(k)"))
    return tables, problems


def full_and_smoke(format_rows: DataFrame) -> DataFrame:
    """Tell two files of one schema apart by size: the largest is full, the smallest smoke."""
    sizes = aggregate(format_rows, ["source_file"], "count(1) AS n")
    return aggregate(
        sizes, [], "max_by(source_file, n) AS full_file", "max(n) AS full_rows",
        "CASE WHEN count(1) > 1 THEN min_by(source_file, n) END AS smoke_file",
        "CASE WHEN count(1) > 1 THEN min(n) END AS smoke_rows",
    )


def normalize(df: DataFrame, chunked: bool | None = None) -> DataFrame:
    """The one utterance table every block reads.

    Missing columns are added, roles lower-cased (null becomes ``unknown``), null text
    emptied, numeric order and elapsed seconds parsed, and the order made explicit as
    ``pos`` within the session (nulls last, ties by id, role and text) with ``n_rows``.
    """
    have = set(df.columns)
    pick = lambda c: f"CAST({c} AS STRING)" if c in have else "CAST(NULL AS STRING)"
    rows = df.selectExpr(
        f"{pick('session_id')} AS session_id", f"{pick('utterance_id')} AS utterance_id",
        f"{normalized_role(pick('role'))} AS role", f"coalesce({pick('content')}, '') AS content",
        f"{pick('timestamp')} AS timestamp", f"try_cast({pick('utterance_id')} AS DOUBLE) AS utterance_idx",
        f"{elapsed_seconds(pick('timestamp'))} AS t_seconds",
    )
    chunked = has_large_groups(rows, size="octet_length(content)") if chunked is None else chunked
    order = ("utterance_idx", "t_seconds", "utterance_id", "role", "content")
    return with_positions(rows, order, chunked)


def read_transcripts(spark: SparkSession, path: str, skip_broken: bool = False) -> DataFrame:
    """One CSV per session under ``path`` as raw utterances; a missing session id is the file stem.

    When all files share one header (the usual case) the folder is read as a whole; a mixed folder
    is read once per distinct header.  ``skip_broken``: see ``read_csv_group``.
    """
    headers = csv_headers(spark, path)
    distinct = [list(r["columns"]) for r in headers.select("columns").distinct().collect()]
    if not distinct:
        raise FileNotFoundError(f"no transcript CSV below {path}")
    merged: DataFrame | None = None
    for columns in sorted(distinct):
        part = read_csv_group(spark, path, columns, headers if len(distinct) > 1 else None, skip_broken)
        stem = "regexp_replace(source_file, '[.]csv$', '')"
        own = f"coalesce(session_id, {stem})" if "session_id" in columns else stem
        rest = [c for c in TRANSCRIPT_COLUMNS if c in columns and c != "session_id"]
        part = part.selectExpr(f"{own} AS session_id", *rest, "source_file")
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    return merged


def unread_files(spark: SparkSession, path: str, raw: DataFrame) -> DataFrame:
    """Non-empty CSV files below ``path`` that gave no rows (header only or unreadable)."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv").load(path)
        .selectExpr("url_decode(replace(regexp_extract(path, '[^/]+$', 0), '+', '%2B')) AS source_file")
    )
    return listed.join(raw.select("source_file").distinct(), "source_file", "left_anti")


def transcript_report(utterances: DataFrame) -> DataFrame:
    """Sessions, utterances and the roles seen."""
    per = aggregate(utterances, ["session_id"], "count(1) AS n", "collect_set(role) AS roles")
    return aggregate(
        per, [], "count(1) AS n_sessions", "sum(n) AS n_utterances",
        "array_sort(array_distinct(flatten(collect_set(roles)))) AS roles",
    )


def write_table(df: DataFrame, path: str, partitions: int | None = None, mode: str = "error") -> None:
    """Parquet with zstd; the commit protocol publishes all files or none."""
    out = df if partitions is None else df.repartition(partitions, "session_id")
    out.write.mode(mode).option("compression", "zstd").parquet(path)


def write_predictions(sunk: DataFrame, path: str, mode: str = "error") -> None:
    """Prediction CSV in the required order: range-sorted part files, read in name order."""
    sunk.orderBy("pos").select("response_id", "probability").write.mode(mode).option(
        "header", "true").csv(path)


RUN_SCHEMA = (
    "task STRING, ts STRING, tier STRING, wall_seconds DOUBLE, units DOUBLE, git_sha STRING, subsample BIGINT, "
    "metrics STRUCT<experiment: STRING, logloss: DOUBLE, auc: DOUBLE, delta_vs_lo_only: DOUBLE>"
)


def parse_runs(lines: DataFrame, column: str = "value") -> DataFrame:
    """Run records from JSON text; a line that is not a record of this shape is dropped."""
    parsed = lines.selectExpr(
        f"from_json({column}, '{RUN_SCHEMA}, _bad STRING', map('columnNameOfCorruptRecord', '_bad')) AS run")
    return parsed.where("run IS NOT NULL AND run._bad IS NULL").selectExpr("run.*").drop("_bad")


def read_runs(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Run manifests or ledger lines; unreadable records are dropped."""
    return spark.read.schema(RUN_SCHEMA).option("mode", "DROPMALFORMED").option(
        "multiLine", str(one_per_file).lower()).option("recursiveFileLookup", "true").json(path)


def transcript_status(raw: DataFrame, headers: DataFrame, listed: DataFrame) -> DataFrame:
    """``source_file, status, n_rows, n_bad``: what became of every file (its path).

    ``raw`` holds every line of the readable files with ``_bad``.  A file is ``read`` when all its lines fit
    its header, ``broken`` when one does not (it is then left out whole), ``no header`` when it has none of
    the transcript's columns, and ``empty`` when it has a header and nothing else.  Spark lists no file
    without a byte, so such files do not appear.
    """
    counted = aggregate(raw, ["source_file"], "count(1) AS n_rows", "count_if(_bad) AS n_bad")
    known = headers.selectExpr("source_file", f"arrays_overlap(columns, array({', '.join(map(lit, TRANSCRIPT_COLUMNS))})) AS _known")
    joined = listed.join(counted, "source_file", "left").join(known, "source_file", "left")
    return joined.selectExpr(
        "source_file",
        "CASE WHEN n_bad > 0 THEN 'broken' WHEN n_rows > 0 THEN 'read' WHEN NOT _known THEN 'no header' ELSE 'empty' END AS status",
        "coalesce(n_rows, 0L) AS n_rows", "coalesce(n_bad, 0L) AS n_bad")


def consolidate_transcripts(spark: SparkSession, path: str, pattern: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """All session files below ``path`` as raw utterances, and ``transcript_status`` of every file.

    A file with a line of too many or too few cells, or with a quote left open, is left out whole and
    counted, so one bad file neither stops the job nor passes with a part of its rows.  Files are parsed
    once, written, and judged from what was written; nothing of a file reaches the driver but the
    distinct headers.
    """
    # readers differ in how they write the same path
    name = "regexp_replace(url_decode(replace({}, '+', '%2B')), '^([A-Za-z0-9]+):/+', '$1:/')"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    listed = files.selectExpr(f"{name.format('path')} AS source_file")
    headers = csv_headers(spark, path, pattern).selectExpr("file", "columns", f"{name.format('file')} AS source_file")
    known = f"arrays_overlap(columns, array({', '.join(map(lit, TRANSCRIPT_COLUMNS))}))"
    merged: DataFrame | None = None
    for row in headers.where(known).select("columns").distinct().orderBy("columns").collect():
        columns = list(row["columns"])
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_corrupt"]])
        options = {**CSV, "recursiveFileLookup": "true", "pathGlobFilter": pattern, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
        rows = spark.read.options(**options).schema(schema).csv(path).selectExpr("*", "_metadata.file_path AS _file")
        wanted = f"array({', '.join(map(lit, columns))})"
        rows = rows.join(headers.where(f"columns = {wanted}").selectExpr("file AS _file", "source_file"), "_file")
        stem = "regexp_replace(regexp_extract(source_file, '[^/]+$', 0), '[.][^.]*$', '')"
        session = f"coalesce(session_id, {stem})" if "session_id" in columns else stem
        rest = [c for c in TRANSCRIPT_COLUMNS if c in columns and c != "session_id"]
        part = rows.selectExpr(f"{session} AS session_id", *rest, "source_file", "_corrupt IS NOT NULL AS _bad")
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    if merged is None:
        raise FileNotFoundError(f"no transcript CSV below {path}")
    raw = cut(merged)
    status = cut(transcript_status(raw, headers, listed))
    whole = raw.join(status.where("status = 'read'").select("source_file"), "source_file", "left_semi")
    return whole.drop("_bad"), status
