"""How the driver tables are read as sessions, utterances and responses.

* short sessions  ``conversations``: one session per conversation
* long sessions   ``documents``: one session per source, ordered by document
* timed sessions  ``events``: one session per calendar day
* responses       ``orders``: customer = session, order month = objective
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import content_words
from ..operators.ordered import aggregate, has_large_groups, spread, with_positions
from ..operators.retrieval import parts_for, unit, with_word_before
from ..plans.dialogue import labelled_turns
from ..session import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns are numbered from zero without gaps, so ``turn`` is the position."""
    return spread(table(spark, sf_dir, "conversations")).selectExpr(
        "CAST(conv_id AS STRING) AS session_id",
        "turn AS pos",
        "CASE role WHEN 'user' THEN 'student' WHEN 'assistant' THEN 'tutor' "
        "ELSE 'background' END AS role",
        "coalesce(text, '') AS content",
    )


SHORT = """
    SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS pos,
           CASE role WHEN 'user' THEN 'student' WHEN 'assistant' THEN 'tutor'
                     ELSE 'background' END AS role,
           coalesce(text, '') AS content
    FROM conversations"""


def long_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as turns of their source, not numbered yet; ordered by ``doc_id``."""
    return spread(table(spark, sf_dir, "documents").select("source", "doc_id", "text")).selectExpr(
        "source AS session_id",
        "doc_id",
        "element_at(array('tutor', 'student', 'background'), CAST(doc_id % 3 + 1 AS INT)) AS role",
        "coalesce(text, '') AS content",
    )


def numbered(spark: SparkSession, sf_dir: str, rows: DataFrame, wide: bool = False) -> tuple[DataFrame, bool]:
    """Number document rows and tell whether any session is too large for one task; ``wide``: rows carry text."""
    keys = table(spark, sf_dir, "documents").selectExpr("source AS session_id", "n_chars")
    chunked = has_large_groups(keys, size="4 * n_chars" if wide else None)
    return with_positions(rows, ("doc_id",), chunked), chunked


def long_utterances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, bool]:
    """Utterances with their text in document order, and the size flag."""
    return numbered(spark, sf_dir, long_rows(spark, sf_dir), wide=True)


LONG = """
    SELECT source AS session_id, doc_id,
           row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
           count(*) OVER (PARTITION BY source) AS n_rows,
           CASE doc_id % 3 WHEN 0 THEN 'tutor' WHEN 1 THEN 'student' ELSE 'background' END AS role,
           coalesce(text, '') AS content
    FROM documents"""


def timed_utterances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, bool]:
    """Seconds since midnight of the day; the session starts at its first event."""
    raw = table(spark, sf_dir, "events").selectExpr(
        "date_format(ts, 'yyyy-MM-dd') AS session_id",
        "event_id",
        "CASE WHEN event_type IN ('view', 'click') THEN 'tutor' "
        "WHEN event_type IN ('purchase', 'signup') THEN 'student' ELSE 'background' END AS role",
        "CAST(hour(ts) * 3600 + minute(ts) * 60 AS DOUBLE) "
        "+ CAST(extract(SECOND FROM ts) AS DOUBLE) AS t_seconds",
    )
    chunked = has_large_groups(raw)
    return with_positions(raw, ("t_seconds", "event_id"), chunked, bucket_width=600), chunked


TIMED = """
    SELECT strftime(ts, '%Y-%m-%d') AS session_id, event_id,
           CASE WHEN event_type IN ('view', 'click') THEN 'tutor'
                WHEN event_type IN ('purchase', 'signup') THEN 'student'
                ELSE 'background' END AS role,
           CAST(extract('hour' FROM ts) * 3600 + extract('minute' FROM ts) * 60 AS DOUBLE)
             + CAST(extract('microsecond' FROM ts) // 1000000 AS DOUBLE)
             + (extract('microsecond' FROM ts) % 1000000) / 1e6 AS t_seconds,
           row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) - 1 AS pos
    FROM events"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per response with a label and two fixed score expressions."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS response_id",
        "o_custkey AS session_id",
        "date_format(o_orderdate, 'yyyy-MM') AS objective_id",
        "o_orderpriority AS slice_value",
        "CASE WHEN o_orderstatus = 'F' THEN 1D ELSE 0D END AS label",
        "0.05D + 0.55D * ((o_orderkey % 97) / 97.0D) "
        "+ CASE WHEN o_orderstatus = 'F' THEN 0.2D ELSE 0D END AS pred",
        "1D / (1D + exp(-(o_totalprice / 250000.0D - 1D))) AS pred_b",
        "o_totalprice AS price",
    )


RESPONSES = """
    SELECT o_orderkey AS response_id, o_custkey AS session_id,
           strftime(o_orderdate, '%Y-%m') AS objective_id, o_orderpriority AS slice_value,
           CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS label,
           (0.05::DOUBLE + 0.55::DOUBLE * ((o_orderkey % 97) / 97.0::DOUBLE)
             + CASE WHEN o_orderstatus = 'F' THEN 0.2 ELSE 0.0 END::DOUBLE) AS pred,
           (1.0::DOUBLE / (1.0::DOUBLE + exp(-(o_totalprice / 250000.0::DOUBLE - 1.0::DOUBLE)))) AS pred_b,
           o_totalprice AS price
    FROM orders"""

# Function words removed before matching topics; the list is a parameter of the operator.
STOPWORDS = (
    "the", "and", "of", "to", "in", "is", "it", "that", "for", "on", "as", "with", "are",
    "this", "an", "or", "be", "at", "by", "not",
)


def topic_utterances(spark: SparkSession, sf_dir: str, labelled: bool = False) -> tuple[DataFrame, bool]:
    """Long sessions with a sparse clock: three seconds per document id, some unknown.

    Words, and with ``labelled`` the turn labels, are computed before the rows are numbered, and written
    once.  A session has a twentieth of all text, so text and words stay out of the windows: rows are
    numbered by their keys and last words, and a row's place (``pos``, ``n_rows``, ``before``) is joined back.
    """
    raw = long_rows(spark, sf_dir)
    if labelled:
        raw = labelled_turns(raw, "doc_id", "content")
    raw = raw.selectExpr("*", f"{content_words('content', STOPWORDS)} AS tokens")
    return placed(spark, sf_dir, cut(raw.selectExpr("*", "monotonically_increasing_id() AS _row")))


def placed(spark: SparkSession, sf_dir: str, written: DataFrame) -> tuple[DataFrame, bool]:
    """Written rows with their places and clock, and the size flag; no window holds their text or words."""
    narrow, chunked = numbered(spark, sf_dir, written.selectExpr(
        "session_id", "doc_id", "_row", "CASE WHEN size(tokens) > 0 THEN element_at(tokens, -1) END AS last"))
    places = with_word_before(narrow, chunked).select("_row", "pos", "n_rows", "before")
    clock = "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id * 3D END AS t_seconds"
    parts = text_parts(spark, sf_dir)
    met = written.repartition(parts, "_row").join(places.repartition(parts, "_row"), "_row")
    return met.drop("_row").selectExpr("*", clock), chunked


def text_parts(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that count the terms of ``documents``, by its characters."""
    return parts_for(spark, table(spark, sf_dir, "documents").agg({"n_chars": "sum"}).first()[0])


TOPIC = f"""
    SELECT *, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id * 3.0::DOUBLE END AS t_seconds
    FROM ({LONG}) AS _long"""


def objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").selectExpr(
        "item_id AS objective_id", "text AS objective_text"
    )


def topic_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which objectives each source is assessed on: two residue classes of the item id.

    Every fifth item is assessed twice, so some pairs have two responses.
    """
    sources = table(spark, sf_dir, "documents").groupBy("source").count().selectExpr(
        "source AS session_id", "count AS n_rows", "CAST(substr(source, 4) AS BIGINT) % 20 AS cls"
    )
    items = table(spark, sf_dir, "benchmark").selectExpr(
        "item_id AS objective_id",
        "explode(array(item_id % 20, (item_id + 7) % 20)) AS cls",
    )
    return sources.join(items, "cls").selectExpr(
        "session_id", "objective_id", "n_rows",
        "explode(CASE WHEN objective_id % 5 = 0 THEN array(0, 1) ELSE array(0) END) AS copy",
    ).selectExpr(
        "concat_ws('-', session_id, objective_id, copy) AS response_id",
        "session_id", "objective_id", "n_rows",
    )


TOPIC_RESPONSES = """
    SELECT source || '-' || item_id || '-' || copy AS response_id, source AS session_id,
           item_id AS objective_id, n_rows
    FROM (SELECT source, count(*) AS n_rows, CAST(substr(source, 4) AS BIGINT) % 20 AS cls
          FROM documents GROUP BY source) AS s
    JOIN benchmark ON item_id % 20 = cls OR (item_id + 7) % 20 = cls
    JOIN (SELECT 0 AS copy UNION ALL SELECT 1) AS c ON copy = 0 OR item_id % 5 = 0"""


def topic_pairs(responses_: DataFrame) -> DataFrame:
    return responses_.select("session_id", "objective_id", "n_rows").distinct()


def vector_windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, bool]:
    """Stored vectors as passages: one session per label, ordered by vector id."""
    raw = table(spark, sf_dir, "embeddings").selectExpr(
        "CAST(label AS BIGINT) AS session_id", "vec_id", "embedding"
    )
    chunked = has_large_groups(raw)
    placed = with_positions(raw, ("vec_id",), chunked)
    return placed.selectExpr(
        "session_id", "pos AS window_idx", "n_rows AS n_windows",
        f"{unit('embedding')} AS vector",
    ), chunked


def vector_objectives(spark: SparkSession, sf_dir: str, dims: int = 64) -> DataFrame:
    """One objective per label: the normalised mean of its vectors."""
    means = ", ".join(f"avg(CAST(embedding[{i}] AS DOUBLE))" for i in range(dims))
    mean = aggregate(
        table(spark, sf_dir, "embeddings").selectExpr("CAST(label AS BIGINT) AS objective_id", "embedding"),
        ["objective_id"], f"array({means}) AS vector",
    )
    return mean.selectExpr("objective_id", f"{unit('vector')} AS vector")


def vector_pairs(windows: DataFrame) -> DataFrame:
    """Each label's session is assessed on its own and the next label's objective."""
    return windows.select("session_id").distinct().selectExpr(
        "session_id", "explode(array(session_id, (session_id + 1) % 10)) AS objective_id"
    )


VECTORS = """
    vw AS (SELECT CAST(label AS BIGINT) AS session_id,
                  row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS window_idx,
                  count(*) OVER (PARTITION BY label) AS n_windows,
                  list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    vn AS (SELECT session_id, window_idx, n_windows,
                  list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS v FROM vw),
    vm AS (SELECT session_id AS objective_id, d, avg(e[d]) AS x
           FROM vw, (SELECT unnest(range(1, 65)) AS d) GROUP BY ALL),
    vo0 AS (SELECT objective_id, list(x ORDER BY d) AS e FROM vm GROUP BY objective_id),
    vo AS (SELECT objective_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS o FROM vo0),
    vs AS (SELECT session_id, objective_id, window_idx, n_windows, list_inner_product(v, o) AS sim, v
           FROM vn JOIN vo ON objective_id = session_id OR objective_id = (session_id + 1) % 10)"""
