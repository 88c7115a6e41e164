"""Relevance of session passages to objectives: lexical (TF-IDF) and dense vectors.

Everything is scored per distinct ``(session_id, objective_id)``; responses that share one
read the same result.
"""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import content_words, with_bigrams
from ..session import cut
from .ordered import CHUNK_ROWS, Sequence, aggregate, by_position, scan, small_side
from .stats import gini
from .windows import SIZE, STRIDE, TOP_K, window_count, window_end, window_start, windows_holding

PAIR = ["session_id", "objective_id"]
CELL = 12  # passages of a session that one task counts together
PART_BYTES = 4 << 20  # text whose terms one task counts


def parts_for(spark: SparkSession, n_bytes: int | None) -> int:
    """Tasks for so much text, so that what one of them holds does not grow with the input."""
    return max(spark.sparkContext.defaultParallelism, -(-(n_bytes or 0) // PART_BYTES))


def term_counts(texts: DataFrame, keys: list[str], stopwords: Seq[str], *carried: str) -> DataFrame:
    """``keys, term, tf`` for word 1-2 grams of ``content``."""
    words = texts.selectExpr(*keys, f"{content_words('content', stopwords)} AS tokens")
    exploded = words.selectExpr(*keys, f"explode({with_bigrams('tokens')}) AS term")
    return aggregate(exploded, [*keys, "term"], "count(1) AS tf")


def fit_idf(objectives: DataFrame, stopwords: Seq[str]) -> DataFrame:
    """Smoothed inverse document frequency over the distinct objective texts."""
    texts = objectives.selectExpr("objective_text AS content").where("content IS NOT NULL").distinct()
    total = aggregate(texts, [], "count(1) AS n").scalar()
    per_text = texts.selectExpr(
        f"explode(array_distinct({with_bigrams(content_words('content', stopwords))})) AS term"
    )
    return (
        aggregate(per_text, ["term"], "count(1) AS df")
        .withColumn("n_docs", total)
        .selectExpr("term", "ln((1 + n_docs) / (1 + df)) + 1 AS idf")
    )


def tfidf(counts: DataFrame, idf: DataFrame, keys: list[str]) -> DataFrame:
    """Unit-length vectors over the fitted vocabulary: ``keys, term, weight``.

    The norm covers vocabulary terms only; the window is one text wide.
    """
    return unit_weights(counts.join(idf, "term").selectExpr(*keys, "term", "(1 + ln(tf)) * idf AS w"), keys)


def unit_weights(raw: DataFrame, keys: list[str]) -> DataFrame:
    """``w`` divided by the length of its text's vector."""
    norm = f"sqrt(sum(w * w) OVER (PARTITION BY {', '.join(keys)}))"
    return raw.selectExpr(*keys, "term", f"w / {norm} AS weight")


def objective_vectors(objectives: DataFrame, idf: DataFrame, stopwords: Seq[str]) -> DataFrame:
    texts = objectives.selectExpr("objective_id", "coalesce(objective_text, '') AS content")
    return tfidf(term_counts(texts, ["objective_id"], stopwords), idf, ["objective_id"])


def with_word_before(rows: DataFrame, chunked: bool) -> DataFrame:
    """``before``: place and ``last`` word of the last row before that has words."""
    return scan(rows, by_position(chunked), peak={"before": "CASE WHEN last IS NOT NULL THEN struct(pos, last AS word) END"})


def passage_term_counts(
    utterances: DataFrame, idf: DataFrame, stopwords: Seq[str], chunked: bool = False,
    size: int = SIZE, stride: int = STRIDE, parts: int | None = None,
) -> DataFrame:
    """``session_id, cell, window_idx, term, tf, idf`` of every passage, vocabulary terms only.

    Passage texts are never built.  A term lies in one utterance, or a pair of words spans
    the border to the last wordful utterance before it; either way it occupies positions
    ``low..high`` and counts for the passages that hold both.  The vocabulary filter comes
    before the first shuffle of terms.  Rows may bring their ``tokens`` already split, and ``before``
    (see ``with_word_before``), so that no window holds their words.

    A row moves once, unexploded, to the ``cell`` of ``CELL`` passages it lies in (or two at a border).
    Terms are counted and weighed there: ``parts`` tasks (see ``parts_for``), each as small as its rows.
    """
    split = "tokens" if "tokens" in utterances.columns else f"{content_words('content', stopwords)} AS tokens"
    known = ["before"] if "before" in utterances.columns else []
    linked = utterances.selectExpr("session_id", "pos", "n_rows", split, *known)
    if not known:
        last = "CASE WHEN size(tokens) > 0 THEN element_at(tokens, -1) END AS last"
        linked = with_word_before(linked.selectExpr("*", last), chunked)
    holding = windows_holding("pos", "pos", "n_rows", size, stride)
    celled = linked.selectExpr("*", f"explode(array_distinct(transform({holding}, w -> w div {CELL}))) AS cell")
    moved = celled.repartition(*([parts] if parts else []), "session_id", "cell")
    inside = f"transform({with_bigrams('tokens')}, t -> struct(t AS term, pos AS low))"
    border = (
        "CASE WHEN size(tokens) > 0 AND before IS NOT NULL "
        "THEN array(struct(concat_ws(' ', before.word, tokens[0]) AS term, before.pos AS low)) "
        "ELSE filter(array(struct('' AS term, pos AS low)), x -> false) END"
    )
    items = moved.selectExpr(
        "session_id", "cell", "pos AS high", "n_rows", f"explode(concat({inside}, {border})) AS item"
    ).selectExpr("session_id", "cell", "high", "n_rows", "item.term", "item.low")
    placed = items.join(small_side(idf), "term").selectExpr(
        "session_id", "cell", "term", "idf",
        f"explode({windows_holding('low', 'high', 'n_rows', size, stride)}) AS window_idx",
    ).where(f"window_idx div {CELL} = cell")
    return aggregate(
        placed, ["session_id", "cell", "window_idx", "term"], "count(1) AS tf", "max(idf) AS idf"
    )


def lexical_similarity(
    utterances: DataFrame,
    pairs: DataFrame,
    objectives: DataFrame,
    stopwords: Seq[str],
    chunked: bool = False,
    size: int = SIZE,
    stride: int = STRIDE,
    chunk_windows: int = CHUNK_ROWS,
    parts: int | None = None,
) -> DataFrame:
    """Non-zero cosines ``session_id, objective_id, window_idx, sim``.

    Sparse join on the shared term.  For very long sessions the join key also carries a
    window chunk, and the session's objectives are repeated per chunk, so no key collects
    all windows of a session.
    """
    idf = cut(fit_idf(objectives, stopwords))  # read by three joins
    counts = passage_term_counts(utterances, idf, stopwords, chunked, size, stride, parts)
    passages = unit_weights(
        counts.selectExpr("session_id", "cell", "window_idx", "term", "(1 + ln(tf)) * idf AS w"),
        ["session_id", "cell", "window_idx"],
    ).drop("cell")
    wanted = pairs.join(
        objective_vectors(objectives, idf, stopwords).withColumnRenamed("weight", "o_weight"),
        "objective_id",
    )
    on = ["session_id", "term"]
    if chunked:
        passages = passages.selectExpr("*", f"window_idx div {chunk_windows} AS wcell")
        cells = passages.select("session_id", "wcell").distinct()
        wanted = wanted.join(cells, "session_id")
        on.append("wcell")
    return aggregate(
        passages.join(wanted, on), [*PAIR, "window_idx"], "sum(weight * o_weight) AS sim"
    )


def dot(a: str, b: str) -> str:
    """Inner product of two equal-length arrays, in double precision."""
    return (
        f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, "
        "(acc, v) -> acc + v)"
    )


def unit(vector: str) -> str:
    """The vector divided by its Euclidean length (unchanged when that is zero).

    The length is a value of the outer function's argument, so it is taken once per vector and not
    once per component.
    """
    return (
        f"element_at(transform(array(struct({vector} AS v, sqrt({dot(vector, vector)}) AS size)), "
        "p -> transform(p.v, x -> CASE WHEN p.size = 0 THEN 0D ELSE CAST(x AS DOUBLE) / p.size END)), 1)"
    )


def dense_similarity(
    windows: DataFrame, pairs: DataFrame, objectives: DataFrame, chunked: bool = False,
    chunk_windows: int = CHUNK_ROWS,
) -> DataFrame:
    """Cosine of every session passage with every objective of its session.

    ``windows(session_id, window_idx, vector)``, ``objectives(objective_id, vector)``, both
    unit length.  Other columns of ``windows`` are kept.
    """
    carried = [c for c in windows.columns if c not in (*PAIR, "window_idx", "vector")]
    wanted = pairs.join(objectives.withColumnRenamed("vector", "o_vector"), "objective_id")
    on, left = ["session_id"], windows
    if chunked:
        cell = f"window_idx div {chunk_windows} AS wcell"
        left = windows.selectExpr("*", cell)
        wanted = wanted.join(left.select("session_id", "wcell").distinct(), "session_id")
        on.append("wcell")
    return left.join(wanted, on).selectExpr(
        *PAIR, "window_idx", f"{dot('vector', 'o_vector')} AS sim", "vector", *carried
    )


def top_windows(
    sims: DataFrame, pairs: DataFrame, k: int = TOP_K, size: int = SIZE, stride: int = STRIDE
) -> DataFrame:
    """The ``k`` best passages per pair, ties to the lowest index, as ``rank`` 1..k.

    ``pairs`` carries ``n_rows``.  ``sims`` may hold only the non-zero scores: a pair with
    fewer than ``k`` of them is filled from its first passages, and ``2k - 1`` candidates
    always suffice because fewer than ``k`` of those can already be scored.
    """
    count = window_count("n_rows", size, stride)
    zero = pairs.selectExpr(
        *PAIR, f"explode(sequence(0L, least({count}, {2 * k - 1}L) - 1)) AS window_idx", "0D AS sim"
    )
    scored = aggregate(
        sims.select(*PAIR, "window_idx", "sim").unionByName(zero), [*PAIR, "window_idx"],
        "max(sim) AS sim",
    )
    best = scored.selectExpr(
        "*", f"row_number() OVER (PARTITION BY {', '.join(PAIR)} ORDER BY sim DESC, window_idx) AS rank"
    ).where(f"rank <= {k}")
    return best.join(pairs.select(*PAIR, "n_rows"), PAIR).selectExpr(
        *PAIR, "rank", "window_idx", "sim", "n_rows",
        f"{window_start('window_idx', 'n_rows', size, stride)} AS w_start",
        f"{window_end('window_idx', 'n_rows', size, stride)} AS w_end",
    )


def similarity_summary(
    sims: DataFrame, pairs: DataFrame, chunked: bool = False, size: int = SIZE, stride: int = STRIDE
) -> DataFrame:
    """Max, mean, population deviation, sum, share above half of the max, count, Gini.

    Works on the histogram of scores; passages without a row in ``sims`` count as zero.
    """
    sized = pairs.selectExpr(*PAIR, f"{window_count('n_rows', size, stride)} AS n_windows")
    hist = aggregate(
        sims.selectExpr(*PAIR, "sim AS value"), [*PAIR, "value"], "count(1) AS cnt"
    ).join(sized, PAIR)
    seq = Sequence(tuple(PAIR), ("value",), ("floor(value * 256)",) if chunked else ())
    rows = scan(hist, seq, totals={"top": ("max", "value")})
    mean = "sum(value * cnt) / max(n_windows)"
    moments = aggregate(
        rows, PAIR,
        "max(value) AS raw_max",
        f"{mean} AS sim_mean",
        f"sqrt(greatest(sum(value * value * cnt) / max(n_windows) - pow({mean}, 2), 0D)) AS sim_std",
        "sum(value * cnt) AS sim_sum",
        "CASE WHEN max(top) > 0 THEN sum(CASE WHEN value >= 0.5D * top THEN cnt ELSE 0 END) "
        "/ max(n_windows) ELSE 0D END AS sim_frac_above_half_max",
        "sum(cnt) AS scored",
    )
    spread = gini(hist, PAIR, "n_windows", chunked)
    out = sized.join(moments, PAIR, "left").join(spread, PAIR, "left")
    return out.selectExpr(
        *PAIR, "n_windows",
        "CASE WHEN scored IS NULL THEN 0D WHEN scored < n_windows THEN greatest(raw_max, 0D) "
        "ELSE raw_max END AS sim_max",
        *[f"coalesce({c}, 0D) AS {c}" for c in
          ("sim_mean", "sim_std", "sim_sum", "sim_frac_above_half_max")],
        "coalesce(gini, 0D) AS sim_gini",
    )
