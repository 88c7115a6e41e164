"""Linguistic features per session (56 columns, prefix ``ling_``).

Bracket tags are blanked inside each utterance; a bracket left open at the end of one turn
is not closed by a later turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import text as X
from ..functions.scalars import safe_div
from ..operators.ordered import Sequence, aggregate, by_position, has_large_groups, scan
from ..operators.stats import histogram, robust_rows, robust_wide, row_ranks, slope
from ..session import cut

PER_UTTERANCE = ("q_rate", "excl_rate", "unclear_rate", "false_start_rate", "selfcorr_rate")
PER_WORD = ("hedge_rate", "affirm_rate", "negate_rate", "filler_rate")
KNOWN = "role IN (" + ", ".join(f"'{r}'" for r in X.ROLES) + ")"


def tokenized(utterances: DataFrame, *keep: str) -> DataFrame:
    """Utterances with ``low`` (lower case), ``bare`` (tags blanked) and ``tokens``."""
    return (
        utterances.selectExpr("session_id", *keep, "role", "coalesce(content, '') AS content")
        .selectExpr("*", "lower(content) AS low", f"{X.without_tags('content')} AS bare")
        .selectExpr("*", f"regexp_extract_all(bare, {X.lit(X.WORD)}, 0) AS tokens")
    )


def utterance_text_counts(utterances: DataFrame, *keep: str, words: bool = False) -> DataFrame:
    """Narrow per-utterance counts; the text itself is dropped here.

    ``keep`` names the order columns to carry (default ``pos``), so the counting can happen
    before rows are numbered and only numbers are shuffled.  ``words`` adds the distinct words, for
    a table that is written once and read by columns.
    """
    keep = keep or ("pos",)
    return tokenized(utterances, *keep).selectExpr(
        "session_id", *keep, "role",
        "length(content) AS len",
        "CAST(contains(content, '?') AS BIGINT) AS q_rate",
        "CAST(contains(content, '!') AS BIGINT) AS excl_rate",
        f"{X.regex_count('content', X.UNCLEAR)} AS unclear_rate",
        f"{X.regex_count('bare', X.FALSE_START)} AS false_start_rate",
        f"{X.regex_count('low', X.SELF_CORRECTION)} AS selfcorr_rate",
        f"{X.phrase_count('low', X.HEDGE)} AS hedge_rate",
        f"{X.phrase_count('low', X.AFFIRM)} AS affirm_rate",
        f"{X.phrase_count('low', X.NEGATE)} AS negate_rate",
        f"{X.phrase_count('low', X.FILLER)} AS filler_rate",
        f"{X.phrase_count('low', X.UNDERSTAND_CHECK)} AS check_rate",
        "CAST(size(tokens) AS BIGINT) AS n_words",
        f"CAST({X.adjacent_repeats('tokens')} AS BIGINT) AS repeats",
        "get(tokens, 0) AS first_word",
        "get(tokens, size(tokens) - 1) AS last_word",
        *(["array_distinct(tokens) AS words"] if words else []),
    )


def distinct_words(vocabulary: DataFrame) -> DataFrame:
    """Vocabulary size per session and role from ``words`` of each utterance, by counting each word's group."""
    seen = vocabulary.where(KNOWN).selectExpr("session_id", "role", "explode(words) AS word")
    return aggregate(seen.distinct(), ["session_id", "role"], "count(1) AS n_distinct")


def rates() -> dict[str, str]:
    """Role rates from the summed counts of a (session, role)."""
    out = {c: safe_div(c, "n_utt") for c in PER_UTTERANCE}
    out |= {c: f"{safe_div(c, 'greatest(n_words, 1)')} * 100D" for c in PER_WORD}
    out["check_rate"] = f"{safe_div('check_rate', 'n_utt')} * 100D"
    out["repetition_rate"] = (
        f"CASE WHEN n_words < 2 THEN 0D ELSE {safe_div('repeats + across', 'n_words - 1')} END"
    )
    out["mean_words"] = safe_div("n_words", "n_utt")
    out["type_token_ratio"] = safe_div("n_distinct", "n_words")
    return out


SUMS = (*PER_UTTERANCE, *PER_WORD, "check_rate", "n_words", "repeats")
SPREAD = ("words_median", "words_trimmean", "words_iqr", "words_p90")
TREND = ("ling_student_len_slope", "ling_student_len_r2", "ling_student_len_last_first_ratio")


def session_linguistics(utterances: DataFrame, chunked: bool | None = None,
                        counts: DataFrame | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """One row per session; the text is read and split once.

    ``utterances`` needs ``session_id, pos, role, content``.  Instead, ``counts`` may bring already
    numbered ``utterance_text_counts`` and ``vocabulary`` their ``session_id, role, words``.
    """
    chunked = has_large_groups(utterances) if chunked is None else chunked
    if counts is None or vocabulary is None:
        read = cut(utterance_text_counts(utterances, words=True))
        counts, vocabulary = read.drop("words"), read.select("session_id", "role", "words")
    per_role, session = (_chunked_roles if chunked else _small_roles)(counts)
    valued = (
        per_role.join(distinct_words(vocabulary), ["session_id", "role"], "left")
        .fillna(0, subset=["n_distinct"])
        .selectExpr("session_id", "role", *SPREAD, *[f"{e} AS {c}" for c, e in rates().items()])
    )
    wide = aggregate(
        valued, ["session_id"],
        *[
            f"coalesce(max(CASE WHEN role = '{r}' THEN {c} END), 0D) AS ling_{r}_{c}"
            for r in X.ROLES
            for c in (*rates(), *SPREAD)
        ],
    )
    ratio = safe_div("ling_student_q_rate", "ling_tutor_q_rate")
    return session.join(wide, "session_id", "left").fillna(0.0).selectExpr(
        "*", f"{ratio} AS ling_q_ratio_student_tutor"
    )


def _small_roles(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Role sums and session trend from one pass of windows over small sessions."""
    by = "PARTITION BY session_id, role ORDER BY pos"
    spoken = "CASE WHEN n_words > 0 THEN last_word END"
    rows = counts.selectExpr(
        "*",
        f"last_value({spoken}) IGNORE NULLS OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before",
        f"row_number() OVER ({by}) - 1 AS i", "count(1) OVER (PARTITION BY session_id, role) AS k",
    ).selectExpr("*", *row_ranks(["session_id", "role"], "n_words", "w", "true"))
    per_role = aggregate(
        rows, ["session_id", "role"], "count(1) AS n_utt", *[f"sum({c}) AS {c}" for c in SUMS],
        "count_if(n_words > 0 AND before = first_word) AS across",
        *robust_rows("n_words", "w", "true", "words"), *trend_of(),
    )
    session = aggregate(
        per_role, ["session_id"],
        f"{safe_div('sum(unclear_rate)', 'sum(n_utt)')} AS ling_unclear_density_all",
        *[f"coalesce(max(CASE WHEN role = 'student' THEN {c} END), 0D) AS {c}" for c in TREND],
    )
    return per_role.where(KNOWN), session


def trend_of(minimum: int = 5) -> list[str]:
    """Slope, fit and last/first quarter ratio of ``len`` over rows numbered ``i`` of ``k``."""
    steep, fit = slope("len", "i", minimum)
    quarter = "greatest(k div 4, 1)"
    last, first = f"avg(CASE WHEN i >= k - {quarter} THEN len END)", f"avg(CASE WHEN i < {quarter} THEN len END)"
    return [
        f"{steep} AS {TREND[0]}", f"{fit} AS {TREND[1]}",
        f"CASE WHEN count(1) >= {minimum} THEN {safe_div(last, first)} ELSE 0D END AS {TREND[2]}",
    ]


def _chunked_roles(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same from sessions of any size: counts are written once and read per statistic."""
    counts = cut(counts)
    known = counts.where(KNOWN)
    by_role = Sequence(("session_id", "role"), ("pos",), by_position(True).chunk)
    spoken = known.where("n_words > 0").select("session_id", "role", "pos", "first_word", "last_word")
    across = aggregate(
        scan(spoken, by_role, prev={"before": "last_word"}),
        ["session_id", "role"], "count_if(before = first_word) AS across",
    )
    turns = scan(
        counts.where("role = 'student'").select("session_id", "pos", "len"), by_position(True),
        running={"i": "1L"}, totals={"k": ("sum", "1L")},
    )
    spread = robust_wide(
        histogram(known, ["session_id", "role"], "n_words").selectExpr("*", "'w' AS measure"),
        ["session_id", "role"], "measure", {"w": "words"}, True,
    )
    per_role = (
        aggregate(known, ["session_id", "role"], "count(1) AS n_utt", *[f"sum({c}) AS {c}" for c in SUMS])
        .join(across, ["session_id", "role"], "left")
        .join(spread, ["session_id", "role"], "left")
        .fillna(0, subset=["across"])
    )
    overall = aggregate(
        counts, ["session_id"], f"{safe_div('sum(unclear_rate)', 'count(1)')} AS ling_unclear_density_all"
    )
    return per_role, overall.join(aggregate(turns, ["session_id"], *trend_of()), "session_id", "left")
