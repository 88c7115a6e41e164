"""Corpus and label summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.scalars import log_loss, safe_div, token_estimate
from ..functions.text import UNCLEAR, regex_count
from ..operators.ordered import aggregate
from ..operators.stats import describe, histogram, quantile, ranked


def role_profile(utterances: DataFrame, long_share: float = 0.01, long_chars: int = 200) -> DataFrame:
    """What each role's speech looks like, and whether it holds substantive turns.

    Distinct strings are counted by hash group, so a role holding most rows is spread over
    the string values instead of one task.
    """
    rows = utterances.selectExpr(
        "role", "length(content) AS len", f"{regex_count('content', UNCLEAR)} AS unclear", "content"
    )
    long_turns = f"avg(CASE WHEN len > {long_chars} THEN 1D ELSE 0D END)"
    basics = aggregate(
        rows, ["role"],
        "count(1) AS n_utterances", "avg(len) AS mean_chars", "max(len) AS max_chars",
        f"{long_turns} AS frac_long", "sum(unclear) / count(1) AS unclear_rate",
        f"CASE WHEN {long_turns} > {long_share} THEN 'contains_real_speech' "
        "ELSE 'likely_noise_only' END AS verdict",
    )
    distinct = aggregate(
        rows.select("role", "content").distinct(), ["role"], "count(content) AS n_distinct_strings"
    )
    middle = aggregate(
        ranked(histogram(rows, ["role"], "len"), ["role"], chunked=True), ["role"],
        f"{quantile(0.5)} AS median_chars",
    )
    share = safe_div("n_utterances", "sum(n_utterances) OVER ()")
    return (
        basics.join(distinct, "role").join(middle, "role")
        .selectExpr("*", f"{share} AS share_of_utterances")
    )


def variance_decomposition(responses: DataFrame, label: str = "label", group: str = "session_id") -> DataFrame:
    """How much label variance lies inside sessions, and what a session-only model can reach.

    Labels are 0/1, so a session's variance and its best log loss follow from its size and
    positive count: everything is an aggregate of one row per session.
    """
    per = aggregate(responses, [group], "count(1) AS n", f"sum({label}) AS s").selectExpr(
        "n", "s", "s / n AS m"
    )
    floor = "greatest(least(m, 1D - 1e-15D), 1e-15D)"
    rate = "(sum(s) / sum(n))"
    total = f"({rate} * (1D - {rate}))"
    mixed = "n > 1 AND m > 0 AND m < 1"
    return aggregate(
        per, [],
        "sum(n) AS n_responses", "count(1) AS n_sessions", "count_if(n > 1) AS n_multi_sessions",
        "count_if(n > 1) / count(1) AS frac_multi_sessions",
        "coalesce(sum(CASE WHEN n > 1 THEN n END), 0) / sum(n) AS frac_responses_in_multi",
        f"count_if({mixed}) AS n_mixed_sessions",
        f"{safe_div(f'count_if({mixed})', 'count_if(n > 1)')} AS frac_mixed_sessions",
        "sum(n * m * (1D - m)) / sum(n) AS within_variance",
        f"{total} AS total_variance",
        f"{safe_div('sum(n * m * (1D - m)) / sum(n)', total)} AS within_over_total",
        f"{log_loss(rate, rate)} AS prior_logloss",
        f"sum(-(s * ln({floor}) + (n - s) * ln(1D - {floor}))) / sum(n) AS oracle_logloss",
    )


def dataset_overview(responses: DataFrame, labels: DataFrame, missing: dict[str, str]) -> DataFrame:
    """Counts, distinct sessions and objectives, label balance and missingness, in one row.

    Distinct counts come from distinct pairs, not from one wide set per task.
    """
    joined = responses.join(labels, "response_id", "left")
    out = aggregate(
        joined, [], "count(1) AS n_responses", "avg(label) AS label_positive_rate",
        "count_if(label IS NULL) AS n_missing_label",
        *[f"avg(CASE WHEN {c} IS NULL THEN 1D ELSE 0D END) AS {name}" for c, name in missing.items()],
    )
    for column, name in (("session_id", "n_sessions"), ("objective_id", "n_objectives")):
        distinct = aggregate(responses.select(column).distinct(), [], f"count({column}) AS n")
        out = out.withColumn(name, distinct.scalar())
    return out


def session_statistics(utterances: DataFrame) -> DataFrame:
    """Sizes of every session; the token count is estimated from its length."""
    rows = utterances.selectExpr("session_id", "role", "length(content) AS len", "t_seconds")
    of = lambda r: f"coalesce(sum(CASE WHEN role = '{r}' THEN len END), 0)"
    return aggregate(
        rows, ["session_id"],
        "count(1) AS n_utterances", "sum(len) AS n_chars", f"{token_estimate('sum(len)')} AS n_tokens",
        "count_if(role = 'student') AS n_student_utt", "count_if(role = 'tutor') AS n_tutor_utt",
        f"{of('student')} AS student_chars", f"{of('tutor')} AS tutor_chars",
        "max(t_seconds) AS duration_s",
    )


def corpus_summary(stats: DataFrame) -> DataFrame:
    """Distribution of the session sizes, one row per measure."""
    measures = ("n_tokens", "n_chars", "n_utterances", "duration_s")
    pairs = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in measures)
    long = stats.selectExpr(f"stack({len(measures)}, {pairs}) AS (measure, x)")
    totals = aggregate(long, ["measure"], "sum(x) AS total")
    return describe(long, ["measure"], "x").join(totals, "measure")
