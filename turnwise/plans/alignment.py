"""Objective-alignment features (17 columns, prefix ``lo_``) and topic-scoped dialogue."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import text as X
from ..functions.scalars import safe_div
from ..operators.ordered import aggregate
from ..operators.retrieval import PAIR, similarity_summary
from ..operators.windows import SIZE, STRIDE, merge_spans, span_positions
from .dialogue import dialogue_base, feedback_columns, labelled_or_label, trajectory_columns

ALIGNMENT_COLUMNS = (
    "sim_max", "sim_topk_mean", "sim_mean", "sim_std", "sim_sum", "sim_frac_above_half_max",
    "best_pos", "topk_pos_mean", "topk_pos_spread", "n_windows", "sim_gini",
    "kw_student_talk_ratio", "kw_student_q_rate", "kw_tutor_q_rate", "kw_hedge_rate",
    "kw_mean_student_words", "kw_n_utterances",
)


def top_window_dialogue(top: DataFrame, utterances: DataFrame) -> DataFrame:
    """Who talks in the top passages.  Overlapping passages count their rows twice."""
    slots = top.selectExpr(*PAIR, "rank", "explode(sequence(w_start, w_end - 1)) AS pos")
    rows = slots.join(utterances.select("session_id", "pos", "role", "content"), ["session_id", "pos"])
    chars = lambda r: f"coalesce(sum(CASE WHEN role = '{r}' THEN length(content) END), 0)"
    asks = lambda r: f"count_if(role = '{r}' AND contains(content, '?'))"
    said = (
        "concat_ws(' ', transform(filter(array_sort(collect_list(struct(rank, pos, role, content))), "
        "x -> x.role = 'student'), x -> x.content))"
    )
    counted = aggregate(
        rows, PAIR,
        f"{safe_div(chars('student'), chars('student') + ' + ' + chars('tutor'))} AS kw_student_talk_ratio",
        f"{safe_div(asks('student'), 'count_if(role = ' + chr(39) + 'student' + chr(39) + ')')} AS kw_student_q_rate",
        f"{safe_div(asks('tutor'), 'count_if(role = ' + chr(39) + 'tutor' + chr(39) + ')')} AS kw_tutor_q_rate",
        "count_if(role = 'student') AS n_student",
        "CAST(count(1) AS DOUBLE) AS kw_n_utterances",
        f"lower({said}) AS said",
    ).selectExpr("*", f"size({X.words('said')}) AS n_words", f"{X.phrase_count('said', X.HEDGE)} AS hedges")
    return counted.selectExpr(
        *PAIR, "kw_student_talk_ratio", "kw_student_q_rate", "kw_tutor_q_rate",
        f"{safe_div('hedges', 'greatest(n_words, 1)')} * 100D AS kw_hedge_rate",
        f"{safe_div('n_words', 'n_student')} AS kw_mean_student_words",
        "kw_n_utterances",
    )


def alignment(
    sims: DataFrame, top: DataFrame, pairs: DataFrame, utterances: DataFrame,
    chunked: bool = False, size: int = SIZE, stride: int = STRIDE,
) -> DataFrame:
    """``lo_*`` columns per pair, for lexical or dense scores alike."""
    centre = "((w_start + w_end) / 2D / greatest(n_rows, 1))"
    picked = aggregate(
        top, PAIR,
        "avg(sim) AS sim_topk_mean",
        f"max(CASE WHEN rank = 1 THEN {centre} END) AS best_pos",
        f"avg({centre}) AS topk_pos_mean",
        f"max({centre}) - min({centre}) AS topk_pos_spread",
    )
    summary = similarity_summary(sims, pairs, chunked, size, stride)
    out = summary.join(picked, PAIR).join(top_window_dialogue(top, utterances), PAIR)
    return out.selectExpr(
        *PAIR, *[f"CAST({c} AS DOUBLE) AS lo_{c}" for c in ALIGNMENT_COLUMNS]
    )


def topic_spans(top: DataFrame) -> DataFrame:
    """Merged passages per pair, in order."""
    return merge_spans(top, PAIR)


def topic_turns(spans: DataFrame, turns: DataFrame) -> DataFrame:
    """Labelled turns inside the merged spans with their position in the concatenation.

    A pair holds at most ``k * size`` turns, so the numbering window is bounded.
    """
    rows = span_positions(spans, *PAIR).join(turns, ["session_id", "pos"])
    place = f"row_number() OVER (PARTITION BY {', '.join(PAIR)} ORDER BY pos) - 1"
    return rows.selectExpr(*PAIR, f"CAST({place} AS BIGINT) AS pos", "role", "len", "label")


def topic_dialogue(spans: DataFrame, utterances: DataFrame) -> DataFrame:
    """Feedback and trajectory columns over the topic-relevant turns."""
    keys = tuple(PAIR)
    base = dialogue_base(topic_turns(spans, labelled_or_label(utterances)), keys, chunked=False)
    return base.selectExpr(*PAIR, *feedback_columns("fb_"), *trajectory_columns())
