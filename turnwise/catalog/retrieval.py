"""Passages, relevance, topic spans and the response-scoped blocks."""

from __future__ import annotations

from ..operators import render as RD
from ..operators import retrieval as RT
from ..operators import windows as WN
from ..operators.ordered import aggregate, by_position, has_large_groups, scan
from ..plans import alignment as AL
from ..plans import content as CT
from ..plans import position as PO
from . import inputs as I
from .dialogue import FBS, TRAJ, base_sql, feedback_sql, trajectory_sql
from .registry import query, rounded
from .sessions import div, phrases_sql, quoted
from ..functions import text as X
from ..session import cut

STOP = I.STOPWORDS
K = WN.TOP_K

# one row per passage and row position; sizes 20 / 10 unless given
def windows_sql(source: str, size: int = 20, stride: int = 10) -> str:
    return f"""
    SELECT session_id, n_rows, s AS w_start, least(s + {size}, n_rows) AS w_end,
           row_number() OVER (PARTITION BY session_id ORDER BY s) - 1 AS window_idx
    FROM (SELECT DISTINCT session_id, n_rows, unnest(
              CASE WHEN n_rows <= {size} THEN [0::BIGINT]
                   ELSE list_distinct(list_concat(range(0, n_rows - {size} + 1, {stride}), [n_rows - {size}])) END) AS s
          FROM (SELECT session_id, count(*) AS n_rows FROM ({source}) AS _u GROUP BY session_id))"""


def texts_sql(source: str, size: int = 20, stride: int = 10) -> str:
    return f"""
    SELECT w.session_id, window_idx, w_start, w_end, w.n_rows,
           string_agg(content, ' ' ORDER BY pos) AS content
    FROM ({windows_sql(source, size, stride)}) AS w
    JOIN ({source}) AS u ON u.session_id = w.session_id AND pos >= w_start AND pos < w_end
    GROUP BY ALL"""


@query("sliding_windows", "B4 T14", f"""
    SELECT session_id, window_idx, w_start, w_end, md5(content) AS content_md5 FROM ({texts_sql(I.LONG)})""")
def _windows(spark, sf_dir):
    texts = WN.window_texts(I.long_utterances(spark, sf_dir)[0])
    return texts.selectExpr("session_id", "window_idx", "w_start", "w_end", "md5(content) AS content_md5")


@query("sliding_windows_short", "B4 T14", f"""
    SELECT session_id, window_idx, w_start, w_end, content FROM ({texts_sql(I.SHORT, 3, 2)})""")
def _windows_short(spark, sf_dir):
    turns = I.short_utterances(spark, sf_dir)
    rows = scan(turns, by_position(has_large_groups(turns)), totals={"n_rows": ("sum", "1L")})
    return WN.window_texts(rows, 3, 2).select("session_id", "window_idx", "w_start", "w_end", "content")


STOP_SQL = "[" + ", ".join(quoted(s) for s in STOP) + "]"


def terms_sql(keys: str, source: str) -> str:
    """keys, term, tf of word 1-2 grams."""
    tokens = (
        f"list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]{{2,}}'), "
        f"lambda w: NOT list_contains({STOP_SQL}, w))"
    )
    return f"""
    SELECT {keys}, term, count(*) AS tf FROM (
        SELECT {keys}, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term
        FROM (SELECT {keys}, {tokens} AS t FROM ({source}))) GROUP BY ALL"""


IDF_SQL = f"""
    SELECT term, ln((1 + (SELECT count(DISTINCT text) FROM benchmark)) / (1 + count(*))) + 1 AS idf
    FROM ({terms_sql('content', 'SELECT DISTINCT text AS content FROM benchmark')}) GROUP BY term"""


def tfidf_sql(keys: str, source: str) -> str:
    return f"""
    SELECT {keys}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {keys})) AS weight
    FROM (SELECT {keys}, term, (1 + ln(tf)) * idf AS w FROM ({terms_sql(keys, source)}) JOIN ({IDF_SQL}) USING (term))"""


@query("objective_term_weights", "B5", rounded(
    tfidf_sql("objective_id", "SELECT item_id AS objective_id, text AS content FROM benchmark"), "weight"))
def _weights(spark, sf_dir):
    goals = I.objectives(spark, sf_dir)
    return RT.objective_vectors(goals, RT.fit_idf(goals, STOP), STOP)


LEXICAL = f"""
    tr AS MATERIALIZED ({I.TOPIC_RESPONSES}),
    tp AS (SELECT DISTINCT session_id, objective_id, n_rows FROM tr),
    wt AS MATERIALIZED ({texts_sql(I.LONG)}),
    pv AS MATERIALIZED ({tfidf_sql('session_id, window_idx', 'SELECT * FROM wt')}),
    ov AS ({tfidf_sql('objective_id', 'SELECT item_id AS objective_id, text AS content FROM benchmark')}),
    nz AS (SELECT tp.session_id, tp.objective_id, window_idx, round(sum(pv.weight * ov.weight), 9) AS sim
           FROM tp JOIN ov USING (objective_id) JOIN pv ON pv.session_id = tp.session_id AND pv.term = ov.term
           GROUP BY ALL),
    sims AS MATERIALIZED (SELECT tp.session_id, tp.objective_id, wt.window_idx, w_start, w_end, wt.n_rows,
                    coalesce(sim, 0.0) AS sim
             FROM tp JOIN wt USING (session_id)
             LEFT JOIN nz ON nz.session_id = tp.session_id AND nz.objective_id = tp.objective_id
                         AND nz.window_idx = wt.window_idx)"""
TOP = f"""
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, objective_id
                                  ORDER BY round(sim, 9) DESC, window_idx) AS rank FROM sims) WHERE rank <= {K})"""
SPANS = """
    mk AS (SELECT *, CASE WHEN w_start <= max(w_end) OVER (PARTITION BY session_id, objective_id ORDER BY w_start, w_end
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM top),
    mi AS (SELECT *, sum(opens) OVER (PARTITION BY session_id, objective_id ORDER BY w_start, w_end
                       ROWS UNBOUNDED PRECEDING) AS span FROM mk),
    spans AS (SELECT session_id, objective_id, span, min(w_start) AS w_start, max(w_end) AS w_end,
                     max(n_rows) AS n_rows FROM mi GROUP BY ALL)"""


def lexical(spark, sf_dir, labelled=False):
    utterances, chunked = I.topic_utterances(spark, sf_dir, labelled)
    answers = I.topic_responses(spark, sf_dir)
    pairs = I.topic_pairs(answers)
    sims = RT.lexical_similarity(
        utterances, pairs, I.objectives(spark, sf_dir), STOP, chunked, parts=I.text_parts(spark, sf_dir)
    ).selectExpr(*RT.PAIR, "window_idx", "round(sim, 9) AS sim")
    return utterances, chunked, answers, pairs, sims


@query("topic_relevance", "B6 J11", rounded(f"""
    WITH {LEXICAL} SELECT session_id, objective_id, window_idx, sim FROM sims WHERE sim > 0""", "sim"))
def _relevance(spark, sf_dir):
    return lexical(spark, sf_dir)[4].where("sim > 0")


@query("topic_relevance_topk", "K2 B6", rounded(f"""
    WITH {LEXICAL}, {TOP} SELECT session_id, objective_id, rank, window_idx, w_start, w_end, sim FROM top""", "sim"))
def _topk(spark, sf_dir):
    _, _, _, pairs, sims = lexical(spark, sf_dir)
    return RT.top_windows(sims, pairs).drop("n_rows")


@query("topic_spans", "B9", f"""
    WITH {LEXICAL}, {TOP}, {SPANS} SELECT session_id, objective_id, w_start, w_end FROM spans""")
def _spans(spark, sf_dir):
    _, _, _, pairs, sims = lexical(spark, sf_dir)
    return AL.topic_spans(RT.top_windows(sims, pairs)).select(*RT.PAIR, "w_start", "w_end")


LO = [f"lo_{c}" for c in AL.ALIGNMENT_COLUMNS]
HEDGES = phrases_sql("said", X.HEDGE)
STRIPPED = f"regexp_replace(said, {quoted(X.BRACKET)}, ' ', 'g')"


def alignment_sql(sims: str, utterances: str | None) -> str:
    summary = """
    sm AS (SELECT session_id, objective_id, max(sim) AS mx, avg(sim) AS mean, stddev_pop(sim) AS std,
                  sum(sim) AS total, count(*) AS nw FROM sims GROUP BY ALL),
    fr AS (SELECT session_id, objective_id,
                  CASE WHEN any_value(mx) > 0 THEN count(*) FILTER (sim >= 0.5 * mx) / count(*) ELSE 0.0 END AS frac
           FROM sims JOIN sm USING (session_id, objective_id) GROUP BY ALL),
    gr AS (SELECT session_id, objective_id, greatest(sim, 0) AS x,
                  row_number() OVER (PARTITION BY session_id, objective_id ORDER BY sim) AS i,
                  count(*) OVER (PARTITION BY session_id, objective_id) AS n FROM sims),
    gi AS (SELECT session_id, objective_id,
                  CASE WHEN sum(x) <= 0 OR max(n) < 2 THEN 0.0
                       ELSE 2 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1) / max(n) END AS gini
           FROM gr GROUP BY ALL)"""
    return summary


@query("topic_alignment", "B8 A15 A8 K2", rounded(f"""
    WITH {LEXICAL}, {TOP}, {alignment_sql('sims', None)},
    tk AS (SELECT session_id, objective_id, avg(sim) AS topk,
                  max((w_start + w_end) / 2.0 / n_rows) FILTER (rank = 1) AS best,
                  avg((w_start + w_end) / 2.0 / n_rows) AS pm,
                  max((w_start + w_end) / 2.0 / n_rows) - min((w_start + w_end) / 2.0 / n_rows) AS ps
           FROM top GROUP BY ALL),
    kr AS (SELECT t.session_id, t.objective_id, rank, pos, role, content
           FROM top AS t JOIN ({I.LONG}) AS u ON u.session_id = t.session_id AND pos >= w_start AND pos < w_end),
    kd0 AS (SELECT session_id, objective_id, count(*) AS n,
                  coalesce(sum(length(content)) FILTER (role = 'student'), 0) AS sc,
                  coalesce(sum(length(content)) FILTER (role = 'tutor'), 0) AS tc,
                  count(*) FILTER (role = 'student') AS ns, count(*) FILTER (role = 'tutor') AS nt,
                  count(*) FILTER (role = 'student' AND contains(content, '?')) AS sq,
                  count(*) FILTER (role = 'tutor' AND contains(content, '?')) AS tq,
                  lower(coalesce(string_agg(content, ' ' ORDER BY rank, pos) FILTER (role = 'student'), '')) AS said
           FROM kr GROUP BY ALL),
    kd AS (SELECT *, len(regexp_extract_all({STRIPPED}, {quoted(X.WORD)})) AS nwords, {HEDGES} AS hedges FROM kd0)
    SELECT session_id, objective_id, mx AS lo_sim_max, topk AS lo_sim_topk_mean, mean AS lo_sim_mean,
           std AS lo_sim_std, total AS lo_sim_sum, frac AS lo_sim_frac_above_half_max, best AS lo_best_pos,
           pm AS lo_topk_pos_mean, ps AS lo_topk_pos_spread, CAST(nw AS DOUBLE) AS lo_n_windows, gini AS lo_sim_gini,
           {div('sc', 'sc + tc')} AS lo_kw_student_talk_ratio, {div('sq', 'ns')} AS lo_kw_student_q_rate,
           {div('tq', 'nt')} AS lo_kw_tutor_q_rate, {div('hedges', 'greatest(nwords, 1)')} * 100.0 AS lo_kw_hedge_rate,
           {div('nwords', 'ns')} AS lo_kw_mean_student_words, CAST(n AS DOUBLE) AS lo_kw_n_utterances
    FROM sm JOIN fr USING (session_id, objective_id) JOIN gi USING (session_id, objective_id)
    JOIN tk USING (session_id, objective_id) JOIN kd USING (session_id, objective_id)""", LO))
def _alignment(spark, sf_dir):
    utterances, chunked, _, pairs, sims = lexical(spark, sf_dir)
    sims = cut(sims)  # read by the summary, the Gini and the top-k branches
    top = RT.top_windows(sims, pairs)
    return AL.alignment(sims, top, pairs, utterances, chunked)


SCOPED = f"""
    SELECT session_id, objective_id, role, content,
           row_number() OVER (PARTITION BY session_id, objective_id ORDER BY upos) - 1 AS pos
    FROM (SELECT s.session_id, s.objective_id, u.pos AS upos, role, content
          FROM spans AS s JOIN ({I.LONG}) AS u ON u.session_id = s.session_id AND u.pos >= w_start AND u.pos < w_end)"""
KEYS = "session_id, objective_id"
FB = [c.replace("fbs_", "fb_") for c in FBS]


@query("topic_dialogue", "B10 B11 J13", rounded(f"""
    WITH {LEXICAL}, {TOP}, {SPANS}, {base_sql(SCOPED, KEYS)}
    SELECT * FROM ({feedback_sql(KEYS, 'fb_')}) JOIN ({trajectory_sql(KEYS)}) USING ({KEYS})""", FB + TRAJ))
def _topic_dialogue(spark, sf_dir):
    utterances, _, _, pairs, sims = lexical(spark, sf_dir, labelled=True)
    return AL.topic_dialogue(AL.topic_spans(RT.top_windows(sims, pairs)), utterances)


LOPOS = [f"lopos_{c}" for c in PO.POSITION_COLUMNS]


@query("topic_time_share", "B12 J12 W18", rounded(f"""
    WITH {LEXICAL}, {TOP}, {SPANS}, u AS ({I.TOPIC}),
    rs AS (SELECT tr.response_id, s.* FROM tr JOIN spans AS s USING (session_id, objective_id)),
    ex AS (SELECT response_id, session_id, objective_id, min(w_start) AS s, max(w_end) AS e,
                  sum(w_end - w_start) AS covered, max(n_rows) AS n FROM rs GROUP BY ALL),
    ov2 AS (SELECT a.response_id, sum(greatest(0, least(a.w_end, b.w_end) - greatest(a.w_start, b.w_start))) AS ov
            FROM rs AS a JOIN rs AS b ON a.session_id = b.session_id AND a.response_id <> b.response_id GROUP BY ALL),
    od AS (SELECT *, rank() OVER (PARTITION BY session_id ORDER BY (s + e) / 2.0) - 1 AS ordinal,
                  count(*) OVER (PARTITION BY session_id) AS k FROM ex),
    cl AS (SELECT session_id, min(t_seconds) AS t0, max(t_seconds) AS t1 FROM u GROUP BY session_id),
    tt AS (SELECT od.*, t0, t1, coalesce(ov, 0) AS ov, coalesce(ua.t_seconds, t0) AS ta, coalesce(ub.t_seconds, t1) AS tb
           FROM od JOIN cl USING (session_id) LEFT JOIN ov2 USING (response_id)
           LEFT JOIN u AS ua ON ua.session_id = od.session_id AND ua.pos = s
           LEFT JOIN u AS ub ON ub.session_id = od.session_id AND ub.pos = e - 1)
    SELECT DISTINCT session_id, objective_id, CAST(k AS DOUBLE) AS lopos_n_competing_los, s / n AS lopos_start_pos,
           e / n AS lopos_end_pos, (s + e) / 2.0 / n AS lopos_centre_pos, covered / n AS lopos_utt_share,
           CAST(ordinal AS DOUBLE) AS lopos_ordinal, ordinal / greatest(k - 1, 1) AS lopos_ordinal_frac,
           ov / greatest(covered, 1) AS lopos_overlap_with_others, greatest(tb - ta, 0.0) AS lopos_duration_s,
           greatest(tb - ta, 0.0) / greatest(t1 - t0, 1.0) AS lopos_minute_share,
           greatest(t1 - tb, 0.0) AS lopos_gap_to_session_end_s, (n - e) / n AS lopos_gap_to_session_end_utt
    FROM tt""", LOPOS))
def _time_share(spark, sf_dir):
    utterances, chunked, answers, pairs, sims = lexical(spark, sf_dir)
    spans = AL.topic_spans(RT.top_windows(sims, pairs))
    return PO.objective_positions(answers, spans, utterances, chunked)


# --- rendered text ---------------------------------------------------------------------
TAG = "CASE role WHEN 'tutor' THEN 'T:' WHEN 'student' THEN 'S:' WHEN 'background' THEN 'B:' ELSE '?:' END"
STRIP = r"'^\s+|\s+$', '', 'g'"


@query("session_text", "T12 T10", f"""
    SELECT session_id, left(string_agg(role || ': ' || content, chr(10) ORDER BY pos), 4000) AS text
    FROM ({I.LONG}) GROUP BY session_id""")
def _session_text(spark, sf_dir):
    utterances, chunked = I.long_utterances(spark, sf_dir)
    return RD.session_text(utterances, 4000, chunked)


@query("role_text", "T10", f"""
    WITH whole AS (SELECT session_id, role, string_agg(content, chr(10) ORDER BY pos) AS t FROM ({I.SHORT}) GROUP BY session_id, role),
    parts AS (SELECT *, unnest(range(0, greatest(length(t) - 1, 0) // 400 + 1)) AS part FROM whole)
    SELECT session_id, role, part, substr(t, part * 400 + 1, 400) AS text FROM parts""")
def _role_text(spark, sf_dir):
    return RD.role_text(I.short_utterances(spark, sf_dir), 400, chunked=True)


@query("topic_passages", "T11 B18", f"""
    WITH {LEXICAL}, {TOP}, {SPANS}
    SELECT s.session_id, s.objective_id,
           string_agg(regexp_replace({TAG} || ' ' || content, {STRIP}), chr(10) ORDER BY pos)
             FILTER (regexp_replace(content, {STRIP}) <> '') AS text
    FROM spans AS s JOIN ({I.LONG}) AS u ON u.session_id = s.session_id AND pos >= w_start AND pos < w_end
    GROUP BY ALL""")
def _passages(spark, sf_dir):
    utterances, _, _, pairs, sims = lexical(spark, sf_dir)
    return RD.tagged_passages(AL.topic_spans(RT.top_windows(sims, pairs)), utterances)


def document_sql(max_chars: int, turns: int) -> str:
    return f"""
    WITH {LEXICAL}, {TOP}, {SPANS}, u AS ({I.LONG}),
    lc AS (SELECT s.session_id, s.objective_id,
                  '<relevant_dialogue>' || chr(10) || string_agg('<' || role || '> ' || content, chr(10) ORDER BY pos) AS local
           FROM spans AS s JOIN u ON u.session_id = s.session_id AND pos >= w_start AND pos < w_end GROUP BY ALL),
    ix AS (SELECT DISTINCT session_id,
                  CASE WHEN n_rows <= {turns} THEN least(j, n_rows - 1)
                       ELSE CAST(round_even(j * ((n_rows - 1) / {float(turns - 1)}::DOUBLE), 0) AS BIGINT) END AS pos
           FROM (SELECT DISTINCT session_id, n_rows FROM tp), (SELECT unnest(range(0, {turns})) AS j)),
    cx AS (SELECT session_id, '<lesson_context>' || chr(10) || string_agg('<' || role || '> ' || content, chr(10) ORDER BY pos) AS context
           FROM ix JOIN u USING (session_id, pos) GROUP BY session_id)
    SELECT session_id, objective_id,
           CASE WHEN length(local) >= {max_chars} THEN left(local, {max_chars})
                ELSE regexp_replace(local || chr(10) || left(context, greatest({max_chars} - length(local) - 1, 0)), {STRIP}) END AS text
    FROM tp JOIN cx USING (session_id) JOIN lc USING (session_id, objective_id)"""


@query("bounded_documents", "T13 K6 B18", document_sql(400_000, 7))
def _documents(spark, sf_dir):
    utterances, _, _, pairs, sims = lexical(spark, sf_dir)
    spans = AL.topic_spans(RT.top_windows(sims, pairs))
    return RD.bounded_document(spans, utterances, pairs, 400_000, 7)


@query("evenly_spaced_turns", "K6", f"""
    SELECT DISTINCT session_id, CASE WHEN n <= 4 THEN least(j, n - 1)
           ELSE CAST(round_even(j * ((n - 1) / 3.0::DOUBLE), 0) AS BIGINT) END AS pos
    FROM (SELECT session_id, count(*) AS n FROM ({I.SHORT}) GROUP BY session_id), (SELECT unnest(range(0, 4)) AS j)""")
def _evenly(spark, sf_dir):
    sizes = aggregate(I.short_utterances(spark, sf_dir), ["session_id"], "count(1) AS n")
    return sizes.selectExpr("session_id", f"explode({RD.evenly_spaced('n', 4)}) AS pos")


@query("spaced_text_chunks", "T16 K6", """
    WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
    c AS (SELECT doc_id, w, CAST(ceil(len(w) / 64.0) AS BIGINT) AS n FROM t),
    i AS (SELECT DISTINCT doc_id, w, CASE WHEN n <= 6 THEN least(j, n - 1)
                 ELSE CAST(round_even(j * ((n - 1) / 5.0::DOUBLE), 0) AS BIGINT) END AS chunk
          FROM c, (SELECT unnest(range(0, 6)) AS j))
    SELECT doc_id, chunk, md5(array_to_string(w[chunk * 64 + 1 : chunk * 64 + 64], ' ')) AS chunk_md5 FROM i""")
def _chunks(spark, sf_dir):
    words = I.table(spark, sf_dir, "documents").selectExpr("doc_id", "split(text, ' ') AS w")
    picked = RD.evenly_spaced("CAST(ceil(size(w) / 64D) AS BIGINT)", 6)
    return words.selectExpr(
        "doc_id", f"explode(arrays_zip({picked}, {RD.spaced_chunks('w', 64, 6)})) AS c"
    ).selectExpr("doc_id", "c['0'] AS chunk", "md5(concat_ws(' ', c['1'])) AS chunk_md5")


# --- dense vectors ---------------------------------------------------------------------
def dense(spark, sf_dir):
    windows, chunked = I.vector_windows(spark, sf_dir)
    sims = RT.dense_similarity(windows, I.vector_pairs(windows), I.vector_objectives(spark, sf_dir), chunked)
    return windows, sims


@query("vector_relevance", "B7", rounded(
    f"WITH {I.VECTORS} SELECT session_id, objective_id, window_idx, sim FROM vs", "sim"))
def _vector_relevance(spark, sf_dir):
    return dense(spark, sf_dir)[1].drop("vector", "n_windows")


CONT = [f"cont_raw_{i:03d}" for i in range(64)]


@query("content_pool", "B13 K2", rounded(f"""
    WITH {I.VECTORS},
    tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY sim DESC, window_idx) AS rank
                          FROM vs) WHERE rank <= 4),
    wt AS (SELECT {KEYS}, v, greatest(sim, 0) / sum(greatest(sim, 0)) OVER (PARTITION BY {KEYS}) AS w FROM tk)
    SELECT {KEYS}, {', '.join(f'sum(w * v[{i + 1}]) AS {c}' for i, c in enumerate(CONT))} FROM wt GROUP BY ALL""", CONT))
def _content_pool(spark, sf_dir):
    return CT.content_pool(dense(spark, sf_dir)[1], 4, 64)


@query("attention_statistics", "B15", rounded(f"""
    WITH {I.VECTORS},
    a AS (SELECT *, exp(sim / 0.5) / sum(exp(sim / 0.5)) OVER (PARTITION BY {KEYS}) AS att,
                 (window_idx + 0.5) / n_windows AS position,
                 row_number() OVER (PARTITION BY {KEYS} ORDER BY sim DESC, window_idx) AS rank FROM vs)
    SELECT {KEYS}, avg(sim) AS cosine_mean, max(sim) AS cosine_max, -sum(att * ln(att)) AS attention_entropy,
           sum(att * position) AS attended_position, avg(sim) FILTER (rank <= 3) AS cosine_topk_mean
    FROM a GROUP BY ALL""", "cosine_mean cosine_max attention_entropy attended_position cosine_topk_mean"))
def _attention(spark, sf_dir):
    sims = dense(spark, sf_dir)[1]
    scored = sims.selectExpr(*RT.PAIR, "window_idx", "sim", "(window_idx + 0.5D) / n_windows AS position")
    return CT.attention_statistics(scored, temperature=0.5)


@query("instructed_queries", "T18", """
    SELECT item_id, 'Represent this topic for retrieval: ' || coalesce(text, '') AS query FROM benchmark""")
def _instructed(spark, sf_dir):
    from ..functions.scalars import with_instruction

    prompt = "Represent this topic for retrieval: "
    return I.table(spark, sf_dir, "benchmark").selectExpr("item_id", f"{with_instruction('text', prompt)} AS query")


def encoded_sql(source: str, key: str) -> str:
    """Unit vectors of word counts by md5 bucket, from ``content``."""
    return f"""
    SELECT {key}, list_transform(e, lambda x: CASE WHEN s = 0 THEN 0.0 ELSE x / sqrt(s) END) AS v FROM (
        SELECT *, list_inner_product(e, e) AS s FROM (
            SELECT {key}, list_transform(range(0, 64), lambda i: CAST(coalesce(n[i], 0) AS DOUBLE)) AS e FROM (
                SELECT {key}, map_from_entries(list((b, n)) FILTER (b IS NOT NULL)) AS n FROM (
                    SELECT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS b, count(w) AS n FROM (
                        SELECT {key}, unnest(list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda w: w <> '')) AS w
                        FROM ({source})) GROUP BY ALL) GROUP BY {key})))"""


@query("encoded_window_relevance", "B14 B7", rounded(f"""
    WITH win AS ({encoded_sql(texts_sql(I.LONG), 'session_id, window_idx')}),
    goal AS ({encoded_sql("SELECT item_id AS objective_id, text AS content FROM benchmark", "objective_id")}),
    pairs AS (SELECT DISTINCT session_id, objective_id FROM ({I.TOPIC_RESPONSES}))
    SELECT session_id, objective_id, window_idx, list_inner_product(win.v, goal.v) AS sim
    FROM pairs JOIN win USING (session_id) JOIN goal USING (objective_id)""", "sim"))
def _encoded(spark, sf_dir):
    counts = cut(CT.hashed_counts(I.long_rows(spark, sf_dir), ["session_id", "doc_id"]))
    utterances, chunked = I.numbered(spark, sf_dir, counts)
    windows = CT.hashed_window_vectors(utterances)
    goals = CT.hashed_vectors(
        I.objectives(spark, sf_dir).selectExpr("objective_id", "objective_text AS content"), ["objective_id"]
    )
    pairs = I.topic_pairs(I.topic_responses(spark, sf_dir)).drop("n_rows")
    return RT.dense_similarity(windows, pairs, goals, chunked).drop("vector")
