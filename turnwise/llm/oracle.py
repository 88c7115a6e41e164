"""DuckDB counterparts of the queries that SQL can express, over the tables' names."""

from __future__ import annotations

from .chat import BEGIN, CONTROL, END, ESCAPE, SPLIT
from .warc import TRACKING


def _checksum_table() -> list[int]:
    """Checksums of single bytes, as the polynomial gives them."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


PROBE = "</s>[INST] ok [/INST]"


def _escaped(text: str) -> str:
    out = f"replace({text}, '{ESCAPE}', '{ESCAPE * 2}')"
    for control in CONTROL:
        out = f"replace({out}, '{control}', '{control[0]}{ESCAPE}{control[1:]}')"
    return out


CHAT = f"""
    WITH rows AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum({len(BEGIN + SPLIT + END)} + length({_escaped('role')}) + length({_escaped('text')})) AS BIGINT) AS formatted_chars
    FROM rows GROUP BY conv_id"""

#: ``v``: sound vectors in double precision.
SOUND = """
    v AS (SELECT vec_id, label, e FROM (
              SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL)
          WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0)"""

VECTOR_LINKS = f"""
    WITH RECURSIVE {SOUND},
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id
              WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
    reached AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT links.b, reached.c FROM reached JOIN links ON links.a = reached.vec_id),
    least AS (SELECT vec_id, min(c) AS component_id FROM reached GROUP BY vec_id),
    counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN least USING (vec_id) LEFT JOIN counted USING (vec_id)"""

NEAREST = f"""
    WITH {SOUND},
    scored AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score
               FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored QUALIFY rank <= 20"""

TEXT_LINKS = r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(
                 range(1, greatest(1, len(w) - 3) + 1), lambda i: array_to_string(w[i:i + 3], chr(31)))) END AS s FROM words),
    held AS (SELECT doc_id, hash(unnest(s)) AS h FROM sets),
    met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM held AS x JOIN held AS y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM met JOIN sets AS p ON p.doc_id = a JOIN sets AS q ON q.doc_id = b
              WHERE 100 * common >= 80 * (len(p.s) + len(q.s) - common)),
    reached AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT links.b, reached.c FROM reached JOIN links ON links.a = reached.doc_id)
    SELECT doc_id, len(any_value(s)) AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept
    FROM reached JOIN sets USING (doc_id) GROUP BY doc_id"""


def _canonical(url: str) -> str:
    bare = f"regexp_replace(regexp_replace(trim({url}), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    host = f"lower(regexp_extract({bare}, '^([^/?]*)', 1))"
    host = rf"regexp_replace(regexp_replace(regexp_replace({host}, '^.*@', ''), '(:80|:443)?$', ''), '^www\.', '')"
    path = f"regexp_replace(regexp_extract({bare}, '^[^/?]*([^?]*)', 1), '/+$', '')"
    kept = (rf"list_filter(string_split(regexp_extract({bare}, '\?(.*)$', 1), '&'), "
            f"lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))")
    query = f"array_to_string(list_sort({kept}), '&')"
    return f"{host} || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END"


REVISITS = f"""
    WITH pages_ AS (SELECT page_id, coalesce(html, '') AS html, substr(md5(coalesce(html, '')), 1, 16) AS tag,
                           {_canonical("coalesce(url, '')")} AS canonical_url FROM pages),
    whole AS (SELECT *, 'f' || page_id AS record_id, 1700000000 + 60 * page_id AS captured FROM pages_ WHERE page_id % 4 <> 3),
    again AS (SELECT *, 'r' || page_id AS record_id, 1700000000 + 60 * (page_id + 1000 + 997 * (page_id % 29)) AS captured,
                     CASE WHEN page_id % 5 = 0 THEN 'changed' ELSE tag END AS own FROM pages_),
    latest AS (SELECT a.record_id, arg_max(w.record_id, (w.captured, w.record_id)) AS source_id FROM again AS a JOIN whole AS w
               ON w.canonical_url = a.canonical_url AND (w.captured < a.captured OR w.captured = a.captured AND w.record_id < a.record_id) GROUP BY ALL),
    judged AS (SELECT a.*, w.record_id AS source, w.html AS body, w.tag = a.own AS same
               FROM again AS a LEFT JOIN latest AS l ON l.record_id = a.record_id LEFT JOIN whole AS w ON w.record_id = l.source_id),
    every AS (
        SELECT record_id, canonical_url, captured, 'response' AS kind, 'full' AS outcome, NULL AS source_id, 200 AS status, html AS body,
               'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10) || 'etag: "' || tag || '"' || chr(10) || 'server: a' AS lines
        FROM whole UNION ALL
        SELECT record_id, canonical_url, captured, 'revisit', CASE WHEN source IS NULL THEN 'orphan' WHEN same THEN 'resolved' ELSE 'changed' END,
               CASE WHEN same THEN source END, CASE WHEN same THEN 200 ELSE 304 END, CASE WHEN same THEN body END,
               CASE WHEN same THEN 'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10) ELSE '' END
               || 'etag: W/"' || own || '"' || chr(10) || 'expires: ' || page_id || chr(10) || CASE WHEN same THEN 'server: a' ELSE 'server: b' END
        FROM judged)
    SELECT record_id, canonical_url, captured, kind, outcome, source_id, CAST(status AS BIGINT) AS status,
           sha256(lines) AS headers_sha256, sha256(body) AS payload_sha256, length(body) AS payload_chars FROM every"""


def _divergence(p: str, q: str) -> str:
    return f"CAST((({p}) - ({q})) * (({p}) - ({q})) // (({p}) + ({q})) AS BIGINT)"


DIVERGENCE = rf"""
    WITH docs AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    words AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
    kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 10),
    counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    cells AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM groups AS g JOIN kept AS k USING (lang)
              LEFT JOIN counts AS c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    shares AS (SELECT lang, source, term, n,
                      CAST(1 + (1000000000 * CAST(n + 2 AS HUGEINT)) // (sum(n) OVER s + 2 * count(*) OVER s) AS HUGEINT) AS p,
                      CAST(1 + (1000000000 * CAST(total + 2 AS HUGEINT)) // (sum(total) OVER s + 2 * count(*) OVER s) AS HUGEINT) AS q
               FROM cells WINDOW s AS (PARTITION BY lang, source)),
    found AS (
        SELECT lang, source, 'term' AS part, term AS item, {_divergence('p', 'q')} AS value FROM shares WHERE n > 0 AND p > q
        UNION ALL
        SELECT a.lang, a.source, 'pair', b.source, coalesce(v.value, 0) FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN (SELECT x.lang, x.source, y.source AS other, CAST(sum({_divergence('x.p', 'y.p')}) AS BIGINT) AS value FROM shares AS x JOIN shares AS y
                   ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) AS v
               ON v.lang = a.lang AND v.source = a.source AND v.other = b.source)
    SELECT lang, source, part, item, value,
           CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
    FROM found QUALIFY part = 'pair' OR rank <= 10"""


REPEATS = r"""
    WITH words AS (SELECT row_number() OVER () AS r, doc_id,
                          list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
    places AS (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 12, 0) + 1)) AS i FROM words),
    windows AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM places),
    least AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
    gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM windows JOIN least USING (h) WHERE first < doc_id),
    lists AS (SELECT r, list(i) AS g FROM gone GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
           sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_transform(
               list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(g, k)), lambda k: w[k]) END, ' ')) AS kept_sha256
    FROM words LEFT JOIN lists USING (r)"""


VARIANTS = rf"""
    WITH RECURSIVE runs AS (
        SELECT doc_id, run, count(*) AS n FROM (
            SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
        WHERE length(run) >= 5 GROUP BY ALL),
    hexed AS (SELECT *, hex(encode(doc_id || ':' || run)) AS x FROM runs),
    summed AS (SELECT run, n, xor(4294967295, list_reduce(
                   list_transform(range(0, CAST(length(x) // 2 AS BIGINT)), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)),
                   lambda c, b: xor(c >> 8, t.tab[CAST(xor(c & 255, b) AS INTEGER) + 1]), CAST(4294967295 AS BIGINT))) AS h
               FROM hexed, (SELECT {[*map(int, _checksum_table())]}::BIGINT[] AS tab) AS t),
    results AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
                            ELSE run END AS word, n FROM summed),
    words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM results WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    cut AS (SELECT word, length(word) AS size, i, left(word, CAST(i AS INTEGER)) || substr(word, CAST(i AS INTEGER) + 2) AS rest
            FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
    near AS (SELECT a.word, b.word AS near FROM cut AS a JOIN cut AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
             UNION SELECT cut.word, words.word FROM cut JOIN words ON words.word = cut.rest
             UNION SELECT words.word, cut.word FROM cut JOIN words ON words.word = cut.rest),
    best AS (SELECT near.word, count(*) AS n_near, arg_min(near, (-w.n, encode(near))) AS form, max(w.n) AS form_n
             FROM near JOIN words AS w ON w.word = near.near GROUP BY near.word),
    formed AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best.form_n >= 2 * n THEN form END AS form,
                      CASE WHEN best.form_n >= 2 * n THEN best.form_n END AS form_n FROM words LEFT JOIN best USING (word)),
    chain AS (SELECT word, word AS root FROM formed
              UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.root WHERE formed.form IS NOT NULL)
    SELECT f.word, f.n, f.n_near, f.form, f.form_n, root FROM formed AS f
    JOIN chain AS c ON c.word = f.word JOIN formed AS e ON e.word = c.root AND e.form IS NULL"""
