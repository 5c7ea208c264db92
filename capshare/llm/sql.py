"""DuckDB twins of the operators that SQL can express."""
from __future__ import annotations

from .common import WORD
from .quality import CLASSES, COMMON, ENOUGH, LANGUAGES, LEAST

_BLANK = r"[^\x20\x09-\x0D]"

LINES_SQL = rf"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS uid FROM documents),
l AS (SELECT doc_id, uid, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM d),
f AS (SELECT doc_id, uid, trim(x, ' ') AS x, i, row_number() OVER (PARTITION BY uid ORDER BY i) AS p FROM l WHERE regexp_matches(x, '{_BLANK}')),
w AS (SELECT a.doc_id, a.uid, a.p, a.i AS i0, b.i AS i1, c.i AS i2, a.x AS x0, b.x AS x1, c.x AS x2
      FROM f a JOIN f b ON a.uid = b.uid AND b.p = a.p + 1 JOIN f c ON a.uid = c.uid AND c.p = a.p + 2),
n AS (SELECT *, row_number() OVER (PARTITION BY x0, x1, x2 ORDER BY doc_id NULLS LAST, uid, p) AS nth FROM w),
g AS (SELECT DISTINCT uid, unnest([i0, i1, i2]) AS i FROM n WHERE nth > 1),
r AS (SELECT l.uid, string_agg(l.x, chr(10) ORDER BY l.i) AS kept FROM l ANTI JOIN g ON l.uid = g.uid AND l.i = g.i GROUP BY l.uid),
c AS (SELECT uid, count(*) AS n_removed FROM g GROUP BY uid)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE CAST(len(string_split(d.text, chr(10))) AS BIGINT) END AS n_lines, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed,
       md5(coalesce(r.kept, '')) AS text_md5
FROM d LEFT JOIN r ON d.uid = r.uid LEFT JOIN c ON d.uid = c.uid
"""

_K, _C = len(COMMON), len(CLASSES)
_COMMON = "[" + ", ".join(f"'{w}'" for w in COMMON) + "]"
_COUNTS = ", ".join("len(regexp_extract_all(t, '" + c.replace("'", "''") + "'))" for c in CLASSES)


def _dist(hist: str, ref: str, k: int) -> str:
    p, q = f"({hist}[i]::DOUBLE / list_sum({hist}))", f"{ref}[i]"
    m = f"(({p} + {q}) / 2)"
    terms = f"list_transform(range(1, {k + 1}), lambda i: CASE WHEN {hist}[i] > 0 THEN {p} * log2({p} / {m}) ELSE 0.0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / {m}) ELSE 0.0 END)"
    return f"CASE WHEN list_sum({hist}) > 0 THEN sqrt(greatest(0.0, list_sum({terms}) / 2)) END"


QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, row_number() OVER () AS uid FROM documents),
w AS (SELECT uid, regexp_extract_all(t, '{WORD}') AS a FROM d),
s AS (SELECT uid, a, CASE WHEN len(a) < 4 THEN []::VARCHAR[] ELSE list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2]) END AS g FROM w),
u AS (SELECT uid, unnest(g) AS x, generate_subscripts(g, 1) AS p FROM s),
v AS (SELECT uid, p, count(*) OVER (PARTITION BY uid, x) AS n FROM u),
z AS (SELECT uid, count(DISTINCT q) AS n_repeat_words FROM (SELECT uid, unnest([p, p + 1, p + 2]) AS q FROM v WHERE n > 1) GROUP BY uid),
y AS (SELECT uid, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT uid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{_BLANK}') GROUP BY uid),
h AS (SELECT uid, [{_COUNTS}] AS c, length(t) AS n, ' ' || regexp_replace(lower(t), '\p{{L}}{{4,}}[^\p{{L}}]*|[^\p{{L}}]+', '  ', 'g') || ' ' AS flat FROM d),
k AS (SELECT h.uid, len(a) AS words, list_concat(c, [n - list_sum(c)]) AS classes,
             list_transform({_COMMON}, lambda x: CAST((length(flat) - length(replace(flat, ' ' || x || ' ', ''))) // (length(x) + 2) AS BIGINT)) AS raw FROM h JOIN w USING (uid)),
k2 AS (SELECT uid, classes, list_concat(raw, [greatest(0, words - list_sum(raw))]) AS common FROM k),
f AS (SELECT d.doc_id, d.uid, d.lang, CAST(len(w.a) AS BIGINT) AS n_words, CAST(length(array_to_string(w.a, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(d.t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(y.n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(z.n_repeat_words, 0) AS BIGINT) AS n_repeat_words, k2.classes, k2.common
      FROM d JOIN w USING (uid) JOIN k2 USING (uid) LEFT JOIN y USING (uid) LEFT JOIN z USING (uid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
r AS (SELECT lang, {', '.join(f"sum(classes[{i}]) AS c{i}" for i in range(1, _C + 2))}, {', '.join(f"sum(common[{i}]) AS m{i}" for i in range(1, _K + 2))}
      FROM b WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang HAVING count(*) >= {ENOUGH} AND count(*) * 10000 >= (SELECT count(*) FROM b WHERE NOT base_failed)),
q AS (SELECT lang, list_transform([{', '.join(f"c{i}" for i in range(1, _C + 2))}], lambda x: x::DOUBLE / ({' + '.join(f"c{i}" for i in range(1, _C + 2))})::DOUBLE) AS rc,
             list_transform([{', '.join(f"m{i}" for i in range(1, _K + 2))}], lambda x: x::DOUBLE / ({' + '.join(f"m{i}" for i in range(1, _K + 2))})::DOUBLE) AS rm FROM r),
j AS (SELECT b.uid, min({_dist("b.classes", "q.rc", _C + 1)}) AS dc, min({_dist("b.common", "q.rm", _K + 1)}) AS dm, bool_or(q.lang = b.lang) AS own
      FROM b JOIN q ON q.lang = b.lang OR q.lang IN ({', '.join(f"'{x}'" for x in LANGUAGES)}) GROUP BY b.uid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(dc, 6) AS class_distance, round(dm, 6) AS word_distance,
       NOT base_failed AND NOT coalesce(own AND n_words >= {LEAST} AND (round(dc, 6) > 0.16 + 1.0 / sqrt(greatest(n_words, 1)) OR round(dm, 6) > 0.17 + 1.0 / sqrt(greatest(n_words, 1))), false) AS kept
FROM b LEFT JOIN j USING (uid)
"""

TOPK_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS uid, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.uid, c.vec_id, CAST(list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score FROM v q JOIN v c ON q.uid <> c.uid WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

# base32 of 40 hex digits: eight characters for each ten digits
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
             array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST(((('0x' || substr(h, CAST((i // 8) * 10 + 1 AS BIGINT), 10))::BIGINT >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY payload_digest, payload_bytes ORDER BY page_id NULLS LAST) AS nth,
             first_value(page_id) OVER (PARTITION BY payload_digest, payload_bytes ORDER BY page_id NULLS LAST) AS f FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN f END AS refers_to FROM r
"""
