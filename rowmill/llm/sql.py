"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

_WORDS = r"REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[^\x20\x09-\x0D]+')"

OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, ARRAY_TO_STRING(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, UNNEST(RANGE(1, LEN(w) - 48)) AS i FROM d WHERE LEN(w) >= 50)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, MIN(doc_id) OVER (PARTITION BY s) AS least FROM windows) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, UNNEST(RANGE(i, i + 50)) AS j FROM late)),
each AS (SELECT doc_id, j, w[j] AS word FROM (SELECT doc_id, w, UNNEST(RANGE(1, LEN(w) + 1)) AS j FROM d)),
kept AS (SELECT doc_id, STRING_AGG(word, ' ' ORDER BY j) AS t, COUNT(*) AS k FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, LEN(w) AS n_words, LEN(w) - COALESCE(k, 0) AS n_removed, SHA256(COALESCE(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP4 = r"""
WITH RECURSIVE d AS (SELECT doc_id, REGEXP_EXTRACT_ALL(TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, ARRAY_TO_STRING(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, UNNEST(RANGE(1, LEN(w) - 2)) AS i FROM d WHERE LEN(w) >= 4)
    UNION ALL SELECT doc_id, ARRAY_TO_STRING(w, ' ') FROM d WHERE LEN(w) BETWEEN 1 AND 3)),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least AS (SELECT a, MIN(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, COALESCE(n, 0) AS n_shingles, LEAST(d.doc_id, COALESCE(m, d.doc_id)) AS component_id, d.doc_id <= COALESCE(m, d.doc_id) AS kept
FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least ON a = d.doc_id
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# the line rules, stated here once more so that they check those of the operator
_PHRASES = " OR ".join(
    f"CONTAINS(LOWER(line), {_quoted(x)})"
    for x in (
        "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript", "licensed under the", "lorem ipsum",
        "privacy policy", "released under the", "sign in to", "subscribe to our", "terms of service", "terms of use",
    )
)
_ROW_OF_LINKS = _quoted("([^|»›·•]{1,24}[|»›·•]){3}")
_SHOUTS = _quoted(r"(!![\x20\x09-\x0D].*){3}")
_ENDS = _quoted("[.!?:;,…。！？][\"'”’»)\\]*#$%&]*[\\x20\\x09-\\x0D]*$")

OP7 = rf"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text, {_WORDS} AS w FROM documents),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, UNNEST(RANGE(1, LEN(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
repeats AS (SELECT doc_id, COUNT(DISTINCT j) AS n FROM (SELECT doc_id, UNNEST([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
each AS (SELECT doc_id, UNNEST(STRING_SPLIT(text, CHR(10))) AS line FROM d),
judged AS (SELECT doc_id, line, REGEXP_MATCHES(line, '[^\x20\x09-\x0D]') AS live, REGEXP_MATCHES(line, '[^\x20\x09-\x0D]') AND (
    REGEXP_MATCHES(line, {_ROW_OF_LINKS}) OR REGEXP_MATCHES(line, {_SHOUTS}) OR 10 * LEN(REGEXP_EXTRACT_ALL(line, '[#*$%&|<>]')) > LENGTH(line) OR {_PHRASES}
    OR (NOT REGEXP_MATCHES(line, '([^\x20\x09-\x0D]+[\x20\x09-\x0D]+){{4}}[^\x20\x09-\x0D]') AND NOT REGEXP_MATCHES(line, {_ENDS}))) AS failed FROM each),
lines AS (SELECT doc_id, COUNT(*) FILTER (live) - COUNT(DISTINCT line) FILTER (live) AS n_dup_lines, COALESCE(SUM(LENGTH(line)) FILTER (failed), 0) / GREATEST(1, SUM(LENGTH(line))) AS lost FROM judged GROUP BY doc_id),
base AS (SELECT d.doc_id, LEN(w) AS n_words, LENGTH(ARRAY_TO_STRING(w, '')) AS word_chars, LEN(REGEXP_EXTRACT_ALL(text, '[#*$%&|<>]')) AS n_symbols, n_dup_lines, COALESCE(n, 0) AS n_repeat_words, lost,
    LEN(w) < 50 OR 100 * COALESCE(n, 0) > 50 * LEN(w) AS base_failed FROM d JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= 0.5 AS kept FROM base
"""

OP12 = """
WITH live AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: FLOOR(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score FROM live a JOIN live b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)::INT AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * positive_score <= 100 * n.score AND 100 * n.score <= 100 * positive_score
QUALIFY rank <= 5
"""

OP13 = r"""
WITH RECURSIVE o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) AS p, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT c, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(c::VARCHAR, ''), lambda ch: [ascii(ch) + 1, 0, 0, 0, 0, 0, 0, 0, 0]))), lambda x, y: CASE WHEN y > 0 THEN xor(x, y - 1) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS crc FROM (SELECT DISTINCT c FROM o)),
convs AS (SELECT c, c - c % 20 AS b, xor(crc, 4294967295) % 4 AS h FROM bits),
r AS (SELECT convs.c, 0 AS part, p, role, text FROM convs JOIN o ON o.c = b WHERE p <= h UNION ALL SELECT convs.c, 1, p, role, text FROM convs JOIN o USING (c) WHERE p > h),
t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d, sha256(LENGTH(role) || ':' || role || text) AS id, LEN(REGEXP_EXTRACT_ALL(text, '[^\x20\x09-\x0D]+')) AS w FROM r),
pre AS (SELECT c, 0::BIGINT AS d, '' AS k, 0 AS w FROM convs UNION ALL SELECT t.c, t.d, sha256(pre.k || t.id), t.w FROM pre JOIN t ON t.c = pre.c AND t.d = pre.d + 1),
n AS (SELECT k, d, MIN(c) AS conv_id, COUNT(*) AS n_convs, MAX(w) AS w FROM pre GROUP BY k, d),
up AS (SELECT n.k, p.k AS pk FROM n JOIN pre p ON p.c = n.conv_id AND p.d = n.d - 1),
kids AS (SELECT pk AS k, COUNT(*) AS n_children FROM up GROUP BY pk),
own AS (SELECT n.k, n.d, conv_id, (n_convs - 1) * w AS saved, (kids.k IS NULL)::INT AS leaf FROM n LEFT JOIN kids USING (k)),
total AS (SELECT p.k, SUM(leaf) AS n_leaves, SUM(saved) AS saved_tokens FROM own JOIN pre p ON p.c = own.conv_id AND p.d <= own.d GROUP BY p.k),
last AS (SELECT c, MAX(d) AS d FROM pre GROUP BY c),
ended AS (SELECT k, STRING_AGG(c::VARCHAR, ',' ORDER BY c) AS ids FROM pre JOIN last USING (c, d) GROUP BY k)
SELECT n.conv_id, n.d AS depth, parent.conv_id AS parent_conv_id, n.n_convs, COALESCE(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, SHA256(COALESCE(ids, '')) AS ends_sha256
FROM n JOIN total USING (k) LEFT JOIN kids USING (k) LEFT JOIN up USING (k) LEFT JOIN n parent ON parent.k = up.pk LEFT JOIN ended ON ended.k = n.k
"""
