"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from .quality import STOP_WORDS, SYMBOLS

_STOP = ", ".join(f"'{w}'" for w in sorted({w for line in STOP_WORDS.values() for w in line.split()}))
_SPACE = r"[\x20\x09-\x0D]"
_WORDS = f"list_filter(string_split_regex(t, '{_SPACE}+'), lambda x: x <> '')"

JACCARD = f"""
WITH RECURSIVE texts AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), worded AS (SELECT doc_id, {_WORDS} AS w FROM texts),
grams AS (
    SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM worded)
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), either_way AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN either_way l ON l.a = r.other
)
SELECT d.doc_id, coalesce(max(s.n), 0) AS n_shingles, min(r.other) AS component_id
FROM documents d JOIN reach r USING (doc_id) LEFT JOIN sizes s USING (doc_id) GROUP BY d.doc_id
"""

QUALITY = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
worded AS (
    SELECT doc_id, t, {_WORDS} AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM texts
), grams AS (
    SELECT doc_id, unnest(range(1, len(w) - 1)) AS i,
        unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM worded WHERE len(w) >= 3
), twice AS (SELECT doc_id, g FROM grams GROUP BY 1, 2 HAVING count(*) > 1),
covered AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM grams JOIN twice USING (doc_id, g), (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1
), measured AS (
    SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(l) AS n_lines,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
        len(list_intersect(list_distinct(list_transform(w, lambda x: lower(rtrim(x, '.,;:!?')))), [{_STOP}])) AS n_stop_words
    FROM worded LEFT JOIN covered c USING (doc_id)
), judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND word_chars >= 2.5 * n_words AND word_chars <= 12 * n_words AND n_symbols / n_words <= 0.1
        AND n_stop_words >= 2 AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AS kept, n_stop_words
FROM judged
"""

VECTORS = """
WITH RECURSIVE valid AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach(vec_id, other) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
), degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(max(d.n), 0) AS n_links, min(other) AS component_id, vec_id = min(other) AS kept
FROM reach LEFT JOIN degree d USING (vec_id) GROUP BY vec_id
"""

LINES = r"""
WITH split AS (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
    FROM documents WHERE text IS NOT NULL
), marked AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded FROM split),
wide AS (
    SELECT line, min((doc_id, pos)) AS first FROM marked WHERE worded GROUP BY line HAVING count(DISTINCT source) >= 5
), judged AS (
    SELECT m.*, w.line IS NOT NULL AND worded AND (doc_id, pos) <> w.first AS gone FROM marked m LEFT JOIN wide w USING (line)
), cleaned AS (
    SELECT doc_id, count(*) FILTER (worded) AS n_lines, count(*) FILTER (gone) AS n_removed,
        coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS t
    FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, length(t) AS n_chars, md5(t) AS text_md5
FROM documents d LEFT JOIN cleaned USING (doc_id)
"""

TURNS = r"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), sums AS (
    -- crc32, bit by bit; keys are ASCII
    SELECT k, xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS UBIGINT))),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS UBIGINT)) ELSE c // 2 END)), CAST(4294967295 AS UBIGINT)) % 20 AS d
    FROM (SELECT DISTINCT k FROM keyed)
), damaged AS (
    SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
        CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE d WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM keyed JOIN sums USING (k)
), placed AS (
    SELECT *, row_number() OVER w AS i, lead(role) OVER w AS next_role,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
        regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS t
    FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)
), judged AS (
    SELECT *, t = '' AS blank, t <> '' AND seen AS dup, t <> '' AND NOT seen AND NOT right(t, 1) IN ('.', '!', '?') AS cut,
        left(role, 1) AS c, next_role IS NOT NULL AND NOT left(role, 1) || left(next_role, 1) IN ('su', 'ua', 'au') AS wrong,
        count(*) OVER (PARTITION BY conv_id) - i AS later
    FROM placed
), facts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
        count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (wrong) AS illegal, count(*) AS n
    FROM judged GROUP BY conv_id
),
-- behind a row, for the states nothing / system / user / assistant: (cost, audit, lines) of the best edits that follow
steps AS (
    SELECT conv_id, n AS todo, {'k': 0, 'a': '', 'l': ''} AS b0, {'k': 10, 'a': 'II', 'l': chr(10) || 'user:' || chr(10) || 'assistant:'} AS b1,
        {'k': 5, 'a': 'I', 'l': chr(10) || 'assistant:'} AS b2, {'k': 0, 'a': '', 'l': ''} AS b3 FROM facts
    UNION ALL
    SELECT conv_id, todo - 1,
        list_min([y0, {'k': 5 + y2.k, 'a': 'I' || y2.a, 'l': chr(10) || 'user:' || y2.l},
            {'k': 10 + y3.k, 'a': 'II' || y3.a, 'l': chr(10) || 'user:' || chr(10) || 'assistant:' || y3.l}]),
        list_min([y1, {'k': 5 + y2.k, 'a': 'I' || y2.a, 'l': chr(10) || 'user:' || y2.l},
            {'k': 10 + y3.k, 'a': 'II' || y3.a, 'l': chr(10) || 'user:' || chr(10) || 'assistant:' || y3.l}]),
        list_min([y2, {'k': 5 + y3.k, 'a': 'I' || y3.a, 'l': chr(10) || 'assistant:' || y3.l}]),
        list_min([y3, {'k': 5 + y2.k, 'a': 'I' || y2.a, 'l': chr(10) || 'user:' || y2.l}])
    FROM (
        SELECT conv_id, todo,
            list_min([drop0] || CASE WHEN may THEN [turn_user] || CASE c WHEN 's' THEN [stay1] WHEN 'u' THEN [stay2] ELSE [] END ELSE [] END) AS y0,
            list_min([drop1] || CASE WHEN may THEN [turn_user] || CASE c WHEN 'u' THEN [stay2] ELSE [] END ELSE [] END) AS y1,
            list_min([drop2] || CASE WHEN may THEN [turn_assistant] || CASE c WHEN 'a' THEN [stay3] ELSE [] END ELSE [] END) AS y2,
            list_min([drop3] || CASE WHEN may THEN [turn_user] || CASE c WHEN 'u' THEN [stay2] ELSE [] END ELSE [] END) AS y3
        FROM (
            SELECT s.conv_id, s.todo, j.c, NOT j.blank AND NOT j.dup AS may, CASE WHEN j.cut THEN 5 ELSE 0 END AS e,
                {'k': 2 + b0.k, 'a': 'D' || b0.a, 'l': b0.l} AS drop0, {'k': 2 + b1.k, 'a': 'D' || b1.a, 'l': b1.l} AS drop1,
                {'k': 2 + b2.k, 'a': 'D' || b2.a, 'l': b2.l} AS drop2, {'k': 2 + b3.k, 'a': 'D' || b3.a, 'l': b3.l} AS drop3,
                {'k': 1 + e + b2.k, 'a': 'R' || b2.a, 'l': chr(10) || 'user:' || j.text || b2.l} AS turn_user,
                {'k': 1 + e + b3.k, 'a': 'R' || b3.a, 'l': chr(10) || 'assistant:' || j.text || b3.l} AS turn_assistant,
                {'k': e + b1.k, 'a': 'K' || b1.a, 'l': chr(10) || j.role || ':' || j.text || b1.l} AS stay1,
                {'k': e + b2.k, 'a': 'K' || b2.a, 'l': chr(10) || j.role || ':' || j.text || b2.l} AS stay2,
                {'k': e + b3.k, 'a': 'K' || b3.a, 'l': chr(10) || j.role || ':' || j.text || b3.l} AS stay3
            FROM steps s JOIN judged j ON s.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = s.todo
        )
    )
), done AS (SELECT conv_id, b0 FROM steps WHERE todo = 0)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, CAST(coalesce(b0.k, 0) AS BIGINT) AS cost, coalesce(b0.a, '') AS audit,
    sha256(coalesce(substr(b0.l, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""

NEGATIVES = """
WITH valid AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, p.vec_id, a.label = p.label AS same,
        CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * p.v[i])) AS BIGINT) AS score
    FROM valid a JOIN valid p ON a.vec_id % 100 = 0 AND a.vec_id <> p.vec_id AND len(a.v) = len(p.v)
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

ORACLES = {
    "op1_jaccard_join": JACCARD,
    "op2_quality_rules": QUALITY,
    "op5_vectors": VECTORS,
    "op10_line_dedup": LINES,
    "op12_turn_repair": TURNS,
    "op13_hard_negatives": NEGATIVES,
}
