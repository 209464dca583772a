"""SQL, as DuckDB takes it, of the operators that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY content) AS group_size, row_number() OVER w = 1 AS kept, sha256(content) AS text_sha256
FROM t WINDOW w AS (PARTITION BY content ORDER BY n DESC, doc_id NULLS LAST)
"""

FILTER_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > first_id THEN 'E' ELSE '' END AS failed
    FROM w LEFT JOIN marks ON w.doc_id = marks.doc_id
),
classes AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS filter, substr(filter_order, 1, step - 1) AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
faced AS (SELECT *, contains(failed, filter) AS fails, length(translate(failed, before, '')) < length(failed) AS gone FROM classes, steps),
report AS (
    SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed,
        coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant, coalesce(sum(n) FILTER (failed = filter), 0) AS unique_fails,
        coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS toxic_lost
    FROM faced GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM report
"""

SOURCE_AUDIT = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
    SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
),
terms AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 10),
langs AS (SELECT d.lang, coalesce(v, 0)::HUGEINT AS v, coalesce(total, 0)::HUGEINT AS total FROM (SELECT DISTINCT lang FROM d) d LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS total FROM terms GROUP BY lang) t ON d.lang = t.lang),
found AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w SEMI JOIN terms t ON w.lang = t.lang AND w.term = t.term GROUP BY ALL),
groups AS (SELECT g.lang, g.source, v, coalesce(n, 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) g JOIN langs USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM found GROUP BY ALL) s ON g.lang = s.lang AND g.source = s.source),
p AS (
    SELECT g.lang, g.source, t.term, coalesce(f.n, 0) AS n, 1 + (1000000000 * (coalesce(f.n, 0) + 2)::HUGEINT) // (g.total + 2 * g.v) AS p
    FROM groups g JOIN terms t ON g.lang = t.lang LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = t.term
),
q AS (SELECT t.lang, t.term, 1 + (1000000000 * (t.n + 2)::HUGEINT) // (l.total + 2 * l.v) AS q FROM terms t JOIN langs l ON t.lang = l.lang),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
told AS (SELECT p.lang, p.source, p.term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p > q),
both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM told),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
