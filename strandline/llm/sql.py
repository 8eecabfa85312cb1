"""DuckDB twins of the queries that SQL can express."""

#: Lines of every document with their windows of three; the earliest of equal windows stays.
LINE_WINDOWS = r"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
numbered AS (
  SELECT doc_id, i - 1 AS pos, lower(trim(regexp_replace(ls[i], '[ \t\r]+', ' ', 'g'))) AS line
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM split)
),
windows AS (
  SELECT doc_id, pos,
         line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS content
  FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
),
kept AS (
  SELECT content, min(doc_id) AS kept_doc, arg_min(pos, doc_id * 10000000 + pos) AS kept_at, count(*) AS n
  FROM windows WHERE content IS NOT NULL AND content <> chr(10) || chr(10) GROUP BY content HAVING count(*) > 1
),
covers AS (
  SELECT w.doc_id, CASE WHEN w.doc_id = kept_doc THEN greatest(pos, kept_at + 3) ELSE pos END AS first, pos + 2 AS last
  FROM windows w JOIN kept USING (content) WHERE w.doc_id <> kept_doc OR pos <> kept_at
),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM covers WHERE first <= last
),
islands AS (
  SELECT doc_id, min(pos) AS first, max(pos) AS last
  FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM gone)
  GROUP BY doc_id, island
),
spans AS (
  SELECT doc_id, string_agg(first || '-' || last, ',' ORDER BY first) AS removed_lines FROM islands GROUP BY doc_id
),
left_over AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text
  FROM (SELECT doc_id, i - 1 AS pos, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM split))
  ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN s.doc_id IS NULL THEN d.text ELSE coalesce(l.text, '') END AS text,
       coalesce(s.removed_lines, '') AS removed_lines
FROM documents d LEFT JOIN spans s USING (doc_id) LEFT JOIN left_over l USING (doc_id)
"""

#: Five filters in all 120 orders, counted from the masks of failed filters without the transform.
FILTER_AUDIT = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS head FROM texts),
marked AS (
  SELECT doc_id, part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
         + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT)
         + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
         + 16 * CAST(doc_id IS DISTINCT FROM head AS INT) AS mask
  FROM worded
),
told AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
),
counts AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM marked LEFT JOIN told USING (doc_id) GROUP BY part, mask
),
filters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM filters a, filters b, filters c, filters d, filters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
  AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
),
steps AS (
  SELECT filter_order, CAST(k AS INT) AS step, bits[k] AS own, coalesce(list_sum(bits[1 : k - 1]), 0) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS k)
),
counted AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN mask & (before + own)::INT = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before::INT = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before::INT <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before::INT = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before::INT = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""
