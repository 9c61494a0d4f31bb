"""SQL for the document queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS body, {WORDS} AS words FROM documents
), lined AS (
  SELECT doc_id, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))
    AS lines FROM docs
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win
  FROM docs, unnest(range(1, len(words) - 6)) AS t(i)
), twice AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows
  ) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 8) AS t(k) GROUP BY doc_id
), measures AS MATERIALIZED (
  SELECT doc_id, source, len(words) AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words,
    len(lines) AS n_lines
  FROM docs JOIN lined USING (doc_id) LEFT JOIN covered USING (doc_id)
), judged AS MATERIALIZED (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 30 * word_chars
      OR 100 * n_dup_lines > 30 * n_lines AS failed
  FROM measures
), hosts AS (
  SELECT source, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS f FROM judged
  WHERE source IS NOT NULL GROUP BY source
), moments AS (
  SELECT avg(f / n) AS m, var_samp(f / n) AS v FROM hosts
), prior AS (
  SELECT coalesce(m, 0) AS m,
    CASE WHEN v > 0 AND m * (1 - m) / v > 1 THEN m * (1 - m) / v - 1 ELSE 1 END AS w FROM moments
), rates AS (
  SELECT source, (f + m * w) / (n + w) AS rate FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(rate <= 0.5, true) AS kept
FROM judged LEFT JOIN rates USING (source)
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LETTERS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = rf"""
WITH docs AS (SELECT doc_id, {LETTERS} AS words FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {LETTERS} AS words FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, least(10, len(words)) AS size,
    array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS win
  FROM items, unnest(range(1, greatest(len(words) - 8, least(len(words) + 1, 2)))) AS t(i)
), sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS win
  FROM docs, sizes, unnest(range(1, len(words) - size + 2)) AS t(i)
), found AS (
  SELECT doc_id, i, size, item FROM doc_windows JOIN item_windows USING (size, win)
), hit AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM (SELECT DISTINCT doc_id, i, size FROM found), unnest(range(0, size)) AS t(k)
  GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP9 = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, {WORDS} AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s
  FROM docs, unnest(range(1, greatest(len(words) - 3, least(len(words) + 1, 2)))) AS t(i)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y, c = p.n AND c = q.n AS same FROM common
  JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 5 * c >= 4 * (p.n + q.n - c)
), copies AS (
  SELECT doc_id, least(doc_id, coalesce(min(y), doc_id)) AS first
  FROM docs LEFT JOIN links ON x = doc_id AND same GROUP BY doc_id
), reach(doc_id, other) AS (
  SELECT x, y FROM links
  UNION
  SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.other
), least_of AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id),
counts AS (
  SELECT x AS doc_id, count(*) AS n_links,
    count(DISTINCT CASE WHEN NOT same THEN first END) AS n_texts
  FROM links JOIN copies ON copies.doc_id = y GROUP BY x
)
SELECT doc_id, least(doc_id, coalesce(other, doc_id)) AS class_id,
  coalesce(n_texts, 0) AS n_texts, coalesce(n_links, 0) AS n_links, coalesce(n, 0) AS n_shingles
FROM docs LEFT JOIN least_of USING (doc_id) LEFT JOIN counts USING (doc_id)
  LEFT JOIN sizes USING (doc_id)
"""

OP11 = r"""
WITH named AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), found AS (
  SELECT lang, source, row,
         unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM named
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS lang_count
  FROM found GROUP BY ALL HAVING count(DISTINCT row) >= 10
), sizes AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(lang_count)::HUGEINT AS lang_n FROM kept GROUP BY lang
), grid AS (
  SELECT g.lang, g.source, k.term, k.lang_count, coalesce(c.n, 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM named) g
  JOIN kept k ON g.lang = k.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM found GROUP BY ALL) c
    ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM grid GROUP BY ALL
), shares AS (
  SELECT grid.*, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS p,
         1 + (1000000000::HUGEINT * (lang_count + 2)) // (lang_n + 2 * v) AS q
  FROM grid JOIN totals USING (lang, source) JOIN sizes USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce(pairs.value, 0)::BIGINT AS value
  FROM (SELECT DISTINCT lang, source FROM named) a
  JOIN (SELECT DISTINCT lang, source FROM named) b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT
  FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
      FROM every)
WHERE part = 'pair' OR rank <= 10
"""

OP12 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'),
                   (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), escaped AS (
  SELECT *,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\c'), chr(10), '\n') AS head,
    replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\c') AS body
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('### ') + length(head) + 1 + length(body) + length('</turn>') + 2)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

OP13 = r"""
WITH scaled AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM scaled a JOIN scaled b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT * FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id))::INTEGER AS rank,
       n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""
