"""DuckDB statements for the results that SQL can express."""

from __future__ import annotations

DECONTAMINATION = r"""
WITH
item AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item,
         list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT item, unnest([array_to_string(words[i:i + least(len(words), 10) - 1], ' ') FOR i IN range(1, len(words) - least(len(words), 10) + 2)]) AS win,
         least(len(words), 10) AS n
  FROM item WHERE len(words) > 0),
doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (
  SELECT r, n, unnest(range(1, len(words) - n + 2)) AS i, words FROM doc, sizes WHERE len(words) >= n),
hits AS (
  SELECT s.r, s.i, s.n, w.item FROM (SELECT r, i, n, array_to_string(words[i:i + n - 1], ' ') AS win FROM spots) s
  JOIN windows w ON w.win = s.win AND w.n = s.n),
marked AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN marked USING (r) LEFT JOIN named USING (r)"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
hits AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM hits)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM ranked WHERE k <= 10"""

LINE_DEDUP = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
cut AS (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k
  FROM doc WHERE text IS NOT NULL),
worded AS (
  SELECT r, doc_id, k, line, list_filter(string_split_regex(
           translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') AS words
  FROM cut),
firsts AS (
  SELECT words, min({'d': doc_id, 'k': k}) AS own FROM worded WHERE len(words) > 0 GROUP BY words),
long AS (SELECT words, own, unnest(range(1, len(words) + 1)) AS i FROM firsts WHERE len(words) >= 10),
variant AS (
  SELECT words, own, i, len(words) AS n, md5(array_to_string(words[:i - 1], ' ') || ' ' || array_to_string(words[i + 1:], ' ')) AS placed,
         md5(array_to_string(list_concat(words[:i - 1], words[i + 1:]), ' ')) AS gone FROM long),
whole AS (SELECT words, own, md5(array_to_string(words, ' ')) AS gone FROM firsts WHERE len(words) >= 10),
replaced AS (SELECT n, i, gone, min(own) AS near FROM variant GROUP BY ALL),
nears AS (
  SELECT v.words, near FROM variant v JOIN replaced USING (n, i, gone)
  UNION ALL SELECT v.words, w.own FROM variant v JOIN whole w USING (gone)
  UNION ALL SELECT w.words, v.own FROM variant v JOIN whole w USING (gone)),
best AS (SELECT words, min(near) AS near FROM nears GROUP BY words),
marked AS (
  SELECT w.r, w.k, w.line, len(w.words) > 0 AND least(f.own, coalesce(b.near, f.own)) < {'d': w.doc_id, 'k': w.k} AS gone
  FROM worded w LEFT JOIN firsts f ON f.words = w.words LEFT JOIN best b ON b.words = w.words),
kept AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone) AS text FROM (SELECT r, k, line, coalesce(gone, false) AS gone FROM marked) GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (r)"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
texts AS (SELECT words, min(r) AS node FROM doc WHERE len(words) > 0 GROUP BY words),
spread AS (
  SELECT node, unnest([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, greatest(len(words) - 4, 1) + 1)]) AS s FROM texts),
weighted AS (SELECT node, md5(s) AS s, count(*) AS w FROM spread GROUP BY ALL),
total AS (SELECT node, sum(w) AS w FROM weighted GROUP BY node),
common AS (
  SELECT x.node AS a, y.node AS b, sum(least(x.w, y.w)) AS w FROM weighted x JOIN weighted y ON x.s = y.s AND x.node < y.node GROUP BY ALL),
links AS (
  SELECT a, b FROM common c JOIN total x ON x.node = c.a JOIN total y ON y.node = c.b WHERE c.w * 5 >= (x.w + y.w - c.w) * 4),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links UNION ALL SELECT node, node FROM texts),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
comps AS (SELECT a AS node, min(b) AS comp FROM reach GROUP BY a),
named AS (
  SELECT d.r, d.doc_id, c.comp FROM doc d LEFT JOIN texts t ON t.words = d.words LEFT JOIN comps c USING (node)),
classes AS (SELECT comp, min(doc_id) AS class_id, count(*) AS class_docs FROM named WHERE comp IS NOT NULL GROUP BY comp)
SELECT doc_id, CASE WHEN comp IS NULL THEN doc_id ELSE class_id END AS class_id, coalesce(class_docs, 1)::BIGINT AS class_docs
FROM named LEFT JOIN classes USING (comp)"""

REPEATS = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
spots AS (SELECT r, unnest(range(1, len(words) - 48)) AS i FROM doc WHERE len(words) >= 50 AND doc_id IS NOT NULL),
windows AS (SELECT d.r, d.doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS w FROM spots JOIN doc d USING (r)),
least AS (SELECT w, min(doc_id) AS own FROM windows GROUP BY w),
gone AS (
  SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 50)) AS p FROM windows JOIN least USING (w) WHERE own < doc_id)),
word AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM doc),
kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (r)"""

COLLOCATIONS = r"""
WITH doc AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
piece AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS p FROM doc),
worded AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
spread AS (
  SELECT lang, m, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS phrase
  FROM worded, (VALUES (1), (2), (3)) s(m) WHERE len(w) >= m),
counted AS (SELECT lang, m, phrase, count(*) AS f FROM spread GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE m = 1 GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE m >= 2 AND f >= 10),
covered AS (
  SELECT DISTINCT s.lang, s.phrase FROM cand s JOIN
    (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM cand WHERE m = 3) b
  ON b.lang = s.lang AND b.part = s.phrase WHERE 100 * b.f >= 50 * s.f),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) ANTI JOIN covered USING (lang, phrase)),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.head JOIN counted y ON y.lang = c.lang AND y.phrase = c.rest),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS pick FROM scored),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE pick = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""
