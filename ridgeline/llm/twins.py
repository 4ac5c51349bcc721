"""DuckDB twins of the manifest and of the spelling variants."""

from __future__ import annotations

MERKLE = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS body,
         CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                                   lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 5 = 0
              THEN coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') END AS bad
  FROM documents, crc),
leaves AS MATERIALIZED (
  SELECT doc_id, g, sha256(head || body) AS h, sha256(head || coalesce(bad, body)) AS hb,
         row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, sha256(head || body)) - 1 AS pos FROM d),
low AS (
  SELECT g, 0 AS lvl, pos, h, count(*) OVER (PARTITION BY g) AS n FROM leaves
  UNION ALL
  SELECT g, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 15) // 16) FROM low WHERE n > 1 GROUP BY g, lvl, pos // 16),
subs AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, pos, h, count(*) OVER () AS n FROM subs
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 15) // 16) FROM high WHERE n > 1 GROUP BY lvl, pos // 16),
nodes AS (
  SELECT g, lvl, pos, h FROM low WHERE n > 1
  UNION ALL SELECT '#', lvl, pos, h FROM high WHERE n > 1),
around AS MATERIALIZED (
  SELECT g, lvl, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM nodes WINDOW w AS (PARTITION BY g, lvl, pos // 16 ORDER BY pos)),
height AS (SELECT g, max(lvl) AS top FROM low GROUP BY g),
steps AS MATERIALIZED (SELECT g, lvl, pos, l, r FROM around WHERE g <> '#'),
up AS (
  SELECT leaves.g, leaves.pos AS leaf_pos, 0 AS lvl, leaves.g AS tree, leaves.pos, leaves.hb AS node, '' AS proof, top, subs.pos AS sub
  FROM leaves JOIN height USING (g) JOIN subs USING (g)
  UNION ALL
  SELECT up.g, leaf_pos, CASE WHEN tree <> '#' AND up.lvl >= top THEN 0 ELSE up.lvl + 1 END,
         CASE WHEN tree <> '#' AND up.lvl >= top THEN '#' ELSE tree END,
         CASE WHEN tree <> '#' AND up.lvl >= top THEN sub ELSE up.pos // 16 END,
         CASE WHEN tree <> '#' AND up.lvl >= top THEN node ELSE sha256(a.l || node || a.r) END,
         CASE WHEN tree <> '#' AND up.lvl >= top THEN proof ELSE proof || a.l || a.r END, top, sub
  FROM up LEFT JOIN around a ON a.g = up.tree AND a.lvl = up.lvl AND a.pos = up.pos
  WHERE tree <> '#' OR up.lvl < (SELECT max(lvl) FROM high)),
done AS (SELECT g, leaf_pos, node, proof FROM up WHERE tree = '#' AND lvl = (SELECT max(lvl) FROM high))
SELECT doc_id, leaves.h AS leaf, subs.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root, sha256(proof) AS proof_sha256,
       node AS folded_root, node = (SELECT h FROM high WHERE n = 1) AS verified
FROM leaves JOIN subs USING (g) JOIN done ON done.g = leaves.g AND done.leaf_pos = leaves.pos"""


SPELLING = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
runs AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents) GROUP BY ALL),
bytes AS (
  SELECT run, k, length(run) AS len, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6)::BIGINT, 128 + (unicode(c) & 63)::BIGINT] END)) AS b FROM runs),
hashed AS (
  SELECT run, k, len, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM bytes, crc),
words AS MATERIALIZED (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % len)::INT) || substr(run, (h % len)::INT + 2) ELSE run END AS word, sum(k)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(k) >= 3),
less AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM less a JOIN words b ON a.rest = b.word),
best AS (
  SELECT near.word, count(*) AS n_near, max(o.n) AS top, list(other ORDER BY o.n DESC, other)[1] AS form
  FROM near JOIN words o ON o.word = near.other GROUP BY near.word),
forms AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN form END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS reached FROM forms
  UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.reached WHERE forms.form IS NOT NULL),
ends AS (SELECT chain.word, reached FROM chain JOIN forms ON forms.word = reached WHERE form IS NULL)
SELECT word, form, reached AS root, n, n_near, form_n FROM forms JOIN ends USING (word)"""
