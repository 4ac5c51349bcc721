"""The queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

import corpus_pipeline

from .chat import op4_chat
from .decontaminate import op5_decontaminate
from .html_text import op12_html
from .jaccard import op8_jaccard, op8_links
from .licenses import op2_licenses
from .line_dedup import op1_lines
from .merkle import op13_merkle
from .pieces import op10_pieces
from .pitman_yor import op3_pitman_yor
from .quality import op7_quality
from .sharding import op9_shards
from .spelling import op11_spelling
from .suffix_dedup import op6_suffixes
from .twins import MERKLE, SPELLING

QUERIES = {
    "op1_line_dedup": op1_lines,
    "op2_license_scan": op2_licenses,
    "op3_pitman_yor": op3_pitman_yor,
    "op4_chat_format": op4_chat,
    "op5_decontamination": op5_decontaminate,
    "op6_suffix_dedup": op6_suffixes,
    "op7_quality_rules": op7_quality,
    "op8_jaccard_join": op8_jaccard,
    "op8_jaccard_links": op8_links,
    "op9_sharding": op9_shards,
    "op10_sentencepiece": op10_pieces,
    "op11_spelling_variants": op11_spelling,
    "op12_html_extraction": op12_html,
    "op13_merkle_manifest": op13_merkle,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op4_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(role) + 2 + length(text) + (length(text) - length(replace(text, '\', '')))
           + (length(text) - length(replace(text, '</turn>', ''))) // 7
           + (length(text) - length(replace(text, '### ', ''))) // 4 + 8) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
    "op5_decontamination": r"""
WITH i AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS it FROM benchmark),
ip AS (SELECT item_id, len(it) AS n, unnest(it) AS w, unnest(range(len(it))) AS p FROM (SELECT DISTINCT * FROM i) WHERE len(it) >= 8),
d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS dt FROM documents),
dp AS (SELECT doc_id, unnest(dt) AS w, unnest(range(len(dt))) AS q FROM d),
m AS (
  SELECT doc_id, item_id, q - p AS diag, p, n, CAST(ceil(least(13, n) * 80 / 100.0) AS INT) AS need FROM dp JOIN ip USING (w)),
k AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, diag) AS matched,
         lead(p, 6) OVER o AS l7, lead(p, 7) OVER o AS l8, lead(p, 8) OVER o AS l9, lead(p, 9) OVER o AS l10, lead(p, 10) OVER o AS l11
  FROM m WINDOW o AS (PARTITION BY doc_id, item_id, diag ORDER BY p)),
s AS (
  SELECT doc_id, item_id, diag, max(matched) AS matched FROM k
  WHERE (CASE need WHEN 7 THEN l7 WHEN 8 THEN l8 WHEN 9 THEN l9 WHEN 10 THEN l10 ELSE l11 END) - p < least(13, n)
  GROUP BY ALL),
f AS (
  SELECT doc_id, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS item_ids, count(DISTINCT item_id) AS n_items,
         count(*) AS n_spans, max(matched) AS best_matched FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(item_ids, '') AS item_ids, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, CAST(coalesce(best_matched, 0) AS BIGINT) AS best_matched,
       f.doc_id IS NOT NULL AS contaminated
FROM documents LEFT JOIN f USING (doc_id)""",
    "op8_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (
  SELECT doc_id, len(ws) AS n, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ')
         ELSE ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] || ' ' || ws[k + 3] END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS k FROM w WHERE len(ws) > 0)),
sh AS (SELECT DISTINCT doc_id, s FROM g),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT reach.a AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = reach.a GROUP BY reach.a""",
    "op11_spelling_variants": SPELLING,
    "op13_merkle_manifest": MERKLE,
}
