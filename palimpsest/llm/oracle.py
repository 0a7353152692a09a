"""The opN_ queries that SQL can express, for a second engine. The others are tested against brute force."""

from __future__ import annotations

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

CHAT_FORMAT = r"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT CAST(-1 AS BIGINT), i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)),
sized AS (
  SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY conv_id) AS n,
         length('<|turn|><|text|><|end|>') + length(regexp_replace(role, '([<\[])(\\*)(\||s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g'))
         + length(regexp_replace(text, '([<\[])(\\*)(\||s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g')) AS chars
  FROM every WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
prefixes AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY nth) AS upto, role = 'assistant' OR nth = n AS ends FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (ends) AS BIGINT) AS formatted_chars, count(*) FILTER (ends) AS n_examples
FROM prefixes GROUP BY conv_id
"""

TOPK_SEARCH = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(max(list_sum(list_transform(list_zip(q.vec, v.vec), lambda p: p[1] * p[2]))) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.vec) = len(v.vec) GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""

JACCARD_JOIN = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach AS (
  SELECT doc_id AS node, doc_id AS other FROM documents
  UNION
  SELECT r.node, l.v FROM reach r JOIN (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links) l ON l.u = r.other)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT node AS doc_id, min(other) AS component_id FROM reach GROUP BY node) c USING (doc_id)
"""

SUFFIX_DEDUP = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM t)),
hit AS (SELECT doc_id, i FROM windows SEMI JOIN (SELECT g FROM windows GROUP BY g HAVING count(*) > 1) USING (g)),
bytes AS (SELECT doc_id, unnest(range(0, len(h) // 2)) AS i, substring(h, 1, 0) AS nothing FROM t),
marked AS (
  SELECT b.doc_id, b.i, coalesce(max(x.i) OVER (PARTITION BY b.doc_id ORDER BY b.i) > b.i - 200, false) AS gone
  FROM bytes b LEFT JOIN hit x ON x.doc_id = b.doc_id AND x.i = b.i),
edged AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM marked),
told AS (
  SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans,
         string_agg(substr(h, 2 * i + 1, 2), '' ORDER BY i) FILTER (NOT gone) AS kept
  FROM edged JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM documents LEFT JOIN told USING (doc_id)
"""

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM windows JOIN (SELECT g, min(doc_id) AS least FROM windows GROUP BY g) USING (g) WHERE doc_id > least),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
marked AS (
  SELECT x.doc_id, x.i, word, coalesce(max(h.i) OVER (PARTITION BY x.doc_id ORDER BY x.i) > x.i - 13, false) AS gone
  FROM words x LEFT JOIN hit h ON h.doc_id = x.doc_id AND h.i = x.i),
told AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN told USING (doc_id)
"""

ORACLE_SQL = {
    "op2_chat_format": CHAT_FORMAT,
    "op3_topk_search": TOPK_SEARCH,
    "op4_ngram_jaccard_join": JACCARD_JOIN,
    "op6_suffix_dedup": SUFFIX_DEDUP,
    "op9_substring_dedup": SUBSTRING_DEDUP,
}
