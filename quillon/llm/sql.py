"""DuckDB SQL of the training-data queries that SQL can express, over whole tables and whole texts.

SQL has no byte-pair merges, no XXH64, no edit distance of substrings and no trained models; those queries are
held against the libraries, brute force or held-out labels in tests/llm.
"""

from __future__ import annotations

WORDS = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), v AS (
  SELECT doc_id, p, array_to_string(list_slice(w, p, p + 19), ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)
), r AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS rn FROM v
), gone AS (
  SELECT DISTINCT doc_id, p + o AS p FROM (SELECT doc_id, p, unnest(range(0, 20)) AS o FROM r WHERE rn > 1)
), kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) x
  LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p
  WHERE g.p IS NULL GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

#: On the hexadecimal form of the bytes: two characters a byte, windows from odd places.
BYTES = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), v AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS k
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d WHERE length(h) >= 100)
), r AS (
  SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS first FROM v
), hit AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER o + 50 THEN 0 ELSE 1 END AS new FROM r WHERE doc_id > first WINDOW o AS (PARTITION BY doc_id ORDER BY p)
), run AS (
  SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM hit
), span AS (
  SELECT doc_id, g, min(p) AS a, max(p) + 50 AS b, lag(max(p) + 50, 1, 0) OVER (PARTITION BY doc_id ORDER BY g) AS before FROM run GROUP BY doc_id, g
), cut AS (
  SELECT s.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY g) AS t
  FROM span s JOIN d ON d.doc_id = s.doc_id GROUP BY s.doc_id
)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(c.n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN c.doc_id IS NULL THEN h ELSE c.t || substr(h, 2 * c.last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut c ON c.doc_id = d.doc_id
"""

#: Escapes add one character for each guarded one; head and end are "### " ": " " </turn>\n", 15 characters.
CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(15 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\#<:]', '', 'g'))) AS chars,
    array_to_string(list(role ORDER BY turn, role, text), '>') AS roles
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars, regexp_full_match(roles, '(system>)?user>assistant(>user>assistant)*') AS valid
FROM g
"""

ORACLE_SQL = {"op6_substring_dedup": WORDS, "op9_chat": CHAT, "op10_repeated_bytes": BYTES}
