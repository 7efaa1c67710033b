"""DuckDB SQL for the newer queries, where SQL can express them."""

from __future__ import annotations

#: ASCII white space as a DuckDB string.
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _assigned(book: str) -> str:
    """Of each part of each vector: the nearest entry of ``book``, the lower one of equals, and the squared distance."""
    return f"""
  SELECT vec_id, part, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist
  FROM (SELECT d.vec_id, d.part, b.entry, CAST(sum((d.x - b.y) * (d.x - b.y)) AS BIGINT) AS dist
        FROM d JOIN {book} b ON d.part = b.part AND d.pos = b.pos GROUP BY 1, 2, 3)
  GROUP BY 1, 2"""


def _refined(book: str, assigned: str) -> str:
    return f"""
  SELECT b.part, b.entry, b.pos, coalesce(m.y, b.y) AS y
  FROM {book} b LEFT JOIN (
    SELECT d.part, a.entry, d.pos, CAST(floor(sum(d.x) / count(*)) AS BIGINT) AS y
    FROM d JOIN {assigned} a ON d.vec_id = a.vec_id AND d.part = a.part GROUP BY 1, 2, 3) m
  ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos"""


OP11 = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS MATERIALIZED (
  SELECT vec_id, i // (len(v) // 16) AS part, i % (len(v) // 16) AS pos, v[i + 1] AS x
  FROM (SELECT vec_id, v, unnest(range(len(v))) AS i FROM kept)),
b0 AS MATERIALIZED (
  SELECT part, entry, pos, x AS y
  FROM d JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64) USING (vec_id)),
a0 AS MATERIALIZED ({_assigned("b0")}),
b1 AS MATERIALIZED ({_refined("b0", "a0")}),
a1 AS MATERIALIZED ({_assigned("b1")}),
b2 AS MATERIALIZED ({_refined("b1", "a1")}),
a2 AS MATERIALIZED ({_assigned("b2")}),
e AS (
  SELECT vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error
  FROM a2 GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b2) AS codebooks_sha256
FROM e JOIN kept USING (vec_id)
"""


def _more(cost: str, letter: str, way: str) -> str:
    """``way`` is eight digits of cost and the edits behind; one more edit in front."""
    return f"lpad(CAST(CAST({way}[1:8] AS INT) + {cost} AS VARCHAR), 8, '0') || '{letter}' || {way}[9:]"


def _over(state: int) -> str:
    """The best way from a state over one row; null where an edit is not allowed."""
    steps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state]
    keep = " ".join(f"WHEN initial = '{i}' THEN {_more('5 * torn', 'K', f'v{t}')}" for i, t in steps.items())
    turned = _more("1 + 5 * torn", "R", f"v{3 if state == 2 else 2}")
    return f"least({_more('2', 'D', f'v{state}')}, CASE WHEN fault IN ('b', 'd') THEN NULL {keep} END, CASE WHEN fault IN ('b', 'd') THEN NULL ELSE {turned} END)"


OP12 = f"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
    FROM (SELECT unnest(range(256)) AS i))),
hashed AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: CAST(ord(ch) AS BIGINT)),
                         lambda acc, b: xor(acc >> 8, tab[(xor(acc, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind
  FROM conversations, crc),
rows AS MATERIALIZED (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) FROM hashed WHERE kind <> 0)),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM rows),
judged AS MATERIALIZED (
  SELECT *, CAST(fault = 't' AS INT) AS torn FROM (
    SELECT conv_id, turn, role, text, n, role[1:1] AS initial,
           role[1:1] || lead(role[1:1]) OVER (PARTITION BY conv_id ORDER BY n) AS pair,
           CASE WHEN rtrim(text, {BLANKS}) = '' THEN 'b'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd'
                WHEN rtrim(text, {BLANKS})[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault
    FROM placed)),
ways AS (
  SELECT conv_id, max(n) AS n, '00000000' AS v0, '00000010II' AS v1, '00000005I' AS v2, '00000000' AS v3 FROM judged GROUP BY conv_id
  UNION ALL
  SELECT conv_id, n - 1, least(w0, {_more("5", "I", "u2")}), least(w1, {_more("5", "I", "u2")}), u2, u3 FROM (
    SELECT *, least(w2, {_more("5", "I", "w3")}) AS u2, least(w3, {_more("5", "I", "w2")}) AS u3 FROM (
      SELECT ways.conv_id, ways.n, {", ".join(f"{_over(s)} AS w{s}" for s in range(4))}
      FROM ways JOIN judged ON ways.conv_id IS NOT DISTINCT FROM judged.conv_id AND ways.n = judged.n))),
best AS MATERIALIZED (SELECT conv_id, CAST(v0[1:8] AS BIGINT) AS cost, v0[9:] AS audit FROM ways WHERE n = 0),
letters AS (
  SELECT conv_id, k, letter, sum(CAST(letter <> 'I' AS INT)) OVER w AS n, sum(CAST(letter <> 'D' AS INT)) OVER w AS j
  FROM (SELECT conv_id, k, audit[k:k] AS letter FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS k FROM best))
  WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
left_ AS (
  SELECT l.conv_id, k, letter, j, text, role,
         max(CAST(j = 1 AND letter = 'K' AND initial = 's' AS INT)) OVER (PARTITION BY l.conv_id) AS led
  FROM letters l LEFT JOIN judged ON l.conv_id IS NOT DISTINCT FROM judged.conv_id AND l.n = judged.n
  WHERE letter <> 'D'),
mended AS (
  SELECT conv_id, string_agg(CASE letter WHEN 'K' THEN role ELSE CASE (j - led) % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END
                             || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS body
  FROM left_ GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts ON c.conv_id IS NOT DISTINCT FROM counts.conv_id
LEFT JOIN best ON c.conv_id IS NOT DISTINCT FROM best.conv_id
LEFT JOIN mended ON c.conv_id IS NOT DISTINCT FROM mended.conv_id
"""

OP13 = f"""
WITH lines AS MATERIALIZED (
  SELECT doc_id, pos, line, translate(trim(line, {BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, parts[i] AS line, i AS pos
        FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
              FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)))),
keys AS (SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, pos, line, last IS NOT NULL AND doc_id <> last AS gone FROM lines LEFT JOIN keys USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
