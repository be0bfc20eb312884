"""SQL, for DuckDB, of operators whose results SQL can express, and what it takes to write it."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text: the polynomial's division, bit by bit."""
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"  # a fixed value: the reversed polynomial
    byte = f"list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: {bit})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: {byte}), 4294967295)"


def _leaf(text: str) -> str:
    return "sha256(concat(" + ", ".join(f"coalesce(concat(strlen({v}), ':', {v}), '-')" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + "))"


#: Levels, then walks from each leaf to its subroot and from each subroot to the root.
MERKLE = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, coalesce(concat('=', source), '') AS key, {_leaf('"text"')} AS hash,
    CASE WHEN {crc32('doc_id::VARCHAR')} % 2 = 0 THEN {_leaf('''replace("text", chr(10), '')''')} ELSE {_leaf('"text"')} END AS tampered
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, hash) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM leaf),
node AS (
  SELECT key, 0 AS lvl, idx, hash, n FROM placed
  UNION ALL
  SELECT key, lvl + 1, idx // 3, sha256(string_agg(hash, '' ORDER BY idx)), (n + 2) // 3 FROM node WHERE n > 1 GROUP BY key, lvl, idx // 3, n),
subs AS (SELECT key, hash, row_number() OVER (ORDER BY key) - 1 AS idx, count(*) OVER () AS n FROM node WHERE n = 1),
top AS (
  SELECT 0 AS lvl, idx, hash, n FROM subs
  UNION ALL
  SELECT lvl + 1, idx // 3, sha256(string_agg(hash, '' ORDER BY idx)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, idx // 3, n),
walk AS (
  SELECT key, idx AS leaf_idx, 0 AS lvl, idx, n, '' AS proof, tampered AS folded FROM placed
  UNION ALL
  SELECT w.key, w.leaf_idx, w.lvl + 1, w.idx // 3, (w.n + 2) // 3, w.proof || coalesce(string_agg(s.hash, '' ORDER BY s.idx) FILTER (s.idx <> w.idx), ''),
    sha256(coalesce(string_agg(s.hash, '' ORDER BY s.idx) FILTER (s.idx < w.idx), '') || w.folded || coalesce(string_agg(s.hash, '' ORDER BY s.idx) FILTER (s.idx > w.idx), ''))
  FROM walk w JOIN node s ON s.key = w.key AND s.lvl = w.lvl AND s.idx // 3 = w.idx // 3 WHERE w.n > 1 GROUP BY w.key, w.leaf_idx, w.lvl, w.idx, w.n, w.proof, w.folded),
climb AS (
  SELECT w.key, w.leaf_idx, 0 AS lvl, s.idx, s.n, w.proof, w.folded FROM walk w JOIN subs s ON s.key = w.key WHERE w.n = 1
  UNION ALL
  SELECT w.key, w.leaf_idx, w.lvl + 1, w.idx // 3, (w.n + 2) // 3, w.proof || coalesce(string_agg(s.hash, '' ORDER BY s.idx) FILTER (s.idx <> w.idx), ''),
    sha256(coalesce(string_agg(s.hash, '' ORDER BY s.idx) FILTER (s.idx < w.idx), '') || w.folded || coalesce(string_agg(s.hash, '' ORDER BY s.idx) FILTER (s.idx > w.idx), ''))
  FROM climb w JOIN top s ON s.lvl = w.lvl AND s.idx // 3 = w.idx // 3 WHERE w.n > 1 GROUP BY w.key, w.leaf_idx, w.lvl, w.idx, w.n, w.proof, w.folded)
SELECT p.doc_id, p.hash AS leaf, s.hash AS subroot, t.hash AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = t.hash AS verified
FROM placed p JOIN climb c ON c.key = p.key AND c.leaf_idx = p.idx AND c.n = 1 JOIN subs s ON s.key = p.key JOIN top t ON t.n = 1
"""

TRIE = f"""
WITH turn_ AS (SELECT conv_id, coalesce(role, '') AS r, coalesce("text", '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, "text") AS i FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'r': r, 't': t}} ORDER BY i) AS s, {crc32('conv_id::VARCHAR')} % 6 AS h FROM turn_ GROUP BY conv_id),
rebuilt AS (SELECT o.conv_id, list_concat(coalesce(b.s[:o.h], []), o.s[o.h + 1:]) AS s FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
prefix AS (SELECT conv_id, d, s[:d] AS k, len(s) AS n FROM rebuilt, unnest(range(0, len(s) + 1)) AS u(d)),
node AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends FROM prefix GROUP BY d, k),
kids AS (SELECT d - 1 AS d, k[:d - 1] AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY d - 1, k[:d - 1]),
own_ AS (SELECT x.*, coalesce(c.n, 0) AS n_children, CASE WHEN x.d = 0 THEN 0 ELSE (x.n_convs - 1) * length(x.k[x.d].t) END AS saved FROM node x LEFT JOIN kids c ON c.d = x.d AND c.k = x.k),
below AS (SELECT a AS d, k[:a] AS k, sum(saved)::BIGINT AS saved, count(*) FILTER (n_children = 0) AS leaves FROM own_, unnest(range(0, d + 1)) AS u(a) GROUP BY a, k[:a])
SELECT x.conv_id, x.d AS depth, y.conv_id AS parent_conv_id, x.n_convs, x.n_children, b.leaves AS n_leaves, b.saved AS saved_tokens, x.ends AS ends_sha256
FROM own_ x JOIN below b ON b.d = x.d AND b.k = x.k LEFT JOIN node y ON y.d = x.d - 1 AND y.k = x.k[:x.d - 1]
"""
