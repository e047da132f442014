"""SQL of the queries that need a checksum, which the SQL engine of the tests lacks."""

from __future__ import annotations

#: Remainders of all bytes, by the reflected polynomial of CRC-32.
_REMAINDERS = "[list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) FOR b IN range(256)]"


def crc32(codes: str) -> str:
    """SQL of the unsigned CRC-32 of a list of bytes; ``t.remainders`` is the list of ``crc_table``."""
    return f"xor(list_reduce([4294967295] || {codes}, lambda c, b: xor(c >> 8, t.remainders[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295)"


CRC_TABLE = f"SELECT {_REMAINDERS} AS remainders"


def _digits(column: str) -> str:
    return f"[CAST(ord(c) AS BIGINT) FOR c IN string_split(CAST({column} AS VARCHAR), '')]"


def _leaf(text: str) -> str:
    def told(c: str) -> str:
        return f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"

    return "sha256(" + " || ".join([*map(told, ("doc_id", "source", "lang", "n_chars")), told(text)]) + ")"


MERKLE = f"""
WITH RECURSIVE t AS ({CRC_TABLE}),
  d AS (SELECT doc_id, source, {_leaf("text")} AS leaf,
          CASE WHEN {crc32(_digits("doc_id"))} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS claimed FROM documents, t),
  leaves AS (SELECT *, row_number() OVER (ORDER BY doc_id, leaf) AS key, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
          row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS node, count(*) OVER (PARTITION BY source) AS n FROM d),
  nodes(level, tree, node, n, digest) AS (
    SELECT 0, tree, node, n, leaf FROM leaves
    UNION ALL
    SELECT level + 1, tree, node // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY node)) FROM nodes WHERE n > 1 GROUP BY level, tree, node // 3),
  steps AS (SELECT level, tree, node, coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
          coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
          FROM nodes WHERE n > 1 WINDOW run AS (PARTITION BY level, tree, node // 3 ORDER BY node)),
  subroots AS (SELECT tree, level, digest FROM nodes WHERE n = 1),
  tops(level, node, n, digest) AS (
    SELECT 0, tree, (SELECT count(*) FROM subroots), digest FROM subroots
    UNION ALL
    SELECT level + 1, node // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY node)) FROM tops WHERE n > 1 GROUP BY level, node // 3),
  top_steps AS (SELECT level, node, coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
          coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
          FROM tops WHERE n > 1 WINDOW run AS (PARTITION BY level, node // 3 ORDER BY node)),
  up(key, level, tree, node, folded, proof) AS (
    SELECT key, 0, tree, node, claimed, '' FROM leaves
    UNION ALL
    SELECT key, up.level + 1, up.tree, up.node // 3, sha256(before || folded || after), proof || before || after
    FROM up JOIN steps s ON s.level = up.level AND s.tree = up.tree AND s.node = up.node),
  over(key, level, node, folded, proof) AS (
    SELECT key, 0, up.tree, folded, proof FROM up JOIN subroots s ON s.tree = up.tree AND s.level = up.level
    UNION ALL
    SELECT key, over.level + 1, over.node // 3, sha256(before || folded || after), proof || before || after
    FROM over JOIN top_steps s ON s.level = over.level AND s.node = over.node),
  root AS (SELECT level, digest FROM tops WHERE n = 1)
SELECT doc_id, leaf, s.digest AS subroot, root.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root.digest AS verified
FROM leaves l JOIN subroots s USING (tree) JOIN over o USING (key) JOIN root ON o.level = root.level"""


_BYTES = "flatten([CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [192 | (ord(c) >> 6), 128 | (ord(c) & 63)] END FOR c IN string_split(told, '')])"

SPELLING = f"""
WITH RECURSIVE t AS ({CRC_TABLE}),
  runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{6,}}')) AS run FROM documents),
  seen AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS many FROM runs GROUP BY ALL),
  told AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS told FROM seen),
  summed AS (SELECT run, many, {crc32(_BYTES)} AS h FROM told, t),
  spelled AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, many
          FROM summed),
  words AS (SELECT word, CAST(sum(many) AS BIGINT) AS n FROM spelled WHERE length(word) >= 6 GROUP BY word HAVING sum(many) >= 5),
  places AS (SELECT word, n, unnest(range(length(word))) AS p FROM words),
  cut AS (SELECT word, n, p, left(word, CAST(p AS INT)) || substr(word, CAST(p AS INT) + 2) AS rest FROM places),
  pairs AS (SELECT a.word AS word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
          UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
  ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM pairs),
  forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
          FROM words w LEFT JOIN (SELECT * FROM ranked WHERE place = 1) r USING (word)),
  walk(word, reached, form) AS (
    SELECT word, word, form FROM forms
    UNION ALL
    SELECT walk.word, walk.form, f.form FROM walk JOIN forms f ON f.word = walk.form)
SELECT f.word, f.form, reached AS root, n, n_near, form_n FROM forms f JOIN walk w ON f.word = w.word AND w.form IS NULL"""
