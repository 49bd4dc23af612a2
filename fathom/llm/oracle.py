"""DuckDB SQL for the queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

OP10 = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), common AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, pos, line, coalesce(doc_id < last, false) AS gone FROM lines LEFT JOIN common USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: A list of 256 numbers, and crc32 of the UTF-8 bytes of a string made of ASCII and Latin-1 letters.
TABLE = "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END) AS v FROM range(256) r(i)))"


def crc32(text: str) -> str:
    own = f"flatten([CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END FOR c IN string_split({text}, '')])::BIGINT[]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {own}), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295::BIGINT)"


OP11 = f"""
WITH {TABLE}, own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS x FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), lent AS (
  SELECT conv_id, x, ({crc32("conv_id::VARCHAR")} % 6)::BIGINT AS h FROM own, crc
), rebuilt AS (
  SELECT a.conv_id, list_concat(b.x[1:a.h], a.x[a.h + 1:]) AS x FROM lent a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100
), prefixes AS (
  SELECT conv_id, d, x[1:d] AS p, len(x) = d AS ends FROM (SELECT conv_id, x, unnest(range(0, len(x) + 1)) AS d FROM rebuilt)
), named AS (
  SELECT p, d, min(conv_id) AS node, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM prefixes GROUP BY p, d
), ways AS (
  SELECT conv_id, d, node FROM prefixes JOIN named USING (p, d)
), nodes AS (
  SELECT n.node, n.d, w.node AS parent, n_convs, ends_sha256, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * length(p[n.d].t) END AS own FROM named n LEFT JOIN ways w ON w.conv_id = n.node AND w.d = n.d - 1
), children AS (
  SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY parent, d
), every AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (node, d)
), sums AS (
  SELECT w.node, w.d, count(*) FILTER (WHERE e.n_children = 0) AS n_leaves, sum(e.own)::BIGINT AS saved_tokens FROM every e JOIN ways w ON w.conv_id = e.node AND w.d <= e.d GROUP BY w.node, w.d
)
SELECT node AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM every JOIN sums USING (node, d)
"""

OP12 = rf"""
WITH RECURSIVE {TABLE}, runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM counted, crc
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cuts AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS form, max(n) AS form_n FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)
), ways AS (
  SELECT word, word AS at FROM forms UNION ALL SELECT w.word, f.form FROM ways w JOIN forms f ON f.word = w.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN ways w USING (word) JOIN forms e ON e.word = w.at WHERE e.form IS NULL
"""

ORACLES = {"op10_line_dedup": OP10, "op11_prefix_trie": OP11, "op12_spelling_variants": OP12}
