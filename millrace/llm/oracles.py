"""Oracle SQL of those operators that SQL can express. Brute force throughout: for small tables."""

from __future__ import annotations

from .licences import THRESHOLD, _template_rows

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '{_WORD}') AS w FROM documents),
  d AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w)),
  n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM d a JOIN d b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
  reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = w.doc_id"""

LINES = f"""WITH l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS k, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
  w AS (SELECT doc_id, k, line, regexp_extract_all({_LOWER.replace('text', 'line')}, '{_WORD}') AS w FROM l),
  f AS (SELECT *, row_number() OVER (ORDER BY doc_id, k) AS ord FROM (SELECT doc_id, k, w FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, k) AS rn FROM w WHERE len(w) > 0) WHERE rn = 1)),
  v AS (SELECT ord, unnest(range(1, len(w) + 1)) AS i, unnest(list_transform(range(1, len(w) + 1), lambda i: array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' '))) AS v FROM f WHERE len(w) >= 8
        UNION ALL SELECT ord, -1, array_to_string(w, ' ') FROM f WHERE len(w) >= 8),
  s AS (SELECT ord, array_to_string(w, ' ') AS s FROM f WHERE len(w) <= 8 AND length(array_to_string(w, ' ')) >= 8),
  c AS (SELECT ord, unnest(range(1, length(s) + 1)) AS i, unnest(list_transform(range(1, length(s) + 1), lambda i: substr(s, 1, i - 1) || substr(s, i + 1))) AS v, unnest(list_transform(range(1, length(s) + 1), lambda i: regexp_matches(substr(s, i, 1), '[0-9]'))) AS digit FROM s),
  k AS (SELECT ord, i, v FROM c WHERE NOT digit UNION ALL SELECT ord, -1, s FROM s),
  close AS (SELECT ord FROM (SELECT ord, min(ord) OVER (PARTITION BY v, i) AS same FROM k WHERE i > 0) WHERE same < ord
        UNION SELECT ord FROM (SELECT ord, i, min(CASE WHEN i < 0 THEN ord END) OVER (PARTITION BY v) AS whole, min(CASE WHEN i > 0 THEN ord END) OVER (PARTITION BY v) AS cut FROM k) WHERE CASE WHEN i < 0 THEN cut ELSE whole END < ord),
  near AS (SELECT ord FROM close UNION SELECT ord FROM (SELECT ord, min(ord) OVER (PARTITION BY v, i) AS same FROM v WHERE i > 0) WHERE same < ord
        UNION SELECT ord FROM (SELECT ord, i, min(CASE WHEN i < 0 THEN ord END) OVER (PARTITION BY v) AS whole, min(CASE WHEN i > 0 THEN ord END) OVER (PARTITION BY v) AS cut FROM v) WHERE CASE WHEN i < 0 THEN cut ELSE whole END < ord),
  kept AS (SELECT doc_id, k FROM f WHERE ord NOT IN (SELECT ord FROM near)),
  t AS (SELECT w.doc_id, count(*) FILTER (WHERE len(w.w) > 0) AS n_lines, count(kept.k) AS n_kept, string_agg(line, chr(10) ORDER BY w.k) FILTER (WHERE kept.k IS NOT NULL OR len(w.w) = 0) AS text FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id AND kept.k = w.k GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_kept, 0) AS n_kept, CASE WHEN d.text IS NOT NULL THEN sha256(CASE WHEN n_kept > 0 OR n_lines = 0 THEN t.text ELSE '' END) END AS text_sha256 FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id"""


#: The table of CRC-32, from its polynomial, and the checksum of the text ``{0}`` by it.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode({0}))), lambda i: CAST('0x' || substr(hex(encode({0})), 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)"

SPELLINGS = f"""WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
  g AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS name, run, count(*) AS n FROM r WHERE length(run) >= 5 GROUP BY 1, 2),
  h AS (SELECT run, n, {_CRC.format("name")} AS h FROM g, (SELECT {_CRC_TABLE} AS t)),
  w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
  d AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i, unnest(list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))) AS v FROM w),
  near AS (SELECT a.word, b.word AS near, b.n FROM d a JOIN d b ON a.i = b.i AND a.v = b.v AND a.word <> b.word UNION SELECT d.word, w.word, w.n FROM d JOIN w ON w.word = d.v UNION SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = d.v),
  best AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, n AS near_n, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS rn FROM near),
  f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM w LEFT JOIN best b ON b.word = w.word AND rn = 1),
  up AS (SELECT word, word AS root FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word JOIN f e ON e.word = up.root AND e.form IS NULL"""


def licences() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda x: f"CAST([{', '.join(map(quoted, x))}] AS VARCHAR[])"
    templates = ", ".join(f"({quoted(r['licence'])}, {listed(r['yields'])}, {listed(r['bigrams'])})" for r in _template_rows(THRESHOLD))
    return rf"""WITH t AS (SELECT * FROM (VALUES {templates}) v(licence, yields, grams)),
  p AS (SELECT DISTINCT doc_id, unnest(list_append(string_split(replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(10), chr(1)), chr(1)), text)) AS part FROM documents WHERE text IS NOT NULL),
  w AS (SELECT doc_id, part, list_filter(string_split_regex(lower(part), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM p),
  g AS (SELECT doc_id, part, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams FROM w),
  m AS (SELECT doc_id, part, licence, yields, 2 * len(list_intersect(g.grams, t.grams)) / CAST(len(g.grams) + len(t.grams) AS DOUBLE) AS dice FROM g JOIN t ON len(g.grams) BETWEEN len(t.grams) * {THRESHOLD / (2 - THRESHOLD)} - 0.000001 AND len(t.grams) * {(2 - THRESHOLD) / THRESHOLD} + 0.000001),
  tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY dice DESC, licence) AS rn FROM m WHERE dice >= {THRESHOLD}) WHERE rn = 1),
  b AS (SELECT doc_id, count(*) AS n, list(DISTINCT licence) AS names FROM tops GROUP BY doc_id),
  best AS (SELECT doc_id, licence, dice FROM (SELECT t.doc_id, licence, dice, row_number() OVER (PARTITION BY t.doc_id ORDER BY dice DESC, licence) AS rn FROM tops t JOIN b ON b.doc_id = t.doc_id WHERE NOT list_has_any(yields, names)) WHERE rn = 1)
SELECT d.doc_id, best.licence, coalesce(best.dice, 0) AS dice, coalesce(b.n, 0) AS n_matches FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN best ON best.doc_id = d.doc_id"""
