"""DuckDB SQL for the queries that SQL can express."""

_REACH = """
reach AS (
  SELECT {id} AS a, {id} AS b FROM {nodes}
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)"""

_SHINGLES = r"""
words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle, len(w) < 5 AS whole
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.whole = b.whole AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b
  WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near)"""

_VECTORS = """
sound AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9)"""

# Bytes are written as hex digits, two to a byte.
_REPEATS = """
bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 400) AS w
  FROM (SELECT doc_id, h, unnest(range(0, strlen(h) // 2 - 199)) AS i FROM bytes WHERE strlen(h) >= 400)),
twice AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
starts AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM windows JOIN twice USING (w)),
runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (
    SELECT *, sum(CASE WHEN i - before <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM starts)
  GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS kept_from FROM runs),
kept AS (
  SELECT g.doc_id, sum(g.b - g.a) AS n_removed, count(*) AS n_spans, max(g.b) AS last,
         string_agg(substr(h, 2 * kept_from + 1, 2 * (g.a - kept_from)), '' ORDER BY g.a) AS head
  FROM gaps g JOIN bytes USING (doc_id) GROUP BY g.doc_id)"""

_TERMS = r"""
terms AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
        FROM documents)),
kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
here AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
langs AS (SELECT g.lang, count(k.term) AS v, coalesce(sum(k.n), 0) AS total
          FROM (SELECT DISTINCT lang FROM groups) g LEFT JOIN kept k USING (lang) GROUP BY g.lang),
sizes AS (SELECT g.lang, g.source, coalesce(sum(h.n), 0) AS total FROM groups g LEFT JOIN here h USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT s.lang, s.source, k.term, coalesce(h.n, 0) AS n,
         1 + (CAST(1000000000 AS HUGEINT) * (coalesce(h.n, 0) + 5)) // CAST(s.total + 5 * l.v AS HUGEINT) AS p,
         1 + (CAST(1000000000 AS HUGEINT) * (k.n + 5)) // CAST(l.total + 5 * l.v AS HUGEINT) AS q
  FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN here h ON h.lang = s.lang AND h.source = s.source AND h.term = k.term),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE n > 0 AND p > q)"""

_PHRASES = r"""
pieces AS (
  SELECT row_number() OVER () AS piece, lang, piece AS body FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
words AS (SELECT lang, regexp_extract_all(body, '[^\x20\x09]+') AS w FROM pieces),
one AS (SELECT lang, unnest(w) AS p FROM words),
two AS (SELECT lang, array_to_string(w[i : i + 1], ' ') AS p FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM words)),
three AS (SELECT lang, array_to_string(w[i : i + 2], ' ') AS p FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
f AS (SELECT lang, p, count(*) AS f, 1 AS k FROM one GROUP BY ALL
      UNION ALL SELECT lang, p, count(*), 2 FROM two GROUP BY ALL UNION ALL SELECT lang, p, count(*), 3 FROM three GROUP BY ALL),
candidates AS (SELECT lang, p, f AS a, k, string_split(p, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.p, c.a, x.f AS l, y.f AS r, cut, (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN f x ON x.lang = c.lang AND x.p = array_to_string(c.w[1 : cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.p = array_to_string(c.w[cut + 1 : c.k], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.p ORDER BY score, cut) = 1),
within AS (
  SELECT lang, p, max(a) AS most FROM (
    SELECT lang, array_to_string(w[1 : 2], ' ') AS p, a FROM candidates WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2 : 3], ' '), a FROM candidates WHERE k = 3) GROUP BY lang, p)"""

ORACLE = {
    "op2_prefix_tree_join": f"""WITH RECURSIVE {_SHINGLES},{_REACH.format(id="doc_id", nodes="documents")}
SELECT d.doc_id, CAST(coalesce(max(s.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op5_spherical_cells": f"""WITH RECURSIVE {_VECTORS},{_REACH.format(id="vec_id", nodes="embeddings")},
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_links, min(r.b) AS component_id, vec_id = min(r.b) AS kept
FROM embeddings JOIN reach r ON r.a = vec_id LEFT JOIN counts c ON c.a = vec_id GROUP BY vec_id""",
    "op6_interval_tree": f"""WITH {_REPEATS}
SELECT doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM bytes LEFT JOIN kept USING (doc_id)""",
    "op11_arrow_divergence": f"""WITH {_TERMS}
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found
QUALIFY part = 'pair' OR rank <= 50""",
    "op13_setm_phrases": f"""WITH {_PHRASES}
SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY c.score DESC, c.a DESC, c.p) AS rank, c.p AS phrase, c.a, c.l, c.r,
       (SELECT sum(f) FROM f WHERE f.lang = c.lang AND k = 1)::BIGINT AS n, c.score::BIGINT AS score
FROM cuts c LEFT JOIN within i ON i.lang = c.lang AND i.p = c.p WHERE i.most IS NULL OR 100 * i.most < 50 * c.a
QUALIFY rank <= 2000""",
}
