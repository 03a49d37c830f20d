"""DuckDB SQL of operators that SQL can express, written from their definitions and not from their plans."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
_DOCS = f"d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
word AS (SELECT r, generate_subscripts(w, 1) AS k, unnest(w) AS x FROM d),
five AS (SELECT r, x || ' ' || lead(x, 1) OVER p || ' ' || lead(x, 2) OVER p || ' ' || lead(x, 3) OVER p || ' ' || lead(x, 4) OVER p AS s FROM word WINDOW p AS (PARTITION BY r ORDER BY k)),
sh AS (SELECT DISTINCT r, s FROM five WHERE s IS NOT NULL UNION ALL SELECT r, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
pair AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.r < b.r GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(r, o) AS (SELECT r, r FROM d UNION SELECT reach.r, b FROM reach JOIN edge ON o = a)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(x.doc_id) AS component_id
FROM reach JOIN d USING (r) JOIN d x ON x.r = reach.o LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id"""

REPEATS = f"""
WITH {_DOCS},
word AS (SELECT r, generate_subscripts(w, 1) AS k, unnest(w) AS x FROM d),
w1 AS (SELECT r, k, md5(x) AS a FROM word),
w2 AS (SELECT r, k, a, md5(a || lead(a, 1) OVER p) AS b FROM w1 WINDOW p AS (PARTITION BY r ORDER BY k)),
w4 AS (SELECT r, k, a, b, md5(b || lead(b, 2) OVER p) AS c FROM w2 WINDOW p AS (PARTITION BY r ORDER BY k)),
w8 AS (SELECT r, k, a, b, md5(c || lead(c, 4) OVER p) AS c FROM w4 WINDOW p AS (PARTITION BY r ORDER BY k)),
w16 AS (SELECT r, k, a, b, md5(c || lead(c, 8) OVER p) AS c FROM w8 WINDOW p AS (PARTITION BY r ORDER BY k)),
w32 AS (SELECT r, k, a, b, md5(c || lead(c, 16) OVER p) AS c FROM w16 WINDOW p AS (PARTITION BY r ORDER BY k)),
win AS (SELECT r, k, md5(c || lead(b, 32) OVER p || lead(a, 34) OVER p) AS s FROM w32 WINDOW p AS (PARTITION BY r ORDER BY k)),
many AS (SELECT s FROM win WHERE s IS NOT NULL GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(k, k + 35)) AS k FROM win JOIN many USING (s)),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS s FROM word ANTI JOIN gone USING (r, k) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""

QUALITY = f"""
WITH {_DOCS},
word AS (SELECT r, generate_subscripts(w, 1) AS k, unnest(w) AS x FROM d),
tri AS (SELECT r, k, x || ' ' || lead(x, 1) OVER p || ' ' || lead(x, 2) OVER p AS s FROM word WINDOW p AS (PARTITION BY r ORDER BY k)),
twice AS (SELECT r, s FROM tri WHERE s IS NOT NULL GROUP BY r, s HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT k + j) AS n FROM tri JOIN twice USING (r, s), range(3) g(j) GROUP BY r),
line AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS x FROM d),
m AS (SELECT d.r, doc_id, len(w) AS nw, length(array_to_string(w, '')) AS wc, strlen(array_to_string(w, '')) AS wb, coalesce(list_max(list_transform(w, lambda x: strlen(x))), 0) AS longest, len(list_distinct(w)) AS own,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS sy, length(regexp_replace(t, '[^A-Za-z\\x{{80}}-\\x{{10FFFF}}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\\x{{800}}-\\x{{10FFFF}}]', '', 'g')) AS wide,
  len(x) - len(list_distinct(x)) AS dup, coalesce(rep.n, 0) AS rw FROM d JOIN line USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, CAST(nw AS BIGINT) AS n_words, CAST(wc AS BIGINT) AS word_chars, CAST(sy AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines, CAST(rw AS BIGINT) AS n_repeat_words,
  nw < 50 OR 100 * rw > 50 * nw AS base_failed,
  NOT (nw < 50 OR 100 * rw > 50 * nw OR 10 * sy > nw OR wc < 2 * nw OR (wc > 15 * nw AND 2 * wide <= wc AND 2 * longest <= wb) OR 10 * letters < 6 * wc
    OR (longest > 1000 AND 2 * longest > wb AND 2 * wide <= wc) OR 20 * own < least(nw, 2000)) AS kept FROM m"""

TOP_K = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS q, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

ORACLE_SQL = {"op1_jaccard_components": JACCARD, "op5_recompression_dedup": REPEATS, "op7_quality_cascade": QUALITY, "op10_pivot_topk": TOP_K}
