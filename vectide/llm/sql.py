"""DuckDB equivalents of the queries that SQL can express."""

OP10 = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM docs GROUP BY source
), weighted AS (
  SELECT *, CAST([5, 2, 1][rank % 3 + 1] AS DOUBLE) AS weight, CAST([0.4, 0.0, -0.4][rank % 3 + 1] AS DOUBLE) AS ramp,
         3.0::DOUBLE * source_size AS cap
  FROM sizes
), leveled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighted WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, ramp, least(cap, max(level) OVER () * weight) AS target FROM leveled
), placed AS (
  SELECT docs.*, source_size, ramp, target,
         coalesce(sum(size) OVER (PARTITION BY docs.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source
), taken AS (
  SELECT *, CAST(CASE WHEN size > 0 THEN whole + CAST(before + size / 2.0::DOUBLE <= target - whole * source_size AS INT) ELSE 0 END AS BIGINT) AS copies,
         greatest(least((before + size / 2.0::DOUBLE) / greatest(target, 1.0), 1.0), 0.0) AS x
  FROM placed
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies,
       CASE WHEN copies > 0 THEN CASE WHEN abs(ramp) < 1e-9 THEN x
            ELSE ((1 + ramp) - sqrt(greatest((1 + ramp) * (1 + ramp) - 4 * ramp * x, 0.0))) / (2 * ramp) END END AS position
FROM taken
"""

OP2 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), placed AS (
  SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)
), repeats AS (
  SELECT doc_id, i FROM windows WHERE run IN (SELECT run FROM windows GROUP BY run HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM repeats
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

OP4 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS shingle FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)
), edges AS (
  SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links
), reached(node, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT node, b FROM reached JOIN edges ON other = a
), least AS (
  SELECT node, min(other) AS component_id FROM reached GROUP BY node
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

ORACLES = {"op2_substrings": OP2, "op4_minhash": OP4, "op10_mixing": OP10}
