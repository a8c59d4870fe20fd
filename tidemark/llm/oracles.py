"""SQL of the deduplicating queries for another engine: all pairs that share a shingle, all 50-byte strings."""

MINHASH = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_sort(CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM split),
nodes AS MATERIALIZED (SELECT s, min(doc_id) AS node FROM sets WHERE len(s) > 0 GROUP BY s),
elements AS MATERIALIZED (SELECT node, len(s) AS n, unnest(s) AS x FROM nodes),
links AS MATERIALIZED (
  SELECT a.node AS a, b.node AS b FROM elements a JOIN elements b ON a.x = b.x AND a.node < b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(node, root) AS (
  SELECT node, node FROM nodes
  UNION SELECT b, root FROM reached JOIN both_ways ON node = a WHERE root < b),
component AS (SELECT node, min(root) AS root FROM reached GROUP BY node)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, doc_id = coalesce(root, doc_id) AS kept
FROM sets LEFT JOIN nodes ON sets.s = nodes.s LEFT JOIN component USING (node)
"""

SUFFIX = """
WITH whole AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
pieces AS (SELECT doc_id, p * 1000 AS base, substr(x, p * 2000 + 1, 2098) AS x FROM (SELECT doc_id, x, unnest(range(0, n // 1000 + 1)) AS p FROM whole)),
strings AS MATERIALIZED (
  SELECT doc_id, base + j AS i, hash(substr(x, 2 * j + 1, 100)) AS h
  FROM (SELECT doc_id, base, x, unnest(range(0, least(1000, len(x) // 2 - 49))) AS j FROM pieces)),
firsts AS (SELECT h, min(doc_id) AS f FROM strings GROUP BY h),
hits AS (SELECT doc_id, i, i - lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) > 50 AS fresh FROM strings JOIN firsts USING (h) WHERE f < doc_id),
runs AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hits),
spans AS MATERIALIZED (SELECT doc_id, min(i) AS lo, max(i) + 50 AS hi FROM runs GROUP BY doc_id, r),
edges AS (SELECT doc_id, lo, hi FROM spans UNION ALL SELECT doc_id, n, n FROM whole),
kept AS (
  SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (lo - a)), '' ORDER BY lo, hi) AS k
  FROM (SELECT doc_id, x, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo, hi) AS a FROM edges JOIN whole USING (doc_id)) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM whole JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS n_spans FROM spans GROUP BY doc_id) USING (doc_id)
"""
