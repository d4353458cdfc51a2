"""DuckDB statements for the queries whose results SQL can tell on tables of test size."""

#: All documents with a common shingle are counted against each other; the reachable
#: smallest id by recursion.
NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN sh USING (doc_id) GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, comp) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.id WHERE r.comp < e.b),
c AS (SELECT id, min(comp) AS comp FROM r GROUP BY id)
SELECT doc_id, n AS n_shingles, comp AS component_id, doc_id = comp AS kept FROM n JOIN c ON c.id = doc_id"""

#: Every string of 100 bytes by two hashes, the runs of those that stand earlier, and what
#: is left between them.
REPEATED_STRINGS = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
s AS (SELECT doc_id, i, hash(t[i:i + 99]) AS h1, hash(t[i:i + 99], 7) AS h2 FROM (SELECT doc_id, t, unnest(range(1, octet_length(t) - 98)) AS i FROM d)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h1, h2 ORDER BY doc_id, i) > 1 AS again FROM s),
g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM f WHERE again),
k AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 99 AS b FROM k GROUP BY 1, 2),
c AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) + 1 AS a, a - 1 AS b, row_number() OVER w AS o FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY a)
      UNION ALL SELECT doc_id, max(b) + 1, NULL, 1000000000 FROM r GROUP BY 1),
kept AS (SELECT c.doc_id, string_agg(hex(t[c.a:coalesce(c.b, octet_length(t))]), '' ORDER BY o) AS x FROM c JOIN d ON c.doc_id = d.doc_id GROUP BY 1),
n AS (SELECT doc_id, sum(b - a + 1) AS removed, count(*) AS spans FROM r GROUP BY 1)
SELECT d.doc_id, octet_length(t)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(CASE WHEN x IS NULL THEN t ELSE unhex(x) END) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""
