"""DuckDB SQL of the corpus queries that SQL can express, written from their contracts."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SOLID = r"'[^\x20\x09-\x0D]+'"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') AS x
       FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p) WHERE len(w) > 0),
dw AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS x
       FROM d, (SELECT DISTINCT n FROM bw) AS lengths, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS p) WHERE len(w) >= n),
h AS (SELECT doc_id, item, n, p FROM dw JOIN bw USING (n, x)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, n, p FROM h)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SOLID}) AS w FROM documents),
x AS (SELECT doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) AS k FROM d, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS p) WHERE len(w) >= 50),
m AS (SELECT k, min(doc_id) AS least FROM x GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM x JOIN m USING (k) WHERE doc_id > least),
kept AS (SELECT doc_id, word, q FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM d) ANTI JOIN gone USING (doc_id, q)),
j AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS t FROM kept GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN j USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SOLID}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN shared USING (g) JOIN s b ON a.g = b.g AND a.doc_id > b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 85 * (x.n + y.n - i)),
sym AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r(node, other) AS (SELECT u, v FROM sym UNION SELECT r.node, sym.v FROM r JOIN sym ON r.other = sym.u),
l AS (SELECT node AS doc_id, least(node, min(other)) AS low FROM r GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(low, doc_id) AS component_id, coalesce(low, doc_id) = doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id)
"""

SQL = {"op2_decontamination": DECONTAMINATION, "op8_minhash": NEAR_DUPLICATES, "op10_substring_dedup": SUBSTRING_DEDUP}
