"""SQL for the queries that DuckDB can express over whole tables."""

WORDS = r"list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MINHASH = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
arcs AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT x, b FROM reach JOIN arcs ON a = y),
found AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM documents d JOIN found ON x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

SUBSTRING = rf"""
WITH w AS (SELECT doc_id, coalesce({WORDS}, []) AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS p FROM w),
k AS (SELECT doc_id, p, array_to_string(ws[p:p + 34], ' ') AS k FROM p),
again AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, p FROM k WHERE k IN (SELECT k FROM again)),
i AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
flagged AS (SELECT i.doc_id, i.i, word, coalesce(max(h.p) OVER (PARTITION BY i.doc_id ORDER BY i.i ROWS UNBOUNDED PRECEDING) >= i.i - 34, FALSE) AS gone FROM i LEFT JOIN hit h ON h.doc_id = i.doc_id AND h.p = i.i),
sums AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM flagged GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN sums ON sums.doc_id = w.doc_id
"""

HTML = r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|<footer>|$)', 1), '') AS x FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(?:p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM a),
u AS (SELECT page_id, url, replace(replace(replace(x, '&quot;', '"'), '&amp;', '&'), '&amp', '&') AS x FROM t),
s AS (SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM u)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM s
"""
