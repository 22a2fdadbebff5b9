"""SQL counterparts of text operators, straight from their contracts, for DuckDB."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every pair of documents that shares a shingle is counted; groups are what each document reaches.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^ \x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS g FROM s),
n AS MATERIALIZED (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN sh ON sh.doc_id = w.doc_id GROUP BY 1),
shared AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, seen) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.seen),
least AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN least USING (doc_id)
"""

#: Windows of every width that items have, compared as texts.
DECONTAMINATION = rf"""
WITH i AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS words FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT item_id, words, least(10, len(words)) AS n, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i0 FROM i WHERE len(words) > 0),
keys AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(words[i0:i0 + n - 1], ' ') AS k FROM iw),
d AS MATERIALIZED (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS words FROM documents),
widths AS (SELECT DISTINCT n FROM keys),
dw AS (SELECT row_id, words, n, unnest(range(1, len(words) - n + 2)) AS i0 FROM d CROSS JOIN widths WHERE len(words) >= n),
hits AS MATERIALIZED (SELECT row_id, i0, dw.n, item_id FROM dw JOIN keys ON keys.n = dw.n AND keys.k = array_to_string(words[i0:i0 + dw.n - 1], ' ')),
places AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(i0, i0 + n)) AS p FROM (SELECT DISTINCT row_id, i0, n FROM hits)) GROUP BY 1),
found AS (SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (row_id) LEFT JOIN found USING (row_id)
"""

#: Every prefix of every rebuilt conversation as a list of turn numbers; CRC-32 is worked out bit by bit.
PREFIX_TRIE = """
WITH RECURSIVE turns AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n,
  dense_rank() OVER (ORDER BY coalesce(role, ''), coalesce(text, '')) AS id, length(coalesce(text, '')) AS len FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS c, count(*) AS own FROM turns GROUP BY 1),
crc(conv_id, c, bit, v) AS (SELECT conv_id, c, 0, 4294967295::BIGINT FROM convs UNION ALL
  SELECT conv_id, c, bit + 1, CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
  FROM (SELECT conv_id, c, bit, CASE WHEN bit % 8 = 0 THEN xor(v, ascii(substr(c, bit // 8 + 1, 1))::BIGINT) ELSE v END AS x FROM crc WHERE bit < 8 * length(c))),
h AS MATERIALIZED (SELECT conv_id, xor(v, 4294967295::BIGINT) % 6 AS h, conv_id - conv_id % 100 AS base FROM crc WHERE bit = 8 * length(c)),
heads AS (SELECT h.conv_id, t.n AS pos, t.id, t.len FROM h JOIN turns t ON t.conv_id = h.base AND t.n <= h.h),
taken AS (SELECT conv_id, count(*) AS k FROM heads GROUP BY 1),
rebuilt AS (SELECT * FROM heads UNION ALL SELECT h.conv_id, coalesce(k, 0) + t.n - h.h, t.id, t.len FROM h JOIN turns t ON t.conv_id = h.conv_id AND t.n > h.h LEFT JOIN taken ON taken.conv_id = h.conv_id),
lists AS MATERIALIZED (SELECT h.conv_id, coalesce(list(id ORDER BY pos) FILTER (id IS NOT NULL), []) AS ids, coalesce(list(len ORDER BY pos) FILTER (id IS NOT NULL), []) AS lens FROM h LEFT JOIN rebuilt ON rebuilt.conv_id = h.conv_id GROUP BY 1),
steps AS (SELECT conv_id, ids, lens, unnest(range(0, len(ids) + 1)) AS depth FROM lists),
members AS MATERIALIZED (SELECT conv_id, depth, ids[1:depth] AS path, CASE WHEN depth = 0 THEN 0 ELSE lens[depth] END AS len, depth = len(ids) AS ends FROM steps),
nodes AS MATERIALIZED (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(len) AS len, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY 1, 2),
kids AS MATERIALIZED (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
own AS (SELECT n.path, n.depth, (n.n_convs - 1) * n.len AS saved, CASE WHEN k.path IS NULL THEN 1 ELSE 0 END AS leaf FROM nodes n LEFT JOIN kids k ON k.path = n.path),
above AS (SELECT path[1:up] AS path, saved, leaf FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM own)),
totals AS (SELECT path, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM above GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, t.n_leaves, t.saved_tokens, n.ends_sha256
FROM nodes n JOIN totals t ON t.path = n.path LEFT JOIN kids k ON k.path = n.path LEFT JOIN nodes p ON p.path = n.path[1:n.depth - 1] AND n.depth > 0
"""
