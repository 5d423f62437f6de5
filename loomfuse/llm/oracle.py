"""DuckDB SQL of the queries that SQL can express."""

WS = r"[\x20\x09-\x0D]+"
#: A word as the contracts define it; texts are whole.
_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

OP2 = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
first AS (SELECT g, min(doc_id) AS owner FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (g) WHERE doc_id > owner),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
each AS (SELECT doc_id, p, w FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS w FROM d)),
kept AS (SELECT each.doc_id, string_agg(each.w, ' ' ORDER BY each.p) AS t FROM each LEFT JOIN gone USING (doc_id, p) WHERE gone.p IS NULL GROUP BY each.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP7 = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS p FROM documents),
k AS (SELECT doc_id, p, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.*, coalesce(doc_id > owner, false) AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
l AS (SELECT doc_id, host, line, regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g') <> '' AS worded, lower(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS norm FROM (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d)),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE worded GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT doc_id) AS host_docs FROM d GROUP BY host),
often AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT doc_id) AS n FROM l WHERE worded GROUP BY host, norm) JOIN hosts USING (host) WHERE n > 20 AND n > 0.02 * host_docs),
gone AS (SELECT doc_id, CAST(sum(length(line)) AS BIGINT) AS removed FROM l JOIN often USING (host, norm) WHERE worded GROUP BY doc_id),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, y, z) AS c FROM (SELECT doc_id, i, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3))),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM g WHERE c > 1) GROUP BY doc_id),
s AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(removed, 0) AS removed_chars FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_chars, NOT base_failed AND removed_chars <= 0.5 * (word_chars + n_words) AS kept FROM f
"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_transform({_WORDS}, lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY x, y),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x AS doc_id, min(y) AS component FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP4 = """
WITH base AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
pair AS (SELECT 'x' AS r, * FROM base
  UNION ALL SELECT 'y', page_id, url, CASE WHEN page_id % 100 = 3 THEN substr(html, 1, 20) || '?' || substr(html, 22) ELSE html END FROM base WHERE coalesce(page_id % 100 <> 7, true)
  UNION ALL SELECT 'y', page_id, url, html || '<!-- again -->' FROM base WHERE page_id % 100 = 11),
text AS (SELECT r, page_id, 'WARC/1.0' || nl || 'WARC-Type: response' || nl || 'WARC-Record-ID: <urn:page:' || page_id || '>' || nl || 'WARC-Target-URI: ' || url || nl || 'Content-Length: ' || strlen(html) || nl || nl || html || nl || nl AS t
  FROM pair, (SELECT chr(13) || chr(10) AS nl)),
rec AS (SELECT r, CAST(floor(page_id / 1000) AS BIGINT) AS file, page_id, sha256(t) AS digest, count(*) AS n, CAST(strlen(any_value(t)) AS BIGINT) AS len FROM text GROUP BY r, page_id, sha256(t)),
laid AS (SELECT *, CAST(sum(n * len) OVER (PARTITION BY r, file ORDER BY page_id, digest) - n * len AS BIGINT) AS off FROM rec),
x AS (SELECT * FROM laid WHERE r = 'x'), y AS (SELECT * FROM laid WHERE r = 'y'),
only_x AS (SELECT *, row_number() OVER (PARTITION BY file, page_id ORDER BY digest) AS copy FROM (SELECT x.*, unnest(range(x.n - coalesce(y.n, 0))) AS i FROM x LEFT JOIN y USING (file, page_id, digest) WHERE x.n > coalesce(y.n, 0))),
only_y AS (SELECT *, row_number() OVER (PARTITION BY file, page_id ORDER BY digest) AS copy FROM (SELECT y.*, unnest(range(y.n - coalesce(x.n, 0))) AS i FROM y LEFT JOIN x USING (file, page_id, digest) WHERE y.n > coalesce(x.n, 0)))
SELECT coalesce(a.file, b.file) AS file, coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.copy, b.copy) AS copy, coalesce(a.off, b.off) AS "offset", coalesce(a.len, b.len) AS length, a.digest AS expected, b.digest AS found,
  CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'extra' ELSE 'changed' END AS status
FROM only_x a FULL JOIN only_y b ON a.file = b.file AND a.page_id = b.page_id AND a.copy = b.copy
"""

ORACLE = {"op4_warc_audit": OP4, "op6_jaccard_join": OP6, "op2_decontaminate": OP2, "op3_substring_dedup": OP3, "op7_line_dedup": OP7, "op9_quality_rules": OP9}
