"""DuckDB SQL for the operators that SQL can express over whole tables."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLAIN = r"[^\x20\x09-\x0D]+"

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_PLAIN}'), []) AS w FROM documents),
windows AS (SELECT doc_id, k, sha256(array_to_string(list_slice(w, k, k + 34), ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) t(k)),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS p FROM windows WHERE h IN (SELECT h FROM twice)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY words.p) AS s FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

DECONTAMINATE = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_ALNUM}'), []) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, coalesce(regexp_extract_all({_LOWER}, '{_ALNUM}'), []) AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, k, k + least(10, len(w)) - 1), ' ') AS win FROM i, unnest(range(1, greatest(len(w) - 8, 2))) t(k) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS win FROM d, lens, unnest(range(1, len(w) - n + 2)) t(k)),
hits AS (SELECT doc_id, k, dw.n, item FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""

JACCARD_JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_PLAIN}'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, k, k + 4), ' ')) AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) t(k) WHERE len(w) > 0),
sets AS (SELECT doc_id, count(*) AS n, sha256(string_agg(CAST(g AS VARCHAR), ',' ORDER BY g)) AS h FROM s GROUP BY doc_id),
classes AS (SELECT h, min(doc_id) AS c, any_value(n) AS n FROM sets GROUP BY h),
shared AS (SELECT g FROM s WHERE doc_id IN (SELECT c FROM classes) GROUP BY g HAVING count(*) > 1),
shared_of AS (SELECT doc_id, g FROM s WHERE doc_id IN (SELECT c FROM classes) AND g IN (SELECT g FROM shared)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shared_of a JOIN shared_of b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN classes x ON x.c = a JOIN classes y ON y.c = b WHERE 5 * pairs.n >= 4 * (x.n + y.n - pairs.n)),
walk(a, b) AS (SELECT c, c FROM classes UNION SELECT walk.a, links.b FROM walk JOIN links ON links.a = walk.b),
grouped AS (SELECT a, min(b) AS class_id FROM walk GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT d.doc_id, coalesce(grouped.class_id, d.doc_id) AS class_id, CAST(coalesce(counted.n, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN sets ON sets.doc_id = d.doc_id LEFT JOIN classes ON classes.h = sets.h LEFT JOIN grouped ON grouped.a = classes.c LEFT JOIN counted ON counted.a = classes.c
"""

VECTOR_CODES = """
WITH v AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comp AS (SELECT vec_id, i, (i - 1) * 16 // len(embedding) AS p, CAST(floor(256 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM v, unnest(range(1, len(embedding) + 1)) t(i)),
entries AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT 64),
b0 AS (SELECT i, p, e, x AS c FROM comp JOIN entries USING (vec_id)),
a0 AS (SELECT vec_id, p, min(d * 64 + e) AS m FROM (SELECT vec_id, comp.p, e, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM comp JOIN b0 ON comp.i = b0.i GROUP BY ALL) GROUP BY vec_id, p),
n0 AS (SELECT i, comp.p, m % 64 AS e, CAST(floor(sum(x) / count(*)) AS BIGINT) AS c FROM comp JOIN a0 ON a0.vec_id = comp.vec_id AND a0.p = comp.p GROUP BY ALL),
b1 AS (SELECT b0.i, b0.p, b0.e, coalesce(n0.c, b0.c) AS c FROM b0 LEFT JOIN n0 ON n0.i = b0.i AND n0.e = b0.e),
a1 AS (SELECT vec_id, p, min(d * 64 + e) AS m FROM (SELECT vec_id, comp.p, e, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM comp JOIN b1 ON comp.i = b1.i GROUP BY ALL) GROUP BY vec_id, p),
n1 AS (SELECT i, comp.p, m % 64 AS e, CAST(floor(sum(x) / count(*)) AS BIGINT) AS c FROM comp JOIN a1 ON a1.vec_id = comp.vec_id AND a1.p = comp.p GROUP BY ALL),
b2 AS (SELECT b1.i, b1.p, b1.e, coalesce(n1.c, b1.c) AS c FROM b1 LEFT JOIN n1 ON n1.i = b1.i AND n1.e = b1.e),
a2 AS (SELECT vec_id, p, min(d * 64 + e) AS m FROM (SELECT vec_id, comp.p, e, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM comp JOIN b2 ON comp.i = b2.i GROUP BY ALL) GROUP BY vec_id, p),
codes AS (SELECT vec_id, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
by_label AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM codes JOIN v USING (vec_id) GROUP BY label),
books AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM b2)
SELECT codes.vec_id, code, error, label_error, h AS codebooks_sha256 FROM codes JOIN v USING (vec_id) JOIN by_label ON by_label.label IS NOT DISTINCT FROM v.label, books
"""

RANKED_SEARCH = rf"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{_ALNUM}')) AS term FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
size AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
q AS (SELECT item_id, term, count(*) AS r FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{_ALNUM}')) AS term FROM benchmark) GROUP BY item_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, size WHERE term IN (SELECT term FROM q) GROUP BY term),
scored AS (SELECT item_id, tf.doc_id, CAST(sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN tf ON tf.term = q.term JOIN w ON w.term = q.term JOIN n ON n.doc_id = tf.doc_id, size GROUP BY item_id, tf.doc_id),
placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""
