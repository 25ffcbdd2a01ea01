"""SQL twins of the registered queries, for DuckDB over the same tables."""

HOST_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, i + unnest([0, 1, 2]) AS p FROM again) GROUP BY r),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN repeats USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS bad FROM f GROUP BY source),
p AS (SELECT avg(bad / n) AS mean, var_pop(bad / n) AS var, avg(1.0 / n) AS per FROM h),
k AS (SELECT mean, CASE WHEN var - mean * (1 - mean) * per > 0
                        THEN least(greatest(mean * (1 - mean) / (var - mean * (1 - mean) * per) - 1, 1.0), 1e6)
                        ELSE 1e6 END AS strength FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (bad + mean * strength) / (n + strength) <= 0.5 AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source, k
"""

MIX = r"""
WITH RECURSIVE
d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
      FROM documents),
s AS (SELECT source, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][turn % 3 + 1] AS DOUBLE) AS weight FROM s),
v AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, turn) AS i FROM w),
l AS (SELECT i, source_size, weight,
             (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(CAST(sum(source_size * 3) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
             / sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM v),
t AS (SELECT source, turn, n_docs, source_size,
             least(CAST(source_size * 3 AS DOUBLE), weight * (SELECT arg_min(level, i) FROM l WHERE source_size * 3 / weight >= level)) AS target
      FROM w),
q AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS whole,
             least(greatest(CAST(ceil(n_docs / 256) AS BIGINT), 1), 65536) AS n_blocks FROM t),
r AS (SELECT *, greatest(target - whole * source_size, 0.0) AS rest, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS key FROM q),
b AS (SELECT d.doc_id, d.size, r.*,
             CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % n_blocks AS block,
             CAST('0x' || substr(md5('mix:doc:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
k AS (SELECT turn, block, any_value(key) AS key, CAST(sum(size) AS BIGINT) AS words, any_value(rest) AS rest FROM b GROUP BY turn, block),
a AS (SELECT turn, block, words, rest, sum(words) OVER (PARTITION BY turn ORDER BY CAST('0x' || substr(md5('mix:block:' || key || ':' || block), 1, 15) AS BIGINT), block
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after FROM k),
c AS (SELECT turn, block, after <= rest AS filled, after > rest AND after - words < rest AS part, rest - (after - words) AS room FROM a),
x AS (SELECT b.*, filled, part, room, row_number() OVER (PARTITION BY turn, block ORDER BY h, size, doc_id) AS n FROM b JOIN c USING (turn, block)),
f AS (SELECT turn, CAST(0 AS BIGINT) AS n, room AS room, false AS fits FROM c WHERE part
      UNION ALL
      SELECT x.turn, x.n, CASE WHEN x.size <= f.room THEN f.room - x.size ELSE f.room END, x.size <= f.room
      FROM f JOIN x ON x.turn = f.turn AND x.part AND x.n = f.n + 1)
SELECT x.doc_id, x.size, x.source_size, x.target,
       CAST(x.size * c.copies AS BIGINT) AS taken, c.copies
FROM x LEFT JOIN f ON f.turn = x.turn AND f.n = x.n AND x.part,
     LATERAL (SELECT CAST(x.whole + CASE WHEN x.whole < 3 AND (x.filled OR (x.part AND f.fits)) THEN 1 ELSE 0 END AS BIGINT) AS copies) AS c
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT a AS doc_id, b AS reached FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a),
m AS (SELECT doc_id, min(reached) AS least FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(least, doc_id)) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS least FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to
FROM f
"""

RESAMPLE = r"""
WITH k AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
               lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
x AS (SELECT 's' AS side, doc_id, row_number() OVER () AS r, text FROM documents
      UNION ALL SELECT 't', NULL, 0, text FROM benchmark),
w AS (SELECT side, doc_id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
f AS (SELECT side, r, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM w),
n AS (SELECT side, r, g, count(*) AS n FROM f GROUP BY ALL),
d AS (SELECT g, list_transform(range(1, 2 * octet_length(encode(g)), 2), lambda i: CAST('0x' || substr(hex(g), i, 2) AS BIGINT)) AS bytes
      FROM (SELECT DISTINCT g FROM n)),
b AS (SELECT g, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, y: xor(c >> 8, steps[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket
      FROM d, k),
c AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (WHERE side = 's'), 0) AS DOUBLE) AS s,
             CAST(coalesce(sum(n) FILTER (WHERE side = 't'), 0) AS DOUBLE) AS t FROM n JOIN b USING (g) GROUP BY bucket),
a AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM c),
v AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM c, a),
m AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS gain
      FROM n JOIN b USING (g) JOIN v USING (bucket) WHERE side = 's' GROUP BY r),
p AS (SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features,
             CASE WHEN n_features > 0 THEN CAST(floor(gain / n_features) AS BIGINT) ELSE 0 END AS weight,
             CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h
      FROM w LEFT JOIN m USING (r) WHERE side = 's'),
q AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score FROM p),
o AS (SELECT *, words >= 20 AS enough, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place FROM q)
SELECT doc_id, n_features, weight, score,
       CASE WHEN enough AND place <= (SELECT count(*) FILTER (WHERE enough) * 25 // 100 FROM o) THEN place END AS rank
FROM o
"""
