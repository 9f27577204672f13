"""DuckDB SQL for the queries that SQL can express. Written from the contracts, not from the code."""

LEAKS = r"""
WITH w AS (
  SELECT doc_id, text, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
d AS (SELECT row_number() OVER () AS rid, doc_id, ws FROM w),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
iw AS (
  SELECT DISTINCT item, len(ws[s:s + 9]) AS n, array_to_string(ws[s:s + 9], ' ') AS win
  FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS t(s) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT rid, s, n, array_to_string(ws[s:s + n - 1], ' ') AS win
  FROM d, sizes, unnest(range(1, len(ws) - n + 2)) AS t(s)),
hits AS (SELECT rid, s, dw.n, item FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hits, unnest(range(s, s + n)) AS t(p) GROUP BY rid),
items AS (
  SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names
  FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN items USING (rid)
"""

NEAR = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1),
    lambda i: array_to_string(ws[i:i + 4], ' '))) AS sh
  FROM d WHERE len(ws) > 0),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * k >= 75 * (na + nb - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(x, y) AS (
  SELECT a, a FROM both_ways
  UNION
  SELECT r.x, l.b FROM reach r JOIN both_ways l ON r.y = l.a),
c AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(len(sh), 0) AS BIGINT) AS n_shingles, coalesce(m, d.doc_id) AS component_id,
  coalesce(m, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN c ON c.x = d.doc_id
"""

VECTORS = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b
  ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach(x, y) AS (
  SELECT a, a FROM links
  UNION
  SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a),
c AS (SELECT x, min(y) AS m FROM reach GROUP BY x),
n AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, coalesce(m, vec_id) AS component_id,
  coalesce(m, vec_id) = vec_id AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.x = vec_id
"""

PHRASES = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
w AS (
  SELECT rid, doc_id, s, sha256(array_to_string(ws[s:s + 49], ' ')) AS win
  FROM d, unnest(range(1, len(ws) - 48)) AS t(s)),
f AS (SELECT win, min(doc_id) AS m FROM w GROUP BY win),
gone AS (
  SELECT rid, list(DISTINCT p) AS ps
  FROM w JOIN f USING (win), unnest(range(s, s + 50)) AS t(p) WHERE m < doc_id GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(
    [ws[k] for k in range(1, len(ws) + 1) if ps IS NULL OR NOT list_contains(ps, k)], ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (rid)
"""

SUFFIXES = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT rid, doc_id, s, md5_number(substr(h, 2 * s + 1, 100)) AS win
  FROM d, unnest(range(0, length(h) // 2 - 49)) AS t(s)),
f AS (SELECT win, min(doc_id) AS m FROM w GROUP BY win HAVING count(*) > 1),
c AS (SELECT rid, s FROM w JOIN f USING (win) WHERE m < doc_id),
e AS (
  SELECT rid, s, CASE WHEN s <= lag(s) OVER (PARTITION BY rid ORDER BY s) + 50 THEN 0 ELSE 1 END AS fresh FROM c),
g AS (SELECT rid, s, sum(fresh) OVER (PARTITION BY rid ORDER BY s) AS grp FROM e),
spans AS (SELECT rid, grp, min(s) AS a, max(s) + 50 AS b FROM g GROUP BY rid, grp),
edges AS (
  SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS prev FROM spans),
kept AS (
  SELECT rid, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS k, max(b) AS last,
    CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans
  FROM edges JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

DRAWN = r"""
WITH RECURSIVE crc_steps(i, k, c) AS (
  SELECT i, 0, i FROM range(256) AS t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS tab FROM crc_steps WHERE k = 8),
both_sides AS (
  SELECT 's' AS side, row_number() OVER () AS rid, doc_id, text FROM documents
  UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark),
w AS (
  SELECT side, rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM both_sides),
f AS (
  SELECT side, rid, feature, count(*) AS n FROM (
    SELECT side, rid, unnest(ws) AS feature FROM w
    UNION ALL
    SELECT side, rid, ws[i] || ' ' || ws[i + 1] FROM w, unnest(range(1, len(ws))) AS t(i))
  GROUP BY ALL),
named AS (
  SELECT feature, CAST(xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, CAST(length(hex(encode(feature))) // 2 AS BIGINT)),
      lambda p: CAST(('0x' || substr(hex(encode(feature)), 2 * p + 1, 2)) AS BIGINT))),
    lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295) % 10000 AS INTEGER) AS bucket
  FROM (SELECT DISTINCT feature FROM f), crc_table),
fb AS (SELECT side, rid, bucket, sum(n) AS n FROM f JOIN named USING (feature) GROUP BY ALL),
buckets AS (
  SELECT b AS bucket, coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t
  FROM range(10000) AS x(b) LEFT JOIN fb ON fb.bucket = b GROUP BY b),
g AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE)
    / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM buckets),
d AS (
  SELECT rid, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight
  FROM fb JOIN g USING (bucket) WHERE side = 's' GROUP BY rid),
scores AS (
  SELECT rid, doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
      (CAST(('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) + 0.5::DOUBLE)
      / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN d USING (rid) WHERE side = 's'),
ranks AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n
  FROM scores WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (25 * n) // 100 THEN place END AS rank
FROM scores LEFT JOIN ranks USING (rid)
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
counted AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM w, unnest([1, 2, 3, 4, 5]) AS t(k), unnest(range(1, len(ws) - k + 2)) AS u(i)
  GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS p FROM counted WHERE k > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.a, j, x.f AS l, y.f AS r,
    CAST((1000 * CAST(c.a AS HUGEINT) * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM c JOIN n USING (lang), unnest(range(1, c.k)) AS t(j)
  JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.p[1:j], ' ')
  JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.p[j + 1:], ' ')),
best AS (SELECT lang, phrase, a, min(struct_pack(score := score, j := j, l := l, r := r)) AS b FROM cuts GROUP BY ALL),
inside AS (
  SELECT lang, array_to_string(p[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM c, unnest(range(2, k)) AS t(m), unnest(range(1, k - m + 2)) AS u(i) GROUP BY ALL),
kept AS (
  SELECT lang, phrase, a, b.l AS l, b.r AS r, b.score AS score,
    row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, encode(phrase)) AS rank
  FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) WHERE rank <= 2000
"""
