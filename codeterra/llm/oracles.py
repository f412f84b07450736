"""The same results in DuckDB's SQL, where SQL can express them. Written apart from the Spark code, by plain definitions."""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"

JACCARD_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')]
    ELSE list_distinct(list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' '))) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s),
links AS (
  SELECT x.doc_id AS u, y.doc_id AS v FROM e x JOIN e y ON x.gram = y.gram AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach(doc_id, r) AS (SELECT u, v FROM links UNION SELECT reach.doc_id, links.v FROM reach JOIN links ON reach.r = links.u)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(reach.r), s.doc_id)) AS component_id
FROM s LEFT JOIN reach ON reach.doc_id = s.doc_id GROUP BY s.doc_id, len(s.g)
"""

_PLAIN_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

WINNOWING = rf"""
WITH d AS (SELECT doc_id, {_PLAIN_WORDS} AS a FROM documents),
b AS (SELECT item_id, {_PLAIN_WORDS} AS a FROM benchmark),
w AS (
  SELECT DISTINCT item_id, k, array_to_string(a[i:i + k - 1], ' ') AS run
  FROM (SELECT item_id, a, least(len(a), 10) AS k, unnest(range(1, len(a) - least(len(a), 10) + 2)) AS i FROM b WHERE len(a) > 0)),
p AS (
  SELECT doc_id, k, i, array_to_string(a[i:i + k - 1], ' ') AS run
  FROM (SELECT doc_id, a, k, unnest(range(1, len(a) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM w) WHERE len(a) >= k)),
hit AS (SELECT doc_id, p.k, i, item_id FROM p JOIN w ON p.k = w.k AND p.run = w.run),
n_hit AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(a) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, CAST(len(coalesce(ids, [])) AS BIGINT) AS n_items,
  sha256(array_to_string(coalesce(ids, []), ',')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(a[i:i + 49], ' ')) AS run FROM (SELECT doc_id, a, unnest(range(1, len(a) - 48)) AS i FROM d WHERE len(a) >= 50)),
low AS (SELECT run, min(doc_id) AS low FROM w GROUP BY run),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS x FROM w JOIN low USING (run) WHERE low < doc_id),
gone_of AS (SELECT doc_id, list(x) AS xs, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(a) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN a ELSE list_filter(a, lambda word, x: NOT list_contains(xs, x)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone_of USING (doc_id)
"""

SECRETS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (
  SELECT * FROM (VALUES
    ('assign', 0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
    ('access', 1, 'AKIA[A-Z0-9]+', 0, 20), ('hex', 2, '[0-9a-f]+', 0, 24)) v(kind, rank, p, g, least)),
m AS (
  SELECT doc_id, kind, rank, t, CASE rank WHEN 0 THEN regexp_extract_all(t, (SELECT p FROM k WHERE rank = 0)) WHEN 1 THEN regexp_extract_all(t, (SELECT p FROM k WHERE rank = 1)) ELSE regexp_extract_all(t, (SELECT p FROM k WHERE rank = 2)) END AS a, g, least, p
  FROM d CROSS JOIN k WHERE regexp_matches(t, CASE rank WHEN 0 THEN (SELECT p FROM k WHERE rank = 0) WHEN 1 THEN 'AKIA[A-Z0-9]' ELSE '[0-9a-f]{24}' END)),
s AS (
  WITH RECURSIVE r(doc_id, kind, rank, i, rest, past, a, w, start) AS (
    SELECT doc_id, kind, rank, CAST(0 AS BIGINT), t, CAST(0 AS BIGINT), a, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT) FROM m
    UNION ALL
    SELECT doc_id, kind, rank, i + 1, substr(rest, here + length(x)), past + here - 1 + length(x), a, x, past + here - 1
    FROM (SELECT *, a[i + 1] AS x, instr(rest, a[i + 1]) AS here FROM r WHERE i < len(a)))
  SELECT doc_id, kind, rank, w, start, start + length(w) AS stop FROM r WHERE w IS NOT NULL),
ok AS (
  SELECT doc_id, kind, rank, start, stop FROM s
  WHERE CASE rank WHEN 0 THEN length(regexp_extract(w, (SELECT p FROM k WHERE rank = 0), 2)) >= 6 WHEN 1 THEN length(w) >= 20 ELSE length(w) >= 24 END),
g AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM ok GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""

URL_FILTER = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_UPPER.lower()}') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) v(verdict, h, q)),
best AS (
  SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS verdict
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)
"""

CURRICULUM = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][k % 3 + 1]::DOUBLE AS weight, [1.0, 0.5, 1.5][k % 3 + 1]::DOUBLE AS a, [1.0, 1.5, 0.5][k % 3 + 1]::DOUBLE AS b FROM s),
o AS (
  SELECT *, 1.5 * sum(source_size) OVER () - coalesce(2 * sum(source_size) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (u ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights, row_number() OVER u AS turn
  FROM w WINDOW u AS (ORDER BY source_size / weight, k)),
level AS (SELECT arg_min(CAST(rest AS DOUBLE) / CAST(weights AS DOUBLE), turn) AS level FROM o WHERE CAST(rest AS DOUBLE) / CAST(weights AS DOUBLE) * weight <= 2 * source_size),
t AS (SELECT source, source_size, a, b, least(2.0::DOUBLE * source_size, weight * level) AS target FROM w CROSS JOIN level),
r AS (SELECT doc_id, source, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before FROM d),
p AS (
  SELECT doc_id, size, source_size, target, a, b, before,
    greatest(0, least(size, CAST(floor(target) AS BIGINT) - before)) + greatest(0, least(size, CAST(floor(target) AS BIGINT) - before - source_size)) AS taken
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, before / target * ((a + b) / 2) AS area FROM p)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN CASE WHEN area <= 0 THEN 0.0::DOUBLE ELSE 2 * area / (a + sqrt(greatest(a * a + 2 * (b - a) * area, 0))) END END AS position
FROM q
"""
