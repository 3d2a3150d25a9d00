"""SQL of the queries that SQL can express, for DuckDB over the same tables."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_COMPONENTS = "{0} AS (SELECT a AS x, b AS y FROM {1} UNION ALL SELECT b, a FROM {1}), reach(x, y) AS (SELECT x, y FROM {0} UNION SELECT r.x, e.y FROM reach r JOIN {0} e ON e.x = r.y), comp AS (SELECT x, least(x, min(y)) AS c FROM reach GROUP BY x)"

OP1 = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
o AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY cap / w, encode(source) NULLS LAST) AS k, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM o),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r),
t AS (SELECT arg_min(level, k) AS level FROM l WHERE cap / w >= level * (1 - 1e-12)),
q AS (SELECT source, source_size, n, cap, least(cap, coalesce(o.w * t.level, cap))::DOUBLE AS target FROM o, t),
b AS (SELECT source, round(log2(1 + size) * 32) / 32 AS x, sum(size)::DOUBLE AS tokens FROM d WHERE size > 0 GROUP BY ALL),
h AS (SELECT q.source, target, list({{'x': x, 'tokens': tokens}}) AS hist FROM q JOIN b ON q.source IS NOT DISTINCT FROM b.source WHERE target < cap * (1 - 1e-12) GROUP BY ALL),
e AS (SELECT source, target, hist, -64.0::DOUBLE AS lo, 64.0::DOUBLE AS hi, 0 AS i FROM h
UNION ALL SELECT source, target, hist, CASE WHEN g > target THEN lo ELSE (lo + hi) / 2 END, CASE WHEN g > target THEN (lo + hi) / 2 ELSE hi END, i + 1 FROM (SELECT *, list_sum(list_transform(hist, lambda c: c.tokens * least(2.0::DOUBLE, exp((lo + hi) / 2 * c.x)))) AS g FROM e WHERE i < 64)),
x AS (SELECT doc_id, size, source_size, q.target, key, coalesce(d.source, chr(1)) AS s, CASE WHEN q.target = 0 THEN 0.0 WHEN e.lo IS NULL THEN 2.0 ELSE least(2.0, round(exp((lo + hi) / 2 * round(log2(1 + size) * 32) / 32) * 1048576) / 1048576) END::DOUBLE AS rate, ('0x' || substr(key, 1, 8))::BIGINT % ceil(n / 256)::BIGINT AS g
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source AND e.i = 64),
y AS (SELECT *, row_number() OVER (PARTITION BY s, g ORDER BY size DESC, key) AS k FROM x),
z AS (SELECT s, g, 0::BIGINT AS k, 0.0::DOUBLE AS due, 0::BIGINT AS got, NULL::BIGINT AS doc_id, 0::BIGINT AS taken FROM y WHERE k = 1
UNION ALL SELECT y.s, y.g, y.k, z.due + y.size * y.rate, z.got + m.c * y.size, y.doc_id, m.c * y.size FROM z JOIN y ON y.s = z.s AND y.g = z.g AND y.k = z.k + 1, LATERAL (SELECT CASE WHEN y.size = 0 THEN 0 ELSE greatest(floor(y.rate), least(ceil(y.rate), floor((z.due + y.size * y.rate - z.got) / y.size + 0.5))) END::BIGINT AS c) m)
SELECT x.doc_id, x.size, x.source_size, x.target, z.taken FROM x JOIN z ON z.doc_id = x.doc_id
"""

OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1)::BIGINT + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
{_COMPONENTS.format('f', 'e')}
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(comp.c, w.doc_id)::BIGINT AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.x = w.doc_id
"""

OP5 = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.95),
{_COMPONENTS.format('f', 'e')},
l AS (SELECT x, count(*) AS n FROM f GROUP BY x)
SELECT vec_id, coalesce(l.n, 0)::BIGINT AS n_links, coalesce(comp.c, vec_id)::BIGINT AS component_id, coalesce(comp.c, vec_id) = vec_id AS kept FROM v LEFT JOIN comp ON comp.x = vec_id LEFT JOIN l ON l.x = vec_id
"""

OP9 = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w)::BIGINT - 33)) AS i FROM w WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
g AS (SELECT doc_id, list(DISTINCT k) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS k FROM r) GROUP BY doc_id),
x AS (SELECT w.doc_id, w, coalesce(gone, []) AS gone FROM w LEFT JOIN g USING (doc_id)),
u AS (SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed, list_filter(w, lambda t, i: NOT list_contains(gone, i)) AS kept FROM x)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM u
"""

_SAME = "len(list_filter(list_zip(a.w, b.w), lambda x: x[1] <> x[2])) <= 1"
_PREFIX = "coalesce(list_position(list_transform(list_zip(a.w, b.w[:a.n]), lambda x: x[1] = x[2]), false) - 1, a.n)"

OP6 = rf"""
WITH l AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a)::BIGINT)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)),
v AS (SELECT doc_id, i, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM l),
k AS (SELECT *, array_to_string(w, ' ') AS t, len(w) AS n FROM v WHERE len(w) >= 3),
c AS (SELECT t, any_value(w) AS w, any_value(n) AS n, min(doc_id * 1000000 + i) AS spot FROM k GROUP BY t),
h AS (SELECT t, m, q, s, CASE s WHEN 0 THEN array_to_string(w[1:q], ' ') ELSE array_to_string(w[n - q + 1:n], ' ') END AS half FROM (SELECT t, w, n, m, m // 2 AS q FROM (SELECT t, w, n, unnest([n, n - 1]) AS m FROM c WHERE n >= 8) WHERE m >= 8), (VALUES (0), (1)) x(s)),
p AS (SELECT DISTINCT x.t AS x, y.t AS y FROM h x JOIN h y ON x.m = y.m AND x.s = y.s AND x.half = y.half AND x.t <> y.t),
e AS (SELECT a.spot AS one, b.spot AS two, CASE WHEN a.n = b.n THEN {_SAME} WHEN b.n = a.n + 1 THEN a.w[{_PREFIX} + 1:] = b.w[{_PREFIX} + 2:] ELSE false END AS near FROM p JOIN c a ON a.t = p.x JOIN c b ON b.t = p.y WHERE a.n <= b.n),
late AS (SELECT DISTINCT greatest(one, two) AS spot FROM e WHERE near),
gone AS (SELECT doc_id, i FROM k JOIN c USING (t) WHERE c.spot <> doc_id * 1000000 + i OR c.spot IN (SELECT spot FROM late)),
o AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS text FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NOT NULL THEN coalesce(o.text, '') END AS text FROM documents d LEFT JOIN o USING (doc_id)
"""
