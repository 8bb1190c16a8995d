"""DuckDB SQL for the operators that SQL can express, written independently of them."""

from __future__ import annotations

from mixtext.llm.quality_rules import STOP_WORDS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP5 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
grams AS (SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d) WHERE i + 4 <= len(w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
c AS (SELECT d.doc_id, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: x IN ({", ".join(f"'{x}', '{x.capitalize()}'" for x in STOP_WORDS)}))) AS stop
  FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id),
m AS (SELECT *, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM c),
f AS (SELECT *, concat_ws(',',
    CASE WHEN n_words > 0 AND (word_chars / n_words < 2 OR word_chars / n_words > 25) THEN 'word_length' END,
    CASE WHEN n_words > 0 AND n_symbols / n_words > 0.25 THEN 'symbols' END,
    CASE WHEN n_words >= 100 AND stop / n_words < 0.005 THEN 'stop_words' END,
    CASE WHEN n_words > 0 AND n_dup_lines / greatest(len(l), 1) > 0.5 THEN 'duplicate_lines' END) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    (NOT base_failed AND failed_rules = '') AS kept, failed_rules FROM f
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
    ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), coalesce(md5(text), ''), coalesce(md5(source), ''))), 1, 8))::UBIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
u AS (SELECT *, 3.0::DOUBLE * source_size AS full_size, (3.0::DOUBLE * source_size) / weight AS stop FROM s),
lv AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(full_size) OVER before, 0)) / sum(weight) OVER rest AS level FROM u
  WINDOW before AS (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY stop, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
settled AS (SELECT arg_min(level, stop) AS level FROM lv WHERE level <= stop),
t AS (SELECT lv.source, source_size, CASE WHEN settled.level IS NULL OR weight * settled.level >= full_size THEN full_size
    ELSE weight * settled.level END AS target FROM lv LEFT JOIN settled ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
cells AS (SELECT source, h, sum(size) AS w FROM d GROUP BY source, h),
run AS (SELECT cells.source, h, w, target - whole * source_size AS budget,
    sum(w) OVER (PARTITION BY cells.source ORDER BY h) AS upto FROM cells JOIN p ON cells.source IS NOT DISTINCT FROM p.source),
edge AS (SELECT source, arg_min(h, h) AS h, arg_min((budget - (upto - w)) * 2 > w, h) AS takes FROM run WHERE upto > budget GROUP BY source)
SELECT d.doc_id, d.size, p.source_size, p.target, d.size * (p.whole + CASE
    WHEN edge.h IS NULL THEN (target - whole * source_size > 0)::INT
    WHEN d.h < edge.h OR (d.h = edge.h AND edge.takes) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN edge ON d.source IS NOT DISTINCT FROM edge.source
"""

# kind, pattern, validity of m, score before the context, context words
_PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 75, "mail|contact|courriel|correo|kontakt"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
     "len(list_filter(string_split(m, '.'), lambda x: try_cast(x AS DOUBLE) > 255)) = 0", 60, "address|host|server|login"),
    ("card", r"[0-9]([\x20-]?[0-9])+",
     """length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(
        string_split(reverse(regexp_replace(m, '[^0-9]', '', 'g')), ''), lambda x, i:
        CASE WHEN i % 2 = 1 THEN x::INT WHEN x::INT > 4 THEN 2 * x::INT - 9 ELSE 2 * x::INT END)) % 10 = 0""",
     70, "card|visa|credit|carte|tarjeta|karte|payment"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15", 60, "phone|call|tel|mobile|fax"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b",
     """list_reduce(list_prepend(0, list_transform(string_split(m[5:] || m[:4], ''),
        lambda x: CASE WHEN x >= 'A' THEN ascii(x) - 55 ELSE ascii(x) - 48 END)),
        lambda a, b: CASE WHEN b > 9 THEN (a * 100 + b) % 97 ELSE (a * 10 + b) % 97 END) = 1""",
     80, "iban|bank|account|konto|compte|cuenta"),
)

OP1 = "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS (" + " UNION ALL ".join(rf"""
SELECT doc_id, {n} AS k, '{kind}' AS kind, s, s + length(m) AS e, {score} + CASE WHEN regexp_matches(
    lower(substr(t, greatest(s - 40, 0) + 1, s - greatest(s - 40, 0))), '{near}') THEN 20 ELSE 0 END AS score
FROM (SELECT doc_id, t, m, (sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m))::BIGINT AS s FROM (
    SELECT doc_id, t, unnest(ms) AS m, unnest(gs[:len(ms)]) AS g, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM d)))
WHERE {ok}""" for n, (kind, pattern, ok, score, near) in enumerate(_PII)) + """),
per AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
    count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k < 4) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans,
    string_agg(score::VARCHAR, ',' ORDER BY k, s) AS scores FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
    coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
    coalesce(scores, '') AS scores FROM d LEFT JOIN per ON d.doc_id = per.doc_id
"""

_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
OP2 = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE {_FINITE}),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, len(q.v) + 1),
    lambda i: (c.v[i] - q.v[i]) * (c.v[i] - q.v[i]))), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP10 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o, any_value(a.n) AS nx, any_value(b.n) AS ny
    FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT x, y FROM p WHERE 100 * o >= 90 * (nx + ny - o)),
ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(v, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT ends.y, reach.c FROM reach JOIN ends ON ends.x = reach.v)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(c) FROM reach WHERE v = s.doc_id) AS component_id FROM s
"""

_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _apart(x: str, y: str) -> str:
    """Squared distance of two whole-number lists."""
    return f"list_sum(list_transform(list_zip({x}, {y}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _op12(rounds: int) -> str:
    sql = f"""WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE {_WHOLE} AND len(embedding) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v AS m FROM v ORDER BY sha256('1:' || vec_id), v LIMIT 16)"""
    for i in range(rounds + 1):
        sql += f""",
a{i} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(c, d * 16 + c)::INT AS cluster, min(d)::BIGINT AS distance
  FROM (SELECT r, vec_id, v, c, {_apart("v", "m")} AS d FROM v CROSS JOIN c{i}) GROUP BY r)"""
        if i < rounds:
            sql += f""",
m{i} AS (SELECT cluster, list(s ORDER BY d) AS m FROM (SELECT cluster, d, floor(sum(x)::HUGEINT / count(*))::BIGINT AS s
  FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS d FROM a{i}) GROUP BY cluster, d) GROUP BY cluster),
c{i + 1} AS (SELECT c, coalesce(m{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN m{i} ON c = cluster)"""
    return sql + f"""
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
    (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON cluster = c"""


def _op13(rounds: int) -> str:
    sql = f"""WITH v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE {_WHOLE}),
p AS (SELECT r, unnest(range(16)) AS p, unnest(list_transform(range(16), lambda i: v[i * (len(v) // 16) + 1 : (i + 1) * (len(v) // 16)])) AS x FROM v),
f AS (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM v ORDER BY vec_id, v LIMIT 64),
b0 AS (SELECT p, e, x AS m FROM p JOIN f USING (r))"""
    for i in range(rounds + 1):
        sql += f""",
a{i} AS (SELECT r, p, any_value(x) AS x, arg_min(e, d * 64 + e) AS e, min(d)::BIGINT AS d
  FROM (SELECT r, p.p, x, e, {_apart("x", "m")} AS d FROM p JOIN b{i} ON p.p = b{i}.p) GROUP BY r, p)"""
        if i < rounds:
            sql += f""",
m{i} AS (SELECT p, e, list(s ORDER BY k) AS m FROM (SELECT p, e, k, floor(sum(y)::HUGEINT / count(*))::BIGINT AS s
  FROM (SELECT p, e, unnest(x) AS y, unnest(range(len(x))) AS k FROM a{i}) GROUP BY p, e, k) GROUP BY p, e),
b{i + 1} AS (SELECT b{i}.p, b{i}.e, coalesce(m{i}.m, b{i}.m) AS m FROM b{i} LEFT JOIN m{i} ON b{i}.p = m{i}.p AND b{i}.e = m{i}.e)"""
    return sql + f""",
o AS (SELECT r, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(m, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN o USING (r), h"""


OP12, OP13 = _op12(3), _op13(2)

ORACLE = {"op12_centroids": OP12, "op13_codebooks": OP13, "op10_jaccard_join": OP10, "op2_nearest": OP2, "op1_pii": OP1, "op5_quality_rules": OP5, "op6_source_mix": OP6}
