"""DuckDB SQL over the given tables for the corpus queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op3_mix_sources"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3.0::DOUBLE AS cap,
    sum(source_size) OVER ()::BIGINT AS total FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER before, 0.0::DOUBLE) AS capped, (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS open
    FROM w WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap <= weight * (total - capped) / open AS clamped FROM f),
t AS (SELECT source, source_size, CASE WHEN clamped THEN cap ELSE weight * ((total - coalesce(sum(cap) FILTER (clamped) OVER (), 0.0::DOUBLE))
    / (sum(weight) FILTER (NOT clamped) OVER ())::BIGINT) END AS target FROM c),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
o AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
    FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM o
"""

SQL["op4_url_filter"] = r"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
    ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, n, regexp_extract(rest, '^[^/?#]*') AS host, rest FROM p),
u AS (SELECT page_id, n, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM h)
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(verdict, 'allow') AS verdict
FROM u LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC NULLS LAST, verdict DESC) = 1
"""

SQL["op12_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM p),
r AS (SELECT *, first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM d)
SELECT page_id, payload_bytes,
    list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0],
        lambda shift: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, 5 * i + 1, 5))::BIGINT >> shift) & 31) + 1)::BIGINT, 1)),
        'string_agg', '')), 'string_agg', '') AS payload_digest,
    CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to,
    CASE WHEN NOT again THEN true END AS intact FROM r
"""

SQL["op13_phrases"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
q AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM p),
f1 AS (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(ws) AS w FROM q) GROUP BY ALL),
f2 AS (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS w FROM q)
    GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS w FROM q)
    GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
t AS (SELECT lang, w, f, split_part(w, ' ', 1) AS a, split_part(w, ' ', 2) AS b, split_part(w, ' ', 3) AS c FROM f3),
inside AS (SELECT lang, w, max(f) AS most FROM (SELECT lang, a || ' ' || b AS w, f FROM t UNION ALL SELECT lang, b || ' ' || c, f FROM t) GROUP BY ALL),
two AS (SELECT f2.lang, f2.w AS phrase, f2.f AS a, x.f AS l, y.f AS r FROM f2
    JOIN f1 x ON x.lang = f2.lang AND x.w = split_part(f2.w, ' ', 1) JOIN f1 y ON y.lang = f2.lang AND y.w = split_part(f2.w, ' ', 2)
    LEFT JOIN inside i ON i.lang = f2.lang AND i.w = f2.w WHERE i.most IS NULL OR 100 * i.most < 50 * f2.f),
three AS (SELECT t.lang, t.w AS phrase, t.f AS a, x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2 FROM t
    JOIN f1 x ON x.lang = t.lang AND x.w = t.a JOIN f1 z ON z.lang = t.lang AND z.w = t.c
    JOIN f2 xy ON xy.lang = t.lang AND xy.w = t.a || ' ' || t.b JOIN f2 yz ON yz.lang = t.lang AND yz.w = t.b || ' ' || t.c),
cut AS (SELECT *, (1000000::HUGEINT * a * a) // (l1::HUGEINT * r1) AS s1, (1000000::HUGEINT * a * a) // (l2::HUGEINT * r2) AS s2 FROM three),
every AS (SELECT lang, phrase, a, l, r, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM two
    UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2)::BIGINT FROM cut),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM every)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
