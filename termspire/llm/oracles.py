"""For the registered queries that SQL can state: what DuckDB must return for them."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

BENCHMARK_DECONTAMINATION = f"""
WITH item AS (
    SELECT item_id::VARCHAR AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL
),
sized AS (SELECT item, w, least(10, len(w)) AS size FROM item WHERE len(w) > 0),
passage AS (
    SELECT DISTINCT item, size, array_to_string(w[s : s + size - 1], ' ') AS gram
    FROM (SELECT *, unnest(generate_series(1, len(w) - size + 1)) AS s FROM sized)
),
doc AS (
    SELECT row_number() OVER () AS r, doc_id,
        CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE {_WORDS.format("text")} END AS w
    FROM documents
),
place AS (
    SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS s
    FROM doc, (SELECT DISTINCT size FROM passage)
),
hit AS (
    SELECT r, s, place.size, item
    FROM (SELECT r, s, size, array_to_string(w[s : s + size - 1], ' ') AS gram FROM place) AS place
    JOIN passage USING (gram)
    WHERE place.size = passage.size
),
word AS (
    SELECT r, count(DISTINCT p) AS n
    FROM (SELECT r, unnest(generate_series(s, s + size - 1)) AS p FROM (SELECT DISTINCT r, s, size FROM hit))
    GROUP BY r
),
found AS (
    SELECT r, count(item) AS n, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(word.n, 0)::BIGINT AS n_hit,
    coalesce(found.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(word.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN found USING (r)
"""

_TOKENS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

MINHASH_NEAR_DUPLICATES = f"""
WITH RECURSIVE doc AS (
    SELECT doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE {_TOKENS.format("text")} END AS w
    FROM documents
),
shingle AS (
    SELECT DISTINCT doc_id, array_to_string(w[s : s + 4], ' ') AS gram
    FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS s FROM doc WHERE len(w) > 0)
),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingle AS a JOIN shingle AS b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
),
link AS (
    SELECT a, b FROM common JOIN size AS x ON x.doc_id = a JOIN size AS y ON y.doc_id = b
    WHERE 100 * common.n >= 75 * (x.n + y.n - common.n)
),
reach AS (
    SELECT DISTINCT doc_id AS a, doc_id AS b FROM doc
    UNION
    SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
),
component AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM doc LEFT JOIN size USING (doc_id) JOIN component USING (doc_id)
"""

LINE_DEDUP = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
line AS (SELECT r, source, unnest(generate_series(1, len(l))) AS p, unnest(l) AS line
    FROM (SELECT r, source, string_split(text, chr(10)) AS l FROM doc WHERE text IS NOT NULL)),
pages AS (SELECT source, count(*) AS pages FROM doc GROUP BY source),
seen AS (SELECT source, trim(line) AS line, count(DISTINCT r) AS n FROM line WHERE trim(line) <> '' GROUP BY ALL),
common AS (
    SELECT DISTINCT seen.source, seen.line FROM seen JOIN pages ON seen.source IS NOT DISTINCT FROM pages.source
    WHERE n >= 2 AND n > pages * 0.1::DOUBLE
),
marked AS (
    SELECT line.*, common.line IS NOT NULL AS gone FROM line LEFT JOIN common
    ON common.source IS NOT DISTINCT FROM line.source AND common.line = trim(line.line)
),
joined AS (
    SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '') AS text
    FROM marked GROUP BY r
)
SELECT doc_id, source AS host, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(n_dropped, 0)::BIGINT AS n_dropped, joined.text AS text
FROM doc LEFT JOIN joined USING (r)
"""

WINNOWING = r"""
WITH doc AS (
    SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(coalesce(text, '')) DESC) AS r, doc_id,
        coalesce(text, '') AS text, length(coalesce(text, '')) AS n
    FROM documents
),
pair AS (
    SELECT a.r, a.doc_id, a.n, b.r AS next_r, a.text, left(a.text, a.n - a.n // 3) || left(b.text, a.n // 3) AS edited
    FROM doc AS a JOIN doc AS b ON b.r = a.r % (SELECT count(*) FROM doc) + 1
),
version AS (
    SELECT r, kind, length(text) AS n, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w
    FROM (SELECT r, 0 AS kind, text FROM pair UNION ALL SELECT r, 1, edited FROM pair)
),
unit AS (
    SELECT r, kind, 0 AS small,
        flatten(list_transform(w, lambda x: CASE WHEN length(x) > 16 THEN regexp_extract_all(x, '(?s).') ELSE [x] END)) AS u
    FROM version
    UNION ALL
    SELECT r, kind, 1, regexp_extract_all(array_to_string(w, ''), '(?s).') FROM version WHERE n < 300
),
hashed AS (
    SELECT r, kind, small, list_transform(u, lambda x: ('0x' || left(md5(x), 8))::BIGINT % 2147483647) AS h FROM unit
),
gram AS (
    SELECT r, kind, small, CASE
        WHEN len(h) = 0 THEN []::BIGINT[]
        WHEN len(h) = 1 THEN h
        WHEN len(h) = 2 THEN [(h[1] * 1000003 + h[2]) % 2147483647]
        ELSE list_transform(h[1 : len(h) - 2],
            lambda x, i: ((x * 1000003 + h[i + 1]) % 2147483647 * 1000003 + h[i + 2]) % 2147483647) END AS g
    FROM hashed
),
packed AS (SELECT r, kind, small, list_transform(g, lambda x, i: x * 2147483648 + 2147483648 - i) AS p FROM gram),
pick AS (
    SELECT r, kind, small, CASE WHEN len(p) = 0 THEN []::BIGINT[]
        ELSE list_distinct(list_transform(p[1 : greatest(len(p) - 3, 1)], lambda x, i: list_min(p[i : i + 3]))) END AS p
    FROM packed
),
print AS (
    SELECT r, kind, small, array_to_string(list_transform(
        list_sort(list_transform(p, lambda x: (2147483647 - x % 2147483648) * 2147483648 + x // 2147483648)),
        lambda y: (y // 2147483648) || ':' || (y % 2147483648)), ',') AS f, p
    FROM pick
),
whole AS (
    SELECT a.r, a.kind, a.f || CASE WHEN coalesce(len(b.p), 0) > 0 THEN ';' || b.f ELSE '' END AS f,
        list_distinct(list_transform(list_concat(a.p, coalesce(b.p, []::BIGINT[])), lambda x: x // 2147483648)) AS h
    FROM print AS a LEFT JOIN print AS b ON b.r = a.r AND b.kind = a.kind AND b.small = 1 WHERE a.small = 0
),
three AS (
    SELECT pair.*, x.f AS fx, y.f AS fy, x.h AS hx, y.h AS hy, z.h AS hz
    FROM pair JOIN whole AS x ON x.r = pair.r AND x.kind = 0 JOIN whole AS y ON y.r = pair.r AND y.kind = 1
    JOIN whole AS z ON z.r = pair.next_r AND z.kind = 0
),
near AS (SELECT *, len(list_intersect(hx, hy)) AS sy, len(list_intersect(hx, hz)) AS sz FROM three)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, fx AS fingerprint, fy AS edited_fingerprint,
    CASE WHEN len(hx) + len(hy) = 0 THEN 1.0::DOUBLE ELSE sy::DOUBLE / (len(hx) + len(hy) - sy) END AS near_edited,
    CASE WHEN len(hx) + len(hz) = 0 THEN 1.0::DOUBLE ELSE sz::DOUBLE / (len(hx) + len(hz) - sz) END AS near_next
FROM near
"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED_LEXICAL_SEARCH = f"""
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("text")} AS w FROM documents WHERE text IS NOT NULL
),
sized AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM doc WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sized),
posting AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM doc) GROUP BY ALL),
item AS (
    SELECT q, item_id, term, count(*)::BIGINT AS repeats
    FROM (SELECT row_number() OVER () AS q, item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark WHERE text IS NOT NULL)
    GROUP BY ALL
),
weight AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM posting SEMI JOIN item USING (term), totals GROUP BY term, docs
),
scored AS (
    SELECT q, item_id, r, doc_id,
        sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
    FROM item JOIN weight USING (term) JOIN posting USING (term) JOIN sized USING (r), totals GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""
