"""DuckDB statements the registered queries must equal."""

from __future__ import annotations

from crossrank.llm.license_scan import template_rows
from crossrank.llm.url_filter import DAMPING, RULES

WORD = r"[^\x20\x09-\x0D]+"
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MIXING = rf"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
           md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
    FROM documents
), totals AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
           CAST(3 * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total
    FROM totals
), levels AS (
    SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
              / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed
), water AS (
    SELECT *, (SELECT max(level) FROM levels WHERE cap > level * weight) AS water,
           cap <= level * weight AS is_full
    FROM levels
), targets AS (
    SELECT source, source_size, CASE WHEN is_full THEN cap ELSE water * weight END AS target FROM water
), rates AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
           target - whole * source_size AS need
    FROM targets
), ranges AS (
    SELECT s.*, r.source_size, r.target, r.whole, r.need, substr(digest, 1, 3) AS range_key,
           sum(size) OVER (PARTITION BY s.source ORDER BY substr(digest, 1, 3)
                           RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS range_end,
           sum(size) OVER (PARTITION BY s.source, substr(digest, 1, 3)) AS range_size,
           coalesce(sum(size) OVER (PARTITION BY s.source, substr(digest, 1, 3)
                           ORDER BY digest, doc_id NULLS FIRST, size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
), drawn AS (
    SELECT *, CASE WHEN range_end <= need AND range_size > 0 THEN 1
                   WHEN range_end <= need THEN 1
                   WHEN range_end - range_size <= need
                        AND 2 * before + size <= 2 * (need - (range_end - range_size)) THEN 1
                   ELSE 0 END AS extra
    FROM ranges
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + extra) AS BIGINT) AS taken
FROM drawn
"""

LINE_DEDUP = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS site, text,
           string_split(coalesce(text, ''), chr(10)) AS parts
    FROM documents
), placed AS (
    SELECT rid, doc_id, site, i, parts[i] AS line,
           trim(regexp_replace(translate(parts[i], '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+', ' ', 'g')) AS normal
    FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM docs)
), boilerplate AS (
    SELECT normal, min(doc_id) AS owner FROM placed
    WHERE len(regexp_extract_all(normal, '{WORD}')) >= 4
    GROUP BY normal HAVING count(DISTINCT site) >= 8
), judged AS (
    SELECT p.*, b.normal IS NOT NULL AND (p.doc_id IS DISTINCT FROM b.owner
               OR row_number() OVER (PARTITION BY p.rid, p.normal ORDER BY i) > 1) AS gone
    FROM placed p LEFT JOIN boilerplate b USING (normal)
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL
                      ELSE coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') END AS text,
       CASE WHEN d.text IS NULL THEN 0 ELSE count(*) END AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed
FROM judged j JOIN docs d USING (rid) GROUP BY rid, d.doc_id, d.text
"""

DECONTAMINATION = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w
    FROM documents
), items AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
           regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w
    FROM benchmark
), patterns AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size,
           array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), grams AS (
    SELECT rid, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS g
    FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i
          FROM docs, (SELECT DISTINCT size FROM patterns) WHERE len(w) >= size)
), found AS (
    SELECT rid, i, p.size, item_id FROM grams JOIN patterns p USING (g) WHERE grams.size = p.size
), hit AS (
    SELECT rid, count(DISTINCT word) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS word FROM found) GROUP BY rid
), named AS (
    SELECT rid, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
    FROM found GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit h USING (rid) LEFT JOIN named i USING (rid)
"""

QUALITY_RULES = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
    FROM documents
), windows AS (
    SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
    FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3)
), repeated AS (
    SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), covered AS (
    SELECT rid, count(DISTINCT i + k) AS n FROM repeated, (VALUES (0), (1), (2)) offsets(k) GROUP BY rid
), line_rows AS (
    SELECT rid, source, line, len(regexp_extract_all(line, '{WORD}')) AS n,
           trim(regexp_replace(translate(line, '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+', ' ', 'g')) AS normal
    FROM (SELECT rid, source, unnest(string_split(text, chr(10))) AS line FROM docs)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), doubled AS (
    SELECT rid, count(*) - count(DISTINCT line) AS n FROM line_rows GROUP BY rid
), frequent AS (
    SELECT source, normal FROM line_rows l
    GROUP BY source, normal
    HAVING count(DISTINCT rid) > 5
       AND count(DISTINCT rid) > 0.1::DOUBLE * (SELECT count(*) FROM docs d WHERE d.source IS NOT DISTINCT FROM l.source)
), removed AS (
    SELECT rid, sum(n) AS n FROM line_rows l JOIN frequent f
      ON l.normal = f.normal AND l.source IS NOT DISTINCT FROM f.source
    GROUP BY rid
), judged AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
           CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(coalesce(b.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
           CAST(len(w) - coalesce(r.n, 0) AS BIGINT) AS n_kept_words
    FROM docs d LEFT JOIN covered c USING (rid) LEFT JOIN doubled b USING (rid) LEFT JOIN removed r USING (rid)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND n_kept_words >= 0.3::DOUBLE * n_words AS kept
FROM judged
"""


def _url_filter() -> str:
    """Seeds by share of pages, and 150 rounds (a gain of 0.85 ** 150 at most)."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return rf"""
WITH RECURSIVE rules(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
parts AS (
    SELECT row_number() OVER () AS rid, page_id, coalesce(html, '') AS html,
           translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
    FROM pages
), fitted AS (
    SELECT rid, arg_max(rule_host || rule_path, length(rule_host) + length(rule_path)) AS rule,
           arg_max(rule_verdict, length(rule_host) + length(rule_path)) AS verdict
    FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY rid
), matched AS (
    SELECT p.*, f.rule, f.verdict FROM parts p LEFT JOIN fitted f USING (rid)
), edges AS (
    SELECT host AS src, dst, count(*) AS n FROM (
        SELECT host, translate(unnest(regexp_extract_all(html,
            '(?i)href\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1)), '{UPPER}', '{LOWER}') AS dst
        FROM parts WHERE host <> '') WHERE host <> dst GROUP BY host, dst
), ways AS (
    SELECT 'trust' AS way, src AS a, dst AS b, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges
), shares AS (
    SELECT way, a, b, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY way, a) AS share FROM ways
), sides AS (
    SELECT host, count(*) FILTER (verdict = 'allow') AS yes, count(*) FILTER (verdict = 'block') AS no
    FROM matched WHERE verdict IS NOT NULL GROUP BY host
), start AS (
    SELECT 'trust' AS kind, host, CAST(yes AS DOUBLE) / (yes + no) * (1 - {DAMPING}::DOUBLE) AS gain FROM sides WHERE yes > 0
    UNION ALL SELECT 'distrust', host, CAST(no AS DOUBLE) / (yes + no) * (1 - {DAMPING}::DOUBLE) FROM sides WHERE no > 0
), gains AS (
    SELECT 0 AS r, kind, host, gain FROM start
    UNION ALL
    SELECT g.r + 1, g.kind, w.b, sum(g.gain * w.share * {DAMPING}::DOUBLE)
    FROM gains g JOIN shares w ON g.kind = w.way AND g.host = w.a WHERE g.r < 150 GROUP BY g.r, g.kind, w.b
), hosts AS (
    SELECT host, coalesce(sum(gain) FILTER (kind = 'trust'), 0) AS trust,
           coalesce(sum(gain) FILTER (kind = 'distrust'), 0) AS distrust
    FROM gains GROUP BY host
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
       round(coalesce(trust, 0.0), 6) AS trust, round(coalesce(distrust, 0.0), 6) AS distrust
FROM matched LEFT JOIN hosts USING (host)
"""


URL_FILTER = _url_filter()

ARCHIVES = """
WITH payloads AS (
    SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), firsts AS (
    SELECT page_id, octet_length(body) AS size, sha256(body) AS digest,
           min(page_id) OVER (PARTITION BY body) AS first_id
    FROM payloads
)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN size >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM firsts
"""


def _license_scan() -> str:
    rows = ", ".join(f"('{label}', {base}, {size}, '{gram}', {pos})" for label, base, size, gram, pos in template_rows())
    return rf"""
WITH templates(label, base, size, gram, t_pos) AS (VALUES {rows}),
docs AS (
    SELECT row_number() OVER () AS rid, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w
    FROM documents
), grams AS (
    SELECT rid, i - 1 AS pos, w[i] || ' ' || w[i + 1] AS gram
    FROM (SELECT rid, w, unnest(range(1, len(w))) AS i FROM docs)
), hits AS (
    SELECT DISTINCT rid, label, base, size, pos - t_pos AS diagonal, t_pos FROM grams JOIN templates USING (gram)
), places AS (
    SELECT rid, label, diagonal AS place, 1.0::DOUBLE AS cover FROM hits WHERE base
    GROUP BY rid, label, size, diagonal HAVING count(*) = size - 1
), islands AS (
    SELECT *, sum(fresh) OVER (PARTITION BY rid, label ORDER BY diagonal
                               RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
    FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w BETWEEN 0 AND 2 THEN 0 ELSE 1 END AS fresh
          FROM hits WHERE NOT base WINDOW w AS (PARTITION BY rid, label ORDER BY diagonal, t_pos))
), spans AS (
    SELECT rid, label, size, count(DISTINCT t_pos)::DOUBLE / (size - 1) AS cover,
           max(diagonal + t_pos + 1) - min(diagonal + t_pos) + 1 AS length
    FROM islands GROUP BY rid, label, size, island
    UNION ALL
    SELECT rid, label, size, count(DISTINCT t_pos)::DOUBLE / (size - 1),
           max(diagonal + t_pos + 1) - min(diagonal + t_pos) + 1
    FROM islands GROUP BY rid, label, size, diagonal
), found AS (
    SELECT rid, label, place, cover FROM places
    UNION ALL SELECT rid, label, NULL, cover FROM spans WHERE cover >= 0.8::DOUBLE AND length <= size * 1.25::DOUBLE + 2
), summed AS (
    SELECT rid, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place IS NOT NULL) AS base_labels,
           string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score
    FROM found GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM docs LEFT JOIN summed USING (rid)
"""


LICENSE_SCAN = _license_scan()

SHINGLE_JOIN = rf"""
WITH RECURSIVE docs AS (
    SELECT row_number() OVER () AS rid, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w
    FROM documents
), shingles AS MATERIALIZED (
    SELECT DISTINCT rid, array_to_string(list_slice(w, i, i + 4), ' ') AS g
    FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS MATERIALIZED (
    SELECT rid, count(*) AS n FROM shingles GROUP BY rid
), met AS (
    SELECT a.rid AS x, b.rid AS y, count(*) AS shared
    FROM shingles a JOIN shingles b ON a.g = b.g AND a.rid <> b.rid GROUP BY a.rid, b.rid
), links AS MATERIALIZED (
    SELECT x, y FROM met JOIN sizes a ON x = a.rid JOIN sizes b ON y = b.rid
    WHERE 100 * shared >= 80 * (a.n + b.n - shared)
), reach(rid, other) AS (
    SELECT rid, rid FROM docs
    UNION
    SELECT r.rid, l.y FROM reach r JOIN links l ON r.other = l.x
)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM docs d JOIN reach r USING (rid) JOIN docs o ON o.rid = r.other LEFT JOIN sizes s ON s.rid = d.rid
GROUP BY d.rid, d.doc_id
"""
