"""DuckDB SQL of the operators that SQL can express; rows are numbered, ids may repeat."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = r"[\x20\x09-\x0D]+"
_WORDS = "list_filter(regexp_split_to_array({text}, '" + _BLANKS + "'), lambda w: w <> '')"

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS ws FROM documents),
t AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM d),
one AS (SELECT w, count(*) AS n FROM t GROUP BY w),
total AS (SELECT sum(n) AS n FROM one),
grams AS (SELECT c.rid, c.pos, a.w AS w1, b.w AS w2, c.w AS w3 FROM t c LEFT JOIN t b ON b.rid = c.rid AND b.pos = c.pos - 1 LEFT JOIN t a ON a.rid = c.rid AND a.pos = c.pos - 2),
own2 AS (SELECT rid, w2, w3, count(*) AS n FROM grams WHERE w2 IS NOT NULL GROUP BY 1, 2, 3),
own3 AS (SELECT rid, w1, w2, w3, count(*) AS n FROM grams WHERE w1 IS NOT NULL GROUP BY 1, 2, 3, 4),
two AS (SELECT w2, w3, sum(n) AS n FROM own2 GROUP BY 1, 2),
three AS (SELECT w1, w2, w3, sum(n) AS n FROM own3 GROUP BY 1, 2, 3),
s AS (SELECT g.rid, CASE WHEN c3.n > o3.n THEN ln(c3.n / head.n) WHEN c2.n > o2.n THEN ln(c2.n / c1.n) + CASE WHEN g.w1 IS NULL THEN 0 ELSE ln(0.4) END
    ELSE ln(u.n / total.n) + CASE WHEN g.w2 IS NULL THEN 0 WHEN g.w1 IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END END AS s
  FROM grams g JOIN one u ON g.w3 = u.w LEFT JOIN one c1 ON g.w2 = c1.w LEFT JOIN two c2 ON g.w2 = c2.w2 AND g.w3 = c2.w3 LEFT JOIN two head ON g.w1 = head.w2 AND g.w2 = head.w3
  LEFT JOIN three c3 ON g.w1 = c3.w1 AND g.w2 = c3.w2 AND g.w3 = c3.w3 LEFT JOIN own2 o2 ON g.rid = o2.rid AND g.w2 = o2.w2 AND g.w3 = o2.w3
  LEFT JOIN own3 o3 ON g.rid = o3.rid AND g.w1 = o3.w1 AND g.w2 = o3.w2 AND g.w3 = o3.w3, total)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(sum(s), 0), 6) AS log_score, round(CASE WHEN len(ws) = 0 THEN 0 ELSE sum(s) / len(ws) END, 6) AS mean_log_score
FROM d LEFT JOIN s ON d.rid = s.rid GROUP BY d.rid, d.doc_id, ws
"""

_ITEM_WORDS = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_ITEM_WORDS} AS ws FROM documents),
i AS (SELECT coalesce(cast(item_id AS varchar), '') AS item_id, {_ITEM_WORDS} AS ws FROM benchmark),
p AS (SELECT item_id, least(10, len(ws)) AS size, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS k FROM i WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(ws[k:k + size - 1], ' ') AS key FROM p),
sizes AS (SELECT DISTINCT size FROM windows),
dp AS (SELECT rid, ws, size, unnest(range(1, len(ws) - size + 2)) AS k FROM d, sizes WHERE len(ws) >= size),
hits AS (SELECT rid, k, dp.size, item_id FROM dp JOIN windows ON dp.size = windows.size AND array_to_string(ws[k:k + dp.size - 1], ' ') = key),
w AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(k, k + size)) AS pos FROM hits) GROUP BY rid),
f AS (SELECT rid, count(*) AS n_items, list_sort(list(item_id)) AS item_ids FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(array_to_string(item_ids, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN w ON d.rid = w.rid LEFT JOIN f ON d.rid = f.rid
"""

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS k, ws FROM d WHERE len(ws) >= 3),
twice AS (SELECT rid, k, count(*) OVER (PARTITION BY rid, ws[k], ws[k + 1], ws[k + 2]) AS n FROM g),
repeats AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest(range(k, k + 3)) AS pos FROM twice WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, source, pos, x, md5(x) AS line FROM (SELECT rid, source, pos, trim(regexp_replace(lower(x), '{_BLANKS}', ' ', 'g')) AS x FROM (SELECT rid, source, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)) WHERE x <> ''),
keys AS (SELECT rid, md5(string_agg(x, chr(10) ORDER BY pos)) AS document FROM l GROUP BY rid),
over_ AS (SELECT source, line FROM l JOIN keys ON l.rid = keys.rid GROUP BY source, line HAVING count(DISTINCT document) > 20),
removed AS (SELECT rid, CAST(sum(len(string_split(x, ' '))) AS BIGINT) AS n FROM l JOIN over_ ON l.line = over_.line AND l.source IS NOT DISTINCT FROM over_.source GROUP BY rid),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    coalesce(repeats.n, 0) AS n_repeat_words, coalesce(removed.n, 0) AS n_removed_words
  FROM d LEFT JOIN repeats ON d.rid = repeats.rid LEFT JOIN removed ON d.rid = removed.rid)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * n_removed_words > 50 * n_words AS depleted,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (100 * n_removed_words > 50 * n_words) AS kept FROM f
"""
