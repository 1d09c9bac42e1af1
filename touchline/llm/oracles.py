"""DuckDB SQL for the queries that SQL can express; the others are held against brute force in the tests."""

from __future__ import annotations

from touchline.llm.quality_rules import STOP_WORDS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM d, LATERAL unnest(range(1, greatest(len(w) - 2, 2))) t(i) WHERE len(w) > 0 GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

OP5 = f"""WITH rules(rhost, rpath, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
m AS (SELECT page_id, host, path, concat(rhost, rpath) AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(concat(rhost, rpath)) DESC NULLS LAST) AS k FROM h LEFT JOIN rules ON (host = rhost OR ends_with(host, concat('.', rhost))) AND starts_with(path, rpath))
SELECT page_id, host, path, CASE WHEN action IS NOT NULL THEN rule END AS rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1"""

OP6 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i+34], ' ')) AS x FROM d, LATERAL unnest(range(1, len(w) - 33)) t(i)),
twice AS (SELECT x FROM win GROUP BY x HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, j FROM win JOIN twice ON win.x = twice.x, LATERAL unnest(range(i, i + 35)) u(j)),
v AS (SELECT d.doc_id, k, w[k] AS word FROM d, LATERAL unnest(range(1, len(w) + 1)) y(k)),
z AS (SELECT v.doc_id, count(g.j) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (g.j IS NULL) AS kept FROM v LEFT JOIN gone g ON g.doc_id = v.doc_id AND g.j = v.k GROUP BY v.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN z ON z.doc_id = d.doc_id"""

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP7 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS x FROM d, LATERAL unnest(range(1, len(w) - 6)) t(i)),
twice AS (SELECT doc_id, x FROM win GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT win.doc_id, count(DISTINCT j) AS n FROM win JOIN twice ON win.doc_id = twice.doc_id AND win.x = twice.x, LATERAL unnest(range(i, i + 8)) u(j) GROUP BY win.doc_id),
b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
 CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop,
 len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]{{2,}}'))) AS n_shout, len(list_filter(l, lambda x: contains(x, ' | '))) AS n_list FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.5 AND n_stop / n_words >= 0.05 AND n_dup_lines / n_lines <= 0.3
 AND n_shout / n_words <= 0.5 AND n_list / n_lines <= 0.9 AS kept FROM f"""

OP10 = r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents), b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM d, LATERAL unnest(range(1, len(w) - 3)) t(i) GROUP BY ALL), bs AS (SELECT item_id, array_to_string(w[i:i+4], ' ') AS g FROM b, LATERAL unnest(range(1, len(w) - 3)) t(i) GROUP BY ALL),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id), c AS (SELECT doc_id, item_id, count(*) AS c FROM ds JOIN bs ON ds.g = bs.g GROUP BY ALL)
SELECT doc_id, c.item_id, CAST(n AS BIGINT) AS n_item_shingles, CAST(c AS BIGINT) AS n_shared, c / n AS containment FROM c JOIN n ON c.item_id = n.item_id WHERE 100 * c >= 80 * n"""

ORACLES: dict[str, str] = {"op3_ngram_jaccard_join": OP3, "op5_url_filters": OP5, "op6_substring_dedup": OP6, "op7_quality_rules": OP7, "op10_decontamination": OP10}
