"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (length(t) - length(replace(t, '!', '')))::BIGINT AS n_bangs,
         len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines
  FROM base),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM twice, range(5) r(k) GROUP BY doc_id),
led AS (
  SELECT m.*, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN cov USING (doc_id)),
bits AS (
  SELECT *, ((n_words < 10)::INT
    + 2 * (100 * n_repeat_words > 20 * n_words)::INT
    + 4 * (100 * n_symbols > 30 * n_words)::INT
    + 8 * (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)::INT
    + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT
    + 32 * (100 * n_bangs > 50 * n_words)::INT)::BIGINT AS failed_bits
  FROM led)
SELECT *, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept FROM bits
"""

OP8 = r"""
WITH p AS (
  SELECT a.page_id AS p, a.page_id // 4 AS g, h.url AS head, a.html, a.page_id // 4 * 20000 + a.page_id % 4 * 5000 AS t,
    '"' || md5(h.url) || '"' AS tag, 'day ' || (a.page_id // 4 % 9) AS day, regexp_replace(h.url, '#.*$', '') AS u
  FROM pages a JOIN pages h ON h.page_id = a.page_id // 4 * 4),
c AS (
  SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1))
    || CASE WHEN regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) = '' THEN '/' ELSE regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) END
    || CASE WHEN regexp_extract(u, '\?(.*)$', 1) = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(regexp_extract(u, '\?(.*)$', 1), '&')), '&') END AS canonical
  FROM p),
r AS (SELECT canonical, p * 2 AS id, t AS seen, CASE WHEN p % 5 <> 4 THEN tag END AS etag, day, html FROM c WHERE p % 4 <> 2),
v AS (
  SELECT canonical, p * 2 + 1 AS id, t + CASE p % 7 WHEN 0 THEN 5 WHEN 1 THEN 900 WHEN 2 THEN 4000 WHEN 3 THEN 9000 WHEN 4 THEN -300 WHEN 5 THEN 90000 ELSE 13 END AS seen,
    CASE p % 6 WHEN 0 THEN 'W/' || tag WHEN 1 THEN '"other"' WHEN 2 THEN tag WHEN 3 THEN tag END AS etag, CASE WHEN p % 6 = 5 THEN day END AS day FROM c),
-- The latest earlier response of each revisit's URL.
found AS (SELECT v.id, arg_max(r.id, (r.seen, r.id)) AS rid FROM v JOIN r ON r.canonical = v.canonical AND (r.seen < v.seen OR (r.seen = v.seen AND r.id < v.id)) GROUP BY v.id),
j AS (
  SELECT v.id AS record_id, v.canonical, v.seen, v.etag AS own, r.id AS rid, r.etag AS theirs, r.day, r.html,
    CASE WHEN r.id IS NULL THEN 'no_response' WHEN v.etag IS NOT NULL AND r.etag IS NOT NULL THEN CASE WHEN ltrim(v.etag, 'W/') = r.etag THEN 'resolved' ELSE 'validator_mismatch' END
      WHEN v.day IS NOT NULL THEN CASE WHEN v.day = r.day THEN 'resolved' ELSE 'validator_mismatch' END ELSE 'no_validator' END AS outcome
  FROM v LEFT JOIN found ON found.id = v.id LEFT JOIN r ON r.id = found.rid)
SELECT record_id, canonical, CASE WHEN outcome = 'resolved' THEN rid ELSE -1 END AS response_id, outcome,
  CASE WHEN outcome = 'resolved' THEN 'content-type=text/html;date=' || seen || ';etag=' || coalesce(own, theirs, '') || ';last-modified=' || day END AS headers,
  CASE WHEN outcome = 'resolved' THEN md5(html) END AS body_md5, CASE WHEN outcome = 'resolved' THEN strlen(html) ELSE 0 END AS body_bytes
FROM j
"""

OP9 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
hits AS (SELECT DISTINCT doc_id, k, i, item_id FROM dw JOIN iw USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM hits, range(10) r(j) WHERE j < k GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# Strings of 50 bytes are 100 hex digits.
OP3 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)),
low AS (SELECT g, min(doc_id) AS first_doc FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM win JOIN low USING (g) WHERE first_doc < doc_id),
edge AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, -1) AS opens FROM hit),
run AS (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edge),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, r),
gap AS (
  SELECT doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER s, 0) + 1, 2 * (a - coalesce(lag(b) OVER s, 0))) AS kept
  FROM span JOIN d USING (doc_id) WINDOW s AS (PARTITION BY doc_id ORDER BY a)),
sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n, max(b) AS last_end, string_agg(kept, '' ORDER BY a) AS kept FROM gap GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last_end, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id)
"""

OP13 = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w
  FROM documents),
d AS (
  SELECT *, len(w)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM u),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:n], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": OP1,
    "op3_substring_dedup": OP3,
    "op8_not_modified_revisits": OP8,
    "op9_benchmark_decontamination": OP9,
    "op13_fill_in_middle": OP13,
}
