"""DuckDB SQL of the operators' queries, where SQL can express them."""

from __future__ import annotations

#: Counts, base rules and adaptive verdict of documents ``d`` (doc_id, lang, source, text, ...).
QUALITY_CTES = r"""
texts AS (SELECT *, coalesce(text, '') AS t FROM d),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM texts),
windows AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS w,
                   unnest(range(1, len(ws) - 1)) AS i FROM split WHERE len(ws) >= 3),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
covered AS (SELECT doc_id, sum(CASE WHEN i - before >= 3 OR before IS NULL THEN 3 ELSE i - before END)::BIGINT AS n
            FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM twice) GROUP BY doc_id),
counted AS (SELECT s.*, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
                   len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines,
                   len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
            FROM split s LEFT JOIN covered c USING (doc_id)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
ratios AS (SELECT lang, source, r.k AS k, r.v AS v FROM (SELECT lang, source, unnest([
             {'k': 'symbols', 'v': 1000 * n_symbols // word_chars}, {'k': 'dup_lines', 'v': 1000 * n_dup_lines // n_lines},
             {'k': 'repeats', 'v': 1000 * n_repeat_words // n_words}, {'k': 'word_len', 'v': 100 * word_chars // n_words}]) AS r
           FROM based WHERE NOT base_failed)),
buckets AS (SELECT lang, source, k, v - v % (1::BIGINT << greatest(length(bin(v)) - 6, 0)) AS bucket, count(*) AS n
            FROM ratios GROUP BY ALL),
upto AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, k ORDER BY bucket) AS upto,
                sum(n) OVER (PARTITION BY lang, source, k) AS every FROM buckets),
quartiles AS (SELECT lang, source, k, min(bucket) FILTER (4 * upto >= every) AS q1, min(bucket) FILTER (4 * upto >= 3 * every) AS q3
              FROM upto GROUP BY ALL),
limits AS (SELECT lang, source,
                  max(q3 + 3 * greatest(q3 - q1, 20)) FILTER (k = 'symbols') AS max_symbols,
                  max(q3 + 3 * greatest(q3 - q1, 150)) FILTER (k = 'dup_lines') AS max_dup_lines,
                  max(q3 + 3 * greatest(q3 - q1, 150)) FILTER (k = 'repeats') AS max_repeats,
                  max(q3 + 3 * greatest(q3 - q1, 50)) FILTER (k = 'word_len') AS max_word_len,
                  max(q1 - 3 * greatest(q3 - q1, 50)) FILTER (k = 'word_len') AS min_word_len
           FROM quartiles GROUP BY ALL),
judged AS (SELECT b.*, CASE WHEN base_failed THEN false ELSE coalesce(
                  1000 * n_symbols // word_chars <= max_symbols AND 1000 * n_dup_lines // n_lines <= max_dup_lines
                  AND 1000 * n_repeat_words // n_words <= max_repeats
                  AND 100 * word_chars // n_words BETWEEN min_word_len AND max_word_len, false) END AS kept
           FROM based b LEFT JOIN limits l ON b.lang IS NOT DISTINCT FROM l.lang AND b.source IS NOT DISTINCT FROM l.source)
"""

QUALITY = f"""WITH d AS (SELECT * FROM documents), {QUALITY_CTES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

MIXING = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n_rows FROM documents GROUP BY source),
roots AS (SELECT source, n_rows, floor(sqrt(n_rows * 1000000))::BIGINT AS root FROM counts),
shares AS (SELECT *, sum(root) OVER ()::BIGINT AS roots, greatest(1000, 50 * count(*) OVER ())::BIGINT AS res FROM roots),
dealt AS (SELECT *, row_number() OVER (ORDER BY res * root % roots DESC, source NULLS FIRST) AS nth,
                 res - sum(res * root // roots) OVER ()::BIGINT AS spare FROM shares),
units AS (SELECT source, n_rows, greatest(1, res * root // roots + CASE WHEN nth <= spare THEN 1 ELSE 0 END)::BIGINT AS a,
                 row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM dealt),
one AS MATERIALIZED (SELECT list(a ORDER BY i) AS a, sum(a)::BIGINT AS period, count(*) AS s FROM units),
sim AS (
  SELECT 0::BIGINT AS t, list_transform(a, lambda x: 0::BIGINT) AS nxt, NULL::BIGINT AS ran FROM one WHERE s > 0
  UNION ALL
  SELECT t + 1, list_transform(nxt, lambda n, i: n + CASE WHEN i = ran2 THEN 1 ELSE 0 END), ran2 FROM (
    SELECT sim.*, list_min(list_transform(nxt, lambda n, i: CASE WHEN n < a[i] AND n * period // a[i] <= t
             THEN ((n + 1) * period + a[i] - 1) // a[i] * s + i - 1 END)) % s + 1 AS ran2 FROM sim, one WHERE t < period)),
plan AS (SELECT ran AS i, t - 1 AS slot, row_number() OVER (PARTITION BY ran ORDER BY t) - 1 AS turn FROM sim WHERE ran IS NOT NULL),
keyed AS (SELECT doc_id, u.source, a, i, md5(coalesce(doc_id::VARCHAR, '')) AS key, (n_rows + 1023) // 1024 AS ranges
          FROM documents d JOIN units u ON d.source IS NOT DISTINCT FROM u.source),
ranged AS (SELECT *, ('0x' || substr(key, 1, 8))::BIGINT % ranges AS r FROM keyed),
placed AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY r, key, doc_id NULLS FIRST) - 1 AS spot FROM ranged)
SELECT doc_id, p.source, spot // 64 AS block, spot % 64 AS place, (spot // 64) // p.a * period + l.slot AS slot,
       (spot // 64) * period // p.a AS release, (((spot // 64) + 1) * period + p.a - 1) // p.a AS deadline
FROM placed p JOIN plan l ON l.i = p.i AND l.turn = (spot // 64) % p.a, one"""

LINE_DEDUP = r"""
WITH t AS (SELECT doc_id, source, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, source, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM t),
inked AS (SELECT *, regexp_matches(l, '[^\x20\x09-\x0D]') AS ink FROM lines),
spread AS (SELECT l FROM inked WHERE ink GROUP BY l HAVING count(DISTINCT coalesce('=' || source, '')) >= 8),
marked AS (SELECT *, ink AND l IN (SELECT l FROM spread) AS gone FROM inked)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (ink) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r"""
