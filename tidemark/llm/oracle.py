"""SQL for the operators that SQL can express: quality rules and sharding."""

from __future__ import annotations

from .quality_rules import LEAN, MEASURES, SPLIT_DEN, SPLIT_NUM, TAIL


def _fences(name: str, sketch: str, keys: str) -> str:
    by = f"{keys}, m" if keys else "m"
    floor = lambda b: f"CASE WHEN {b} < 64 THEN {b} ELSE ({b} - 32 * ({b} // 32 - 1)) << ({b} // 32 - 1) END"
    return f"""{name}_ranks AS (SELECT {by}, v, stop, lead(v) OVER (PARTITION BY {by} ORDER BY b) AS next, CAST(sum(n) OVER w AS DOUBLE) AS w0, CAST(sum(n * v) OVER w AS DOUBLE) AS s0,
  CAST(sum(n) OVER (PARTITION BY {by}) AS BIGINT) AS total, CAST(sum(n * v) OVER (PARTITION BY {by}) AS DOUBLE) AS s, CAST(sum(CAST(n * v AS HUGEINT) * v) OVER (PARTITION BY {by}) AS DOUBLE) AS q
  FROM (SELECT *, {floor("b")} AS v, {floor("(b + 1)")} - 1 AS stop FROM {sketch}) p WINDOW w AS (PARTITION BY {by} ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name}_cuts AS (SELECT *, CAST(total AS DOUBLE) AS d, q - s * s / CAST(total AS DOUBLE) AS spread,
  CASE WHEN next IS NOT NULL AND {TAIL} * (CAST(total AS DOUBLE) - w0) <= CAST(total AS DOUBLE) THEN (s * w0 - CAST(total AS DOUBLE) * s0) * (s * w0 - CAST(total AS DOUBLE) * s0) / (CAST(total AS DOUBLE) * w0 * (CAST(total AS DOUBLE) - w0)) END AS between_ FROM {name}_ranks),
{name} AS (SELECT {by}, total, CASE WHEN coalesce({SPLIT_DEN} * between_ >= {SPLIT_NUM} * spread, false) THEN (stop + next) // 2 ELSE max(stop) OVER (PARTITION BY {by}) END AS fence
  FROM {name}_cuts QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY between_ DESC NULLS LAST, v) = 1)"""


_BUCKET = "CASE WHEN v < 64 THEN v ELSE 32 * (length(bin(v)) - 6) + (v >> (length(bin(v)) - 6)) END"

QUALITY_RULES = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT rid, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w) s),
twice AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY rid),
c AS (SELECT rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, CAST(length(regexp_replace(text, '\\P{{Lu}}+', '', 'g')) AS BIGINT) AS upper FROM w LEFT JOIN rep USING (rid)),
measured AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  coalesce(n_symbols * 1000 // nullif(word_chars, 0), 0) AS symbol_pm, coalesce(upper * 1000 // nullif(word_chars, 0), 0) AS upper_pm,
  coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0) AS dup_line_pm, coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0) AS repeat_pm,
  coalesce(word_chars * 10 // nullif(n_words, 0), 0) AS mean_len_10 FROM c),
points AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS m, {m} AS v FROM measured WHERE NOT base_failed" for m in MEASURES)}),
own_sketch AS (SELECT lang, source, m, b, count(*) AS n FROM (SELECT *, {_BUCKET} AS b FROM points) p GROUP BY ALL),
lang_sketch AS (SELECT lang, m, b, sum(n) AS n FROM own_sketch GROUP BY ALL),
all_sketch AS (SELECT m, b, sum(n) AS n FROM own_sketch GROUP BY ALL),
{_fences("own_fence", "own_sketch", "lang, source")},
{_fences("lang_fence", "lang_sketch", "lang")},
{_fences("all_fence", "all_sketch", "")},
fences AS (SELECT o.lang, o.source, o.m, (o.total * o.fence + {LEAN} * ((l.total * l.fence + {LEAN} * a.fence) // (l.total + {LEAN}))) // (o.total + {LEAN}) AS fence
  FROM own_fence o JOIN lang_fence l ON l.lang = o.lang AND l.m = o.m JOIN all_fence a ON a.m = o.m),
wide AS (SELECT lang, source, {", ".join(f"max(CASE WHEN m = '{m}' THEN fence END) AS {m}_max" for m in MEASURES)} FROM fences GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(f"coalesce({m} > {m}_max, false)" for m in MEASURES)}) AS kept, {", ".join(MEASURES)}
FROM measured LEFT JOIN wide USING (lang, source)"""

SHARDING = """WITH crc_table AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(i AS BIGINT) AS i FROM range(256) r(i)) s),
rows AS (SELECT doc_id, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size, md5(coalesce(text, '')) AS k FROM documents),
placed AS (SELECT *, coalesce(sum(size) OVER w, 0) AS start, row_number() OVER (ORDER BY k, doc_id) - 1 AS rank, sum(size) OVER () AS total FROM rows
  WINDOW w AS (ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
dealt AS (SELECT *, CAST(start * 40 // total AS INTEGER) AS shard FROM placed),
sums AS (SELECT k, any_value(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(text), '..'), lambda x: CAST('0x' || x AS BIGINT))),
  lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)) AS text_crc32 FROM (SELECT DISTINCT k, text FROM rows) d, crc_table GROUP BY k)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(rank - min(rank) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt JOIN sums USING (k)"""
