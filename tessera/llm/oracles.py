"""DuckDB SQL for the numbered operators whose whole results SQL can express."""

from __future__ import annotations

#: CRC-32 (reflected polynomial 0xEDB88320) byte by byte from hexadecimal text; jump consistent hashing as a recursion.
SHARDING = """
WITH RECURSIVE polynomial AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS rest
), bytes AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), crc AS (
    SELECT doc_id, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(n), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), lambda c, b: xor(rest[(xor(c, b) & 255) + 1], c >> 8))) AS crc
    FROM bytes, polynomial
), jump AS (
    SELECT doc_id, CAST(doc_id AS UHUGEINT) AS k, CAST(0 AS BIGINT) AS j FROM documents
    UNION ALL
    SELECT doc_id, k, CAST(floor((j + 1) * (CAST(2147483648 AS DOUBLE) / (CAST(k // 8589934592 AS DOUBLE) + 1))) AS BIGINT)
    FROM (SELECT doc_id, (k * CAST(2862933555777941757 AS UHUGEINT) + 1) % CAST(18446744073709551616 AS UHUGEINT) AS k, j FROM jump WHERE j < 9)
), placed AS (
    SELECT doc_id, CAST(max(j) FILTER (j < 8) AS INTEGER) AS shard, CAST(max(j) FILTER (j < 9) AS INTEGER) AS grown_shard FROM jump GROUP BY doc_id
)
SELECT doc_id, CAST(n + 1 AS BIGINT) AS size, crc AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
FROM crc JOIN placed USING (doc_id)
"""

#: Bytes as rows of hexadecimal pairs; a byte goes if one of the last 100 starts is that of a string seen before.
SUFFIXES = """
WITH bytes AS (
    SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, unnest(range(octet_length(encode(coalesce(text, ''))))) AS p, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
    SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 2) AS byte, CASE WHEN p + 100 <= n THEN substr(h, CAST(2 * p + 1 AS BIGINT), 200) END AS w FROM bytes
), marked AS (
    SELECT doc_id, p, byte, w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, p) > 1 AS seen FROM windows
), judged AS (
    SELECT doc_id, p, byte, bool_or(seen) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM marked
), edges AS (
    SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), FALSE) AS begins FROM judged
), totals AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(byte, '' ORDER BY p) FILTER (NOT gone) AS kept FROM edges GROUP BY doc_id
)
SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM documents LEFT JOIN totals USING (doc_id)
"""

#: Words as rows; a word goes if one of the last 35 starts is that of a sequence that starts elsewhere too.
FM_INDEX = r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), words AS (
    SELECT doc_id, len(words) AS n, unnest(range(len(words))) AS p, unnest(words) AS word FROM texts
), windows AS (
    SELECT doc_id, p, word, CASE WHEN p + 35 <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) END AS w FROM words
), marked AS (
    SELECT doc_id, p, word, w IS NOT NULL AND count(*) OVER (PARTITION BY w) > 1 AS repeated FROM windows
), judged AS (
    SELECT doc_id, p, word, bool_or(repeated) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM marked
), totals AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM judged GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN totals USING (doc_id)
"""
