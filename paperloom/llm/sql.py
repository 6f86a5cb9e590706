"""SQL for the queries that SQL can express."""

from __future__ import annotations

OP6 = r"""
WITH d AS (
    SELECT doc_id, source,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':'
            || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
    FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
            WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
    FROM d GROUP BY source
), filled AS (
    SELECT *, row_number() OVER rising AS k,
        CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS BIGINT)
            - coalesce(CAST(sum(2 * source_size) OVER (rising ROWS BETWEEN UNBOUNDED PRECEDING
                AND 1 PRECEDING) AS BIGINT), 0) AS rest,
        CAST(sum(w) OVER (rising ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open
    FROM s WINDOW rising AS (ORDER BY CAST(source_size AS DOUBLE) / w, w, source NULLS LAST)
), level AS (
    SELECT arg_min(rest / open, k) AS level FROM filled WHERE 2 * source_size > rest / open * w
), t AS (
    SELECT source, source_size,
        least(CAST(2 * source_size AS DOUBLE), coalesce(level * w, 2 * source_size)) AS target
    FROM s, level
), b AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
    FROM t
), c AS (
    SELECT d.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
        sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto,
        sum(size) OVER (PARTITION BY d.source, h) AS here
    FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target,
    CAST(size * (whole + CASE WHEN upto <= budget
        OR (upto - here <= budget AND upto - budget < budget - (upto - here)) THEN 1 ELSE 0 END)
        AS BIGINT) AS taken
FROM c
"""

SQL: dict[str, str] = {
    "op6_mixing": OP6,
}
