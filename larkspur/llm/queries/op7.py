from .._common import table
from ..mixing import mix

NAME = "op7_mixing"

SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 4))::INT AS bucket
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
filling AS (
  SELECT *, row_number() OVER o AS k, coalesce(sum(source_size * 3) OVER b, 0) AS clamped, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rest,
         sum(source_size) OVER () AS total
  FROM src
  WINDOW o AS (ORDER BY source_size * 3 / weight, source), b AS (ORDER BY source_size * 3 / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stop AS (
  SELECT k, clamped, rest, total FROM filling
  WHERE source_size * 3 > (total - clamped)::DOUBLE * weight / rest ORDER BY k LIMIT 1),
target AS (
  SELECT f.source, f.source_size,
         CASE WHEN f.k < s.k OR s.k IS NULL THEN (f.source_size * 3)::DOUBLE ELSE (s.total - s.clamped)::DOUBLE * f.weight / s.rest END AS target
  FROM filling f LEFT JOIN stop s ON true),
want AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM target),
hist AS (
  SELECT source, bucket, sum(size) AS size,
         coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized GROUP BY source, bucket),
chosen AS (
  SELECT h.source, h.bucket, h.before + h.size / 2 <= w.target - w.whole * w.source_size AS more
  FROM hist h JOIN want w ON h.source IS NOT DISTINCT FROM w.source)
SELECT d.doc_id, d.size, w.source_size, w.target, (d.size * (w.whole + c.more::BIGINT))::BIGINT AS taken
FROM sized d JOIN want w ON d.source IS NOT DISTINCT FROM w.source
JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source AND d.bucket = c.bucket
"""


def run(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))
