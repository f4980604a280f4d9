import re

from pyspark.sql import functions as F

from .._common import table
from ..license_rules import CONFIDENCE, RULES
from ..licenses import BASE, scan

NAME = "op8_licenses"


def _level(p: int) -> str:
    """One priority's kept spans, by definition: none of a better one overlaps them, and none of their own holds them."""
    better = " ".join(f"AND NOT EXISTS (SELECT 1 FROM k{q} b WHERE b.uid = a.uid AND b.s <= a.e AND b.e >= a.s)" for q in range(1, p))
    return f"""c{p} AS (SELECT * FROM spans a WHERE priority = {p} {better}),
k{p} AS (SELECT * FROM c{p} a WHERE NOT EXISTS (SELECT 1 FROM c{p} b WHERE b.uid = a.uid AND b.s <= a.s AND b.e >= a.e AND (b.e - b.s > a.e - a.s OR b.id < a.id)))"""


# Two spaces stand between words, so that matches side by side can take one each.
_wide = lambda regex: re.sub(r" (\??)", lambda m: "(?:  )?" if m[1] else "  ", regex)
_RULES = ", ".join(f"({i}, '{label}', {p}, [{', '.join(map(repr, k))}], ' (?:{_wide(r)}) ')" for i, (label, p, k, r) in enumerate(RULES))
_BASE = ", ".join(f"('{label}', {len(phrase.split())}, ' (?:{_wide(phrase)}) ')" for phrase, label in BASE.items())
_PIECES = "string_split(regexp_replace(body, regex, chr(1) || '\\0' || chr(2), 'g'), chr(1))"
_spaces = lambda x: f"(len({x}) - len(replace({x}, ' ', '')))"

SQL = rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS uid, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS t FROM documents),
d AS (SELECT doc_id, uid, CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END AS words, '  ' || replace(t, ' ', '  ') || '  ' AS body FROM t),
rules(id, label, priority, keywords, regex) AS (VALUES {_RULES}),
phrases(label, n, regex) AS (VALUES {_BASE}),
pieces AS (SELECT uid, id, priority, {_PIECES} AS pieces FROM d JOIN rules ON list_has_any(words, keywords)),
cut AS (SELECT uid, id, priority, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS nth FROM pieces WHERE len(pieces) > 1),
placed AS (SELECT *, sum({_spaces('piece')}) OVER (PARTITION BY uid, id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cut),
spans AS (SELECT uid, id, priority, (before - 1) // 2 AS s, (before - 1) // 2 + {_spaces("split_part(piece, chr(2), 1)")} // 2 - 1 AS e FROM placed WHERE nth > 1),
{", ".join(map(_level, sorted(CONFIDENCE)))},
kept AS ({" UNION ALL ".join(f"SELECT uid, id, {c} AS sure FROM k{p}" for p, c in CONFIDENCE.items())}),
found AS (SELECT uid, list(DISTINCT label) AS labels, max(sure) AS sure FROM kept JOIN rules USING (id) GROUP BY uid),
base_cut AS (SELECT uid, label, unnest({_PIECES}) AS piece, generate_subscripts({_PIECES}, 1) AS nth FROM d, phrases),
base_placed AS (SELECT *, sum({_spaces('piece')}) OVER (PARTITION BY uid, label ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM base_cut),
base AS (SELECT uid, count(*) AS n, min((before - 1) // 2) AS first, max((before - 1) // 2) AS last, list(DISTINCT label) AS own FROM base_placed WHERE nth > 1 GROUP BY uid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first::BIGINT AS first_word, last::BIGINT AS last_word, array_to_string(list_sort(coalesce(own, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(labels, [])))), ',') AS labels, greatest(coalesce(sure, 0), CASE WHEN n > 0 THEN 0.75 ELSE 0 END)::DOUBLE AS score
FROM d LEFT JOIN base USING (uid) LEFT JOIN found USING (uid)
"""


def digest(docs):
    base, found = F.col("base"), F.col("detections")
    own = F.transform(base, lambda b: b["label"])
    labels = F.array_union(own, F.transform(found, lambda d: d["label"]))
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.aggregate(base, F.lit(0).cast("long"), lambda n, b: n + b["n"]).alias("n_base"),
        F.array_min(F.transform(base, lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda b: b["last"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform(found, lambda d: d["confidence"])), F.lit(0.0)), F.when(F.size(base) > 0, 0.75).otherwise(0.0)).alias("score"),
    )


def run(spark, sf_dir):
    return digest(table(spark, sf_dir, "documents"))
