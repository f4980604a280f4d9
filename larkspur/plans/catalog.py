"""Registered queries of the core library and the SQL that each must agree with."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import casefold, clean_text, coerce_bid, collapse_space, decode_basic_entities, fingerprint, normalize_time, remove_controls, strip_tags
from ..operators.bundle import BundleError, aligned, check_ads, check_manifest, check_vectors, ends_of, latest, load, publish, read_manifest, read_vectors, repeated_ids, write_vectors
from ..operators.dedup import accepted_lines, duplicates
from ..operators.embed import BucketEmbedder, compose_text, embed, encoded, load_clean, token_counts, token_stats, too_long
from ..operators.evaluate import parity
from ..operators.records import judged
from ..operators.report import counts_by_code, examples, warning_counts
from ..operators.validate import validate, validate_lines
from ..operators.vectors import bad_component, diff_counts, disagreements, integrity, norm, precision_at_k, scored, search, top_k
from ..schema import Limits
from ..sources.generate import nearest_before, raw_lines
from ..sources.lines import numbered_lines
from ..storage import file_sha256, fixed, read_text, scratch_path, table_checksums, together, write_json, write_lines
from ..streaming.ingest import judge_batch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- search

#: Every twentieth vector asks, all answer.
_ASKED = "vec_id % 20 = 0"
_SCORED = f"""
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS row, v.label, q.label AS wanted, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
  FROM embeddings q CROSS JOIN embeddings v WHERE q.{_ASKED}),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row)::INT AS rank FROM s)
"""


def _search(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(_ASKED).select(F.col("vec_id").alias("query_id"), "embedding"), k, "vec_id", "embedding")


@query("topk_exact", _SCORED + "SELECT query_id, rank, row, round(score, 6) AS score FROM hits WHERE rank <= 10")
def _(spark, sf_dir):
    return _search(spark, sf_dir, 10).withColumn("score", F.round("score", 6))


@query("self_match", _SCORED + "SELECT query_id, row = query_id AS itself, round(score, 4) AS score FROM hits WHERE rank = 1")
def _(spark, sf_dir):
    return _search(spark, sf_dir, 1).select("query_id", (F.col("row") == F.col("query_id")).alias("itself"), F.round("score", 4).alias("score"))


_FIRST = "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id AS row, round(list_inner_product(q.e, embedding::DOUBLE[]), 6) AS score FROM embeddings, q"


def _first_vector(vectors: DataFrame) -> list[float]:
    return vectors.orderBy("vec_id").select("embedding").first()[0]


@query("topk_single", f"SELECT * FROM ({_FIRST}) ORDER BY score DESC, row LIMIT 10")
def _(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, _first_vector(vectors), 10, "vec_id", "embedding").withColumn("score", F.round("score", 6))


@query("topk_full_sort", _FIRST)
def _(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return scored(vectors, _first_vector(vectors), "vec_id", "embedding").orderBy(F.desc("score"), "row").withColumn("score", F.round("score", 6))


@query("precision_at_k", _SCORED + """
SELECT h.hits, n.possible, h.hits / n.possible AS precision
FROM (SELECT count(*) FILTER (label = wanted) AS hits FROM hits WHERE rank <= 5) h, (SELECT count(*) * 5 AS possible FROM embeddings WHERE """ + _ASKED + ") n")
def _(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    expected = vectors.where(_ASKED).select(F.col("vec_id").alias("query_id"), F.col("label").alias("category"))
    return precision_at_k(_search(spark, sf_dir, 5), expected, vectors.select(F.col("vec_id").alias("row"), F.col("label").alias("category")), 5)


@query("lookup_hits_join", _SCORED + "SELECT query_id, rank, row, label FROM hits WHERE rank <= 5")
def _(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), "label")
    return _search(spark, sf_dir, 5).join(labels, "row").select("query_id", "rank", "row", "label")


@query("search_parity", _SCORED + """
SELECT query_id, row, score FROM (SELECT query_id, row, round(score + CASE WHEN rank % 2 = 0 THEN 0.05 ELSE 0 END, 6) AS score, rank, max(CASE WHEN rank = 10 THEN score END) OVER (PARTITION BY query_id) AS last FROM hits)
WHERE rank IN (11, 12) AND score > last + 1e-5""")
def _(spark, sf_dir):
    """Another reader's twelve hits, every second scored too high: those that the ten here should have had."""
    theirs = _search(spark, sf_dir, 12).withColumn("score", F.col("score") + F.when(F.col("rank") % 2 == 0, 0.05).otherwise(0.0))
    return disagreements(theirs, _search(spark, sf_dir, 10)).withColumn("score", F.round("score", 6))


@query("ground_truth_parity", _SCORED + """
SELECT query_id, rank::BIGINT AS at, 'score' AS fault FROM hits WHERE rank <= 5 AND (query_id // 20 + rank) % 7 = 0
UNION ALL SELECT query_id, rank::BIGINT, 'ad_id' FROM hits WHERE rank = 3 AND query_id % 40 = 0""")
def _(spark, sf_dir):
    """Another reader's hits with some scores and some ids changed, replayed."""
    vectors = table(spark, sf_dir, "embeddings")
    rows = vectors.select(F.col("vec_id").alias("row"), F.concat(F.lit("ad_"), "vec_id").alias("ad_id"), F.col("embedding").alias("vector"))
    asked = rows.where("row % 20 = 0").select(F.col("row").alias("query_id"), "vector")
    told = search(rows.select("row", "vector"), asked, 5).join(rows.select("row", "ad_id"), "row")
    told = told.withColumn("score", F.col("score") + F.when((F.floor(F.col("query_id") / 20) + F.col("rank")) % 7 == 0, 0.01).otherwise(0.0))
    return parity(rows, asked, told.withColumn("ad_id", F.when((F.col("rank") == 3) & (F.col("query_id") % 40 == 0), "other").otherwise(F.col("ad_id"))))


# ---------------------------------------------------------------- vector checks


@query("vector_integrity", """
SELECT count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS wrong_dim, count(*) FILTER (bad) AS nonfinite, count(*) FILTER (NOT bad AND abs(norm - 1) > 1e-3) AS off_unit
FROM (SELECT embedding, len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0 AS bad, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings)""")
def _(spark, sf_dir):
    return integrity(table(spark, sf_dir, "embeddings"), 64, "vec_id", "embedding").select("n", "wrong_dim", "nonfinite", "off_unit")


@query("vector_norms", "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def _(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"))


@query("vector_nonfinite", "SELECT vec_id, len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0 AS bad FROM embeddings")
def _(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", bad_component(F.col("embedding")).alias("bad"))


# ---------------------------------------------------------------- cleaning

_TAGS = "regexp_replace(html, '<[^>]{1,200}>', ' ', 'g')"
_BASIC = f"replace(replace(replace(replace(replace({_TAGS}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_SPACED = r"trim(regexp_replace(text, '[\t-\r\x1c-\x1f ]+', ' ', 'g'))"


@query("clean_tags", f"SELECT page_id, md5({_TAGS}) AS digest FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(strip_tags(F.col("html")).cast("binary")).alias("digest"))


@query("clean_entities", f"SELECT page_id, md5({_BASIC}) AS digest FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(decode_basic_entities(strip_tags(F.col("html"))).cast("binary")).alias("digest"))


@query("clean_controls", r"SELECT doc_id, md5(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')) AS digest FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(remove_controls(F.col("text")).cast("binary")).alias("digest"))


@query("clean_whitespace", f"SELECT doc_id, md5({_SPACED}) AS digest FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(collapse_space(F.col("text")).cast("binary")).alias("digest"))


@query("clean_chain", f"SELECT doc_id, md5({_SPACED}) AS digest, CASE WHEN {_SPACED} <> text THEN 'W001' ELSE '' END AS warnings FROM documents")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", clean_text("text").alias("c"))
    return rows.select("doc_id", F.md5(F.col("c.text").cast("binary")).alias("digest"), F.array_join("c.warnings", ",").alias("warnings"))


@query("clean_noise", f"""SELECT doc_id, md5({_SPACED}) AS digest, 'W003,W002,W004' || CASE WHEN {_SPACED} <> text THEN ',W001' ELSE '' END AS warnings FROM documents WHERE text LIKE '%e%' AND regexp_matches(text, '[abcd]') AND {_SPACED} <> ''""")
def _(spark, sf_dir):
    """Texts with full-width letters, a tag around, entities and a zero-width space, cleaned to what they were."""
    noisy = F.concat(F.lit("<b"), F.lit(">"), F.replace(F.translate("text", "abcd", "ａｂｃｄ"), F.lit("e"), F.lit("&#101;")), F.lit("​"))
    rows = table(spark, sf_dir, "documents").where("text LIKE '%e%' AND text RLIKE '[abcd]'").select("doc_id", F.col("text"), clean_text(noisy).alias("c"))
    # the tag leaves one space before the text, which is white space to collapse
    told = F.filter("c.warnings", lambda w: (w != "W001") | (F.col("c.text") != F.col("text")))
    return rows.where("c.text <> ''").select("doc_id", F.md5(F.col("c.text").cast("binary")).alias("digest"), F.array_join(told, ",").alias("warnings"))


@query("content_fingerprint", "SELECT doc_id, sha256(replace(lower(split_part(text, chr(10), 1)), 'ß', 'ss') || chr(10) || replace(lower(text), 'ß', 'ss')) AS print FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fingerprint(F.split_part("text", F.lit("\n"), F.lit(1)), F.col("text")).alias("print"))


@query("bid_coerce", "SELECT event_id, value AS bid, 'W005' AS warnings FROM events")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", coerce_bid(F.concat(F.lit(" $"), F.col("value").cast("string"))).alias("b"))
    return rows.select("event_id", "b.bid", F.array_join("b.warnings", ",").alias("warnings"))


@query("timestamp_normalize", "SELECT event_id, strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS time FROM events")
def _(spark, sf_dir):
    given = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return table(spark, sf_dir, "events").select("event_id", normalize_time(given)["time"].alias("time"))


# ---------------------------------------------------------------- rules

_HEAD, _REST = "split_part(text, chr(10), 1)", "coalesce(substr(text, nullif(strpos(text, chr(10)), 0) + 1), '')"


def _parts() -> tuple:
    text = F.col("text")
    at = F.locate("\n", text)
    return F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text), F.when(at > 0, F.substr(text, at + 1)).otherwise(F.lit(""))


_COLLAPSED = "trim(regexp_replace({}, '[\\t-\\r\\x1c-\\x1f ]+', ' ', 'g'))"


@query("rule_codes", f"""
SELECT doc_id, CASE WHEN h = 0 THEN 'E004' WHEN h < 10 THEN 'E005' WHEN h > 120 OR d > 1000 THEN 'E006' WHEN doc_id % 3 = 0 THEN 'E009' WHEN doc_id % 5 = 0 THEN 'E012' END AS code
FROM (SELECT doc_id, length({_COLLAPSED.format('substr(text, 1, n)')}) AS h, length({_COLLAPSED.format('substr(text, n + 1)')}) AS d FROM (SELECT doc_id, text, (doc_id % 130)::INT AS n FROM documents))""")
def _(spark, sf_dir):
    """Documents as raw records, cut into headline and description: the first rule that each breaks."""
    n = (F.col("doc_id") % 130).cast("int")
    record = F.struct(
        F.concat(F.lit("d"), "doc_id").alias("ad_id"), F.substr("text", F.lit(1), n).alias("headline"), F.substr("text", n + 1).alias("description"), F.when(F.col("doc_id") % 3 == 0, "none").otherwise("gaming").alias("category"),
        F.lit("adv").alias("advertiser_id"), F.lit(1.5).alias("bid_cpm_usd"), F.when(F.col("doc_id") % 5 == 0, "soon").otherwise("2026-01-01").alias("created_at"),
    )
    rows = judged(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_no"), F.to_json(record).alias("line")))
    return rows.select(F.col("line_no").alias("doc_id"), "verdict.code")


@query("compose_text", f"SELECT doc_id, md5(CASE WHEN {_REST} = '' THEN {_HEAD} WHEN right({_HEAD}, 1) IN ('.', '!', '?') THEN {_HEAD} || ' ' || {_REST} ELSE {_HEAD} || '. ' || {_REST} END) AS digest FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(compose_text(*_parts()).cast("binary")).alias("digest"))


# ---------------------------------------------------------------- events through the whole validation

_KINDS = frozenset({"click", "purchase", "signup", "view"})
_JUDGED = """
WITH r AS (SELECT event_id, user_id, CASE WHEN value <= 0 OR value > 50 THEN 'E008' WHEN event_type NOT IN ('click', 'purchase', 'signup', 'view') THEN 'E009' END AS bad FROM events),
p AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM r WHERE bad IS NULL),
v AS (SELECT r.event_id, coalesce(bad, CASE WHEN k > 1 THEN 'E010' END) AS code FROM r LEFT JOIN p USING (event_id))
"""


def _raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw records: one id for each user, a headline of its own for each event, no description."""
    e = table(spark, sf_dir, "events")
    record = F.struct(
        F.concat(F.lit("user_"), "user_id").alias("ad_id"), F.concat(F.lit("Event "), "event_id", F.lit(" of its kind")).alias("headline"), F.concat(F.upper("event_type"), F.lit(" ")).alias("category"),
        F.lit("adv_1").alias("advertiser_id"), F.col("value").alias("bid_cpm_usd"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
    )
    return e.select(F.col("event_id").alias("line_no"), F.to_json(record).alias("line"))


def _validated(spark: SparkSession, sf_dir: str):
    return validate_lines(_raw_events(spark, sf_dir), Limits(categories=_KINDS))


@query("validate_verdicts", _JUDGED + "SELECT event_id AS line_no, code FROM v")
def _(spark, sf_dir):
    done = _validated(spark, sf_dir)
    return done.accepted.select("line_no", F.lit(None).cast("string").alias("code")).unionByName(done.rejects.select("line_no", "code"))


@query("reject_counts", _JUDGED + "SELECT code, count(*) AS n FROM v WHERE code IS NOT NULL GROUP BY code")
def _(spark, sf_dir):
    return counts_by_code(_validated(spark, sf_dir).rejects)


@query("warning_counts", _JUDGED + "SELECT unnest(['W001', 'W006']) AS warning, count(*) AS n FROM v WHERE code IS NULL")
def _(spark, sf_dir):
    return warning_counts(_validated(spark, sf_dir).accepted)


@query("unknown_category", _JUDGED + "SELECT event_id AS line_no, 'unknown category ' || event_type AS detail FROM v JOIN events USING (event_id) WHERE code = 'E009'")
def _(spark, sf_dir):
    return _validated(spark, sf_dir).rejects.where("code = 'E009'").select("line_no", "detail")


#: Records by line: a file of the events, numbered from 1.
_BY_LINE = _JUDGED + ", n AS (SELECT v.*, user_id, value, row_number() OVER (ORDER BY event_id) AS line FROM v JOIN events USING (event_id))"


def _validated_file(spark: SparkSession, sf_dir: str) -> tuple[str, dict]:
    """The events as a raw file through the whole stage: its folder of outputs, and its report as read back."""
    folder = scratch_path(spark, "validate")
    write_lines(_raw_events(spark, sf_dir), "line_no", "line", f"{folder}/raw.jsonl")
    validate(spark, f"{folder}/raw.jsonl", f"{folder}/out", limits=Limits(categories=_KINDS))
    return f"{folder}/out", json.loads(read_text(spark, f"{folder}/out/validation_report.json"))


@query("validate_files", _BY_LINE + """
SELECT 'clean' AS file, row_number() OVER (ORDER BY line) AS at, 'user_' || user_id AS id, round(value, 6) AS bid, NULL AS code, NULL::BIGINT AS line FROM n WHERE code IS NULL
UNION ALL SELECT 'rejected', row_number() OVER (ORDER BY line), 'user_' || user_id, round(value, 6), code, line FROM n WHERE code IS NOT NULL""")
def _(spark, sf_dir):
    """Both files of lines, read as numbered lines again."""
    out, _ = _validated_file(spark, sf_dir)
    at = lambda path: F.get_json_object("line", path)
    clean, bad = (numbered_lines(spark, f"{out}/{name}.jsonl") for name in ("ads_clean", "ads_rejected"))
    clean = clean.select(F.lit("clean").alias("file"), F.col("line_no").alias("at"), at("$.ad_id").alias("id"), F.round(at("$.bid_cpm_usd").cast("double"), 6).alias("bid"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("line"))
    return clean.unionByName(bad.select(F.lit("rejected").alias("file"), F.col("line_no").alias("at"), at("$.record.ad_id").alias("id"), F.round(at("$.record.bid_cpm_usd").cast("double"), 6).alias("bid"), at("$.code").alias("code"), at("$.line").cast("long").alias("line")))


@query("validation_report", _JUDGED + """
SELECT 'read' AS name, count(*)::DOUBLE AS n FROM v UNION ALL SELECT 'accepted', count(*) FILTER (code IS NULL) FROM v UNION ALL SELECT 'rejected', count(code) FROM v
UNION ALL SELECT 'pass_rate', round(count(*) FILTER (code IS NULL) / count(*), 6) FROM v UNION ALL SELECT code, count(*) FROM v WHERE code IS NOT NULL GROUP BY code
UNION ALL SELECT unnest(['W001', 'W006']), count(*) FROM v WHERE code IS NULL UNION ALL SELECT 'examples ' || code, least(count(*), 5) FROM v WHERE code IS NOT NULL GROUP BY code""")
def _(spark, sf_dir):
    _, told = _validated_file(spark, sf_dir)
    counts = told["totals"] | told["rejections_by_code"] | told["warnings_by_code"] | {f"examples {c}": len(x) for c, x in told["examples"].items()}
    return spark.createDataFrame([(k, float(v)) for k, v in counts.items()], "name string, n double")


@query("stream_verdicts", _JUDGED + "SELECT event_id AS line_no, code FROM v")
def _(spark, sf_dir):
    """The events in four batches, as a stream would bring them: what one file would give."""
    folder, lines = scratch_path(spark, "stream"), fixed(_raw_events(spark, sf_dir))
    # Any cuts will do; these come from a summary of bounded size, not from all the numbers in one task.
    cuts = lines.agg(F.percentile_approx("line_no", [0.25, 0.5, 0.75], 1000).alias("p")).first()["p"] or []
    part = F.lit(0)
    for c in cuts:
        part = part + (F.col("line_no") > c).cast("int")
    parts = [judge_batch(lines.where(part == b), b, folder, Limits(categories=_KINDS)) for b in range(4)]
    return functools.reduce(DataFrame.unionByName, [x for p in parts for x in (p.accepted.select("line_no", F.lit(None).cast("string").alias("code")), p.rejects.select("line_no", "code"))])


@query("examples_per_code", _JUDGED + "SELECT code, rank, event_id AS line_no FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY event_id)::INT AS rank FROM v WHERE code IS NOT NULL) WHERE rank <= 5")
def _(spark, sf_dir):
    return examples(_validated(spark, sf_dir).rejects).select("code", "rank", "line_no")


@query("json_records", "SELECT event_id, 'E003' AS code FROM events WHERE json_type(props) <> 'OBJECT' UNION ALL SELECT event_id, 'E002' FROM events WHERE json_type(props) = 'OBJECT'")
def _(spark, sf_dir):
    """props as raw lines: JSON objects that lack every required field."""
    rows = judged(table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.col("props").alias("line")))
    return rows.select(F.col("line_no").alias("event_id"), "verdict.code")


# ---------------------------------------------------------------- de-duplication


@query("dedup_content", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY replace(lower(text), 'ß', 'ss')")
def _(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.sha2(casefold("text"), 256).alias("print"))
    return keyed.groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("print")


@query("dedup_id", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.col("user_id").cast("string").alias("id"), F.col("event_id").cast("string").alias("print"), "user_id")
    return rows.join(accepted_lines(rows), "line_no", "left_semi").select("user_id", F.col("line_no").alias("event_id"))


@query("dedup_two_keys", """
WITH RECURSIVE d AS (SELECT doc_id, n_chars::VARCHAR AS id, md5(text) AS print, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
g AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS doc_id, NULL::VARCHAR AS code, []::VARCHAR[] AS ids, []::VARCHAR[] AS prints
  UNION ALL SELECT d.n, d.doc_id, CASE WHEN list_contains(ids, id) THEN 'E010' WHEN list_contains(prints, print) THEN 'E011' END,
    CASE WHEN list_contains(ids, id) OR list_contains(prints, print) THEN ids ELSE list_append(ids, id) END, CASE WHEN list_contains(ids, id) OR list_contains(prints, print) THEN prints ELSE list_append(prints, print) END
  FROM g JOIN d ON d.n = g.n + 1)
SELECT doc_id AS line_no, code FROM g WHERE code IS NOT NULL""")
def _(spark, sf_dir):
    """Ids are lengths, fingerprints texts; the SQL goes through the rows one by one."""
    return duplicates(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_no"), F.col("n_chars").cast("string").alias("id"), F.sha2("text", 256).alias("print")))


# ---------------------------------------------------------------- tokens, rows, ids

_TOKENS = r"len(regexp_extract_all(text, '\S+')) + 2"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), F.concat(F.lit("d"), "doc_id").alias("ad_id"), "text")


@query("token_counts", f"SELECT doc_id, {_TOKENS} AS n_tokens FROM documents")
def _(spark, sf_dir):
    return token_counts(_texts(spark, sf_dir), BucketEmbedder()).select(F.col("row").alias("doc_id"), F.col("n_tokens").cast("long").alias("n_tokens"))


@query("token_percentiles", f"SELECT trunc(quantile_cont(n, 0.5))::BIGINT AS p50, trunc(quantile_cont(n, 0.99))::BIGINT AS p99, max(n) AS max, count(*) FILTER (n > 256) AS truncated FROM (SELECT {_TOKENS} AS n FROM documents)")
def _(spark, sf_dir):
    return token_stats(token_counts(_texts(spark, sf_dir), BucketEmbedder()), 256)


@query("token_gate", f"SELECT doc_id, n_tokens FROM (SELECT doc_id, {_TOKENS} AS n_tokens FROM documents) WHERE n_tokens > 256 ORDER BY doc_id LIMIT 10")
def _(spark, sf_dir):
    return too_long(token_counts(_texts(spark, sf_dir), BucketEmbedder()), 256).select(F.col("row").alias("doc_id"), F.col("n_tokens").cast("long").alias("n_tokens"))


@query("duplicate_ids", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def _(spark, sf_dir):
    return repeated_ids(table(spark, sf_dir, "events"), "user_id")


@query("first_last_id", "SELECT count(*) AS n, min_by(source, doc_id) AS a, max_by(source, doc_id) AS z, count(*) FILTER (trim(source) = '') AS blank FROM documents")
def _(spark, sf_dir):
    return ends_of(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), F.col("source").alias("ad_id")))


@query("row_alignment", "SELECT vec_id AS row FROM embeddings WHERE NOT (label = 1 AND vec_id % 2 = 0)")
def _(spark, sf_dir):
    """Records and vectors of which some have another id."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.concat(F.lit("ad_"), "vec_id").alias("ad_id"), "embedding", "label")
    other = F.when((F.col("label") == 1) & (F.col("row") % 2 == 0), "other").otherwise(F.col("ad_id"))
    return aligned(v.select("row", other.alias("ad_id")), v.select("row", "ad_id", "embedding")).select("row")


@query("oracle_diff", """
SELECT coalesce(e.code, a.code) AS code, coalesce(e.n, 0) AS expected, coalesce(a.n, 0) AS actual, coalesce(e.n, 0) = coalesce(a.n, 0) AS agree
FROM (SELECT event_type AS code, count(*) AS n FROM events WHERE value > 50 GROUP BY 1) e
FULL JOIN (SELECT lang AS code, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT event_type, count(*) FROM events GROUP BY 1) a ON a.code = e.code""")
def _(spark, sf_dir):
    count = lambda df, c: df.groupBy(F.col(c).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    e = table(spark, sf_dir, "events")
    return diff_counts(count(e.where("value > 50"), "event_type"), count(table(spark, sf_dir, "documents"), "lang").unionByName(count(e, "event_type")))


@query("asof_earlier", """
SELECT e.event_id, max(v.event_id) AS source FROM (SELECT event_id FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT event_id FROM events WHERE event_type = 'view') v ON e.event_id >= v.event_id GROUP BY e.event_id""")
def _(spark, sf_dir):
    """For each purchase the last view before it."""
    of = lambda kind: table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    found = nearest_before(of("view").select(F.col("event_id").alias("at")), of("purchase").select(F.col("event_id").alias("i"), F.col("event_id").alias("at")))
    return found.select(F.col("i").alias("event_id"), F.col("j").alias("source"))


@query("hashed_embedding", r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
b AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::UBIGINT % 64 AS b, count(*) AS n FROM w GROUP BY ALL UNION ALL SELECT doc_id, 0, 1 FROM documents WHERE NOT regexp_matches(lower(text), '[a-z0-9]')),
l AS (SELECT doc_id, sqrt(sum(n * n)) AS l FROM b GROUP BY doc_id)
SELECT doc_id, b::BIGINT AS bucket, round((n / l)::FLOAT::DOUBLE, 5) AS weight FROM b JOIN l USING (doc_id)""")
def _(spark, sf_dir):
    """Texts through the token count and the embedder; the buckets that aren't empty."""
    rows = encoded(token_counts(_texts(spark, sf_dir), BucketEmbedder(64)), BucketEmbedder(64))
    each = rows.select(F.col("row").alias("doc_id"), F.posexplode("vector").alias("bucket", "weight")).where("weight > 0")
    return each.select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("weight").cast("double"), 5).alias("weight"))


# ---------------------------------------------------------------- files: lines, embedding, bundles


@query("numbered_lines", r"SELECT row_number() OVER (ORDER BY doc_id) AS line_no, md5(regexp_replace(text, '[\r\n]+', ' ', 'g')) AS digest FROM documents")
def _(spark, sf_dir):
    """Texts as one file of lines in order, and their numbers as read."""
    path = scratch_path(spark, "lines.txt")
    write_lines(table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[\r\n]+", " ").alias("line")), "doc_id", "line", path)
    return numbered_lines(spark, path).select("line_no", F.md5(F.col("line").cast("binary")).alias("digest"))


def _clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n (in order of doc_id), and a line of a clean record for each document, or an empty one for each seventh."""
    docs = table(spark, sf_dir, "documents")
    record = F.struct(
        F.concat(F.lit("d"), "doc_id").alias("ad_id"), F.concat(F.lit("Document "), "doc_id").alias("headline"), F.left("text", F.lit(900)).alias("description"), F.col("lang").alias("category"), F.col("source").alias("advertiser_id"),
        F.lit(1.5).alias("bid_cpm_usd"), F.lit("2026-01-01T00:00:00Z").alias("created_at"),
    )
    return docs.select("doc_id", F.when(F.col("doc_id") % 7 == 3, "").otherwise(F.to_json(record)).alias("line"))


_CLEAN_ROWS = "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row, 'd' || doc_id AS ad_id, 'Document ' || doc_id || '. ' || left(text, 900) AS text, lang FROM documents WHERE doc_id % 7 <> 3"


@query("clean_file", f"SELECT row, ad_id, lang AS category FROM ({_CLEAN_ROWS})")
def _(spark, sf_dir):
    """A clean file with blank lines: rows count records only."""
    path = scratch_path(spark, "clean.jsonl")
    write_lines(_clean_documents(spark, sf_dir), "doc_id", "line", path)
    return load_clean(spark, path).select("row", "ad_id", "category")


@query("embed_stage", f"""
WITH r AS ({_CLEAN_ROWS}), t AS (SELECT {_TOKENS} AS n FROM r)
SELECT (SELECT count(*) FROM r) AS count, (SELECT min_by(ad_id, row) FROM r) AS first_ad_id, (SELECT max_by(ad_id, row) FROM r) AS last_ad_id, trunc(quantile_cont(n, 0.5))::BIGINT AS p50, trunc(quantile_cont(n, 0.99))::BIGINT AS p99, max(n) AS max,
  count(*) FILTER (n > 100) AS truncated, (SELECT count(*) FROM r) AS vectors, true AS unit FROM t""")
def _(spark, sf_dir):
    """The whole stage: its manifest as read back, and what its vectors are like."""
    folder = scratch_path(spark, "embed")
    write_lines(_clean_documents(spark, sf_dir), "doc_id", "line", f"{folder}/clean.jsonl")
    embed(spark, f"{folder}/clean.jsonl", f"{folder}/out", BucketEmbedder(16, 100), allow_truncation=True)
    m = json.loads(read_text(spark, f"{folder}/out/embed_manifest.json"))
    state = integrity(spark.read.parquet(f"{folder}/out/embedded.parquet"), 16).first()
    row = (m["count"], m["first_ad_id"], m["last_ad_id"], *(m["tokens"][k] for k in ("p50", "p99", "max", "truncated")), state["n"], state["wrong_dim"] + state["nonfinite"] + state["off_unit"] == 0)
    return spark.createDataFrame([row], "count long, first_ad_id string, last_ad_id string, p50 long, p99 long, max long, truncated long, vectors long, unit boolean")


@query("vector_file", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, round(list_sum(embedding::DOUBLE[]), 5) AS total, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last FROM embeddings")
def _(spark, sf_dir):
    """Vectors as a file of little-endian floats, and as read from it."""
    path = scratch_path(spark, "vectors.f32")
    write_vectors(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").alias("vector")), path)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return read_vectors(spark, path, 64).select("row", F.round(total, 5).alias("total"), F.col("vector")[0].cast("double").alias("first"), F.col("vector")[63].cast("double").alias("last"))


def _published(spark: SparkSession, sf_dir: str) -> str:
    """The embeddings as a published bundle: its root."""
    folder = scratch_path(spark, "bundle")
    rows = fixed(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.concat(F.lit("ad_"), "vec_id").alias("ad_id"), F.col("embedding").alias("vector"), "label"))
    record = F.struct("ad_id", F.concat(F.lit("Vector "), "row").alias("headline"), F.lit("").alias("description"), F.concat(F.lit("label_"), "label").alias("category"), F.lit("adv").alias("advertiser_id"), F.lit(1.5).alias("bid_cpm_usd"), F.lit("2026-01-01T00:00:00Z").alias("created_at"))
    write_lines(rows.select("row", F.to_json(record).alias("line")), "row", "line", f"{folder}/clean.jsonl")
    rows.select("row", "ad_id", "vector").write.parquet(f"{folder}/emb/embedded.parquet")
    ends = ends_of(rows).first()
    told = dict(created_at="2026-01-01T00:00:00Z", model="given", revision="1", dim=64, max_tokens=256, count=ends["n"], first_ad_id=ends["a"], last_ad_id=ends["z"], source_sha256=file_sha256(spark, f"{folder}/clean.jsonl"), tokens={}, device="cpu")
    write_json(spark, f"{folder}/emb/embed_manifest.json", told)
    publish(spark, f"{folder}/clean.jsonl", f"{folder}/emb", f"{folder}/root")
    return f"{folder}/root"


@query("bundle_rows", "SELECT vec_id AS row, 'ad_' || vec_id AS ad_id, 'label_' || label AS category, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def _(spark, sf_dir):
    """Published, loaded with every check, and as served."""
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return load(spark, _published(spark, sf_dir)).rows.select("row", "ad_id", "category", F.round(total, 5).alias("total"))


@query("bundle_top_k", f"SELECT row, score FROM ({_FIRST}) ORDER BY score DESC, row LIMIT 10")
def _(spark, sf_dir):
    loaded = load(spark, _published(spark, sf_dir))
    return loaded.top_k(loaded.vector(0), 10).withColumn("score", F.round("score", 6))


@query("bundle_manifest", """
SELECT count(*) AS vectors, 64::BIGINT AS dim, count(*) * 64 * 4 AS bytes, count(*) AS ads,
  sha256(string_agg('{"row":' || vec_id || ',"ad_id":"ad_' || vec_id || '","headline":"Vector ' || vec_id || '","description":"","category":"label_' || label || '","advertiser_id":"adv","bid_cpm_usd":1.5,"created_at":"2026-01-01T00:00:00Z"}' || chr(10), '' ORDER BY vec_id)) AS ads_sha256 FROM embeddings""")
def _(spark, sf_dir):
    m = read_manifest(spark, latest(spark, _published(spark, sf_dir)))
    row = (m["vectors"]["count"], m["vectors"]["dim"], m["vectors"]["bytes"], m["ads"]["count"], m["ads"]["sha256"])
    return spark.createDataFrame([row], "vectors long, dim long, bytes long, ads long, ads_sha256 string")


#: Faults of a bundle and the error each must raise.
_FAULTS = {
    "byte order": "ManifestError", "not normalized": "ManifestError", "dim of model": "ManifestError", "counts": "ManifestError", "bytes": "ManifestError", "file name": "ManifestError", "version": "ManifestError", "no model": "ManifestError",
    "truncated": "VectorsError", "nan": "VectorsError", "zero row": "VectorsError", "flipped bit": "ChecksumError", "ads hash": "ChecksumError", "out of order": "AdsError", "twice": "AdsError", "no id": "AdsError", "fewer": "AdsError", "malformed": "AdsError",
}


@query("bundle_faults", f"SELECT * FROM (VALUES {', '.join(map(str, _FAULTS.items()))}) f(fault, error)")
def _(spark, sf_dir):
    """A published bundle, with one fault at a time, as the loader's checks see it."""
    at = latest(spark, _published(spark, sf_dir))
    m = read_manifest(spark, at)
    edits = {
        "byte order": ("vectors", {"byte_order": "big"}), "not normalized": ("model", {"normalized": False}), "dim of model": ("model", {"dim": 9}), "counts": ("ads", {"count": 1}), "bytes": ("vectors", {"bytes": 1}),
        "file name": ("vectors", {"file": "../x"}), "version": (None, {"format_version": 2}), "no model": (None, {"model": None}),
    }
    jobs = {name: functools.partial(check_manifest, m | (new if part is None else {part: m[part] | new})) for name, (part, new) in edits.items()}
    rows = read_vectors(spark, f"{at}/vectors.f32", 64)
    last = rows.agg(F.max("row")).first()[0]
    flip = lambda v, x: F.transform(v, lambda c, i: F.when(i == 5, x(c)).otherwise(c))
    vectors = {
        "truncated": (rows.where(F.col("row") < last), False), "nan": (rows.withColumn("vector", F.when(F.col("row") == 3, flip("vector", lambda c: F.lit(float("nan")).cast("float"))).otherwise(F.col("vector"))), True),
        "zero row": (rows.withColumn("vector", F.when(F.col("row") == 3, F.array_repeat(F.lit(0.0).cast("float"), 64)).otherwise(F.col("vector"))), True),
        "flipped bit": (rows.withColumn("vector", F.when(F.col("row") == 3, flip("vector", lambda c: c * F.lit(1.0000002).cast("float"))).otherwise(F.col("vector"))), False),
    }

    def of_vectors(name: str, changed: DataFrame, signed: bool) -> None:
        path = f"{at}/{name.replace(' ', '-')}.f32"
        write_vectors(changed, path)
        check_vectors(spark, path, m["vectors"] | ({"sha256": file_sha256(spark, path)} if signed else {}))

    lines = numbered_lines(spark, f"{at}/ads.jsonl")
    first = F.col("line_no") == 1
    ads = {
        "ads hash": lines, "out of order": lines.withColumn("line_no", F.when(first, 2).when(F.col("line_no") == 2, 1).otherwise(F.col("line_no"))), "twice": lines.withColumn("line", F.regexp_replace("line", '"ad_1"', '"ad_0"')),
        "no id": lines.withColumn("line", F.regexp_replace("line", '"ad_1"', '""')), "fewer": lines.where(F.col("line_no") <= last), "malformed": lines.withColumn("line", F.when(first, "{").otherwise(F.col("line"))),
    }

    def of_ads(name: str, changed: DataFrame) -> None:
        path = f"{at}/{name.replace(' ', '-')}.jsonl"
        write_lines(changed, "line_no", "line", path)
        check_ads(spark, path, m["ads"] | {"sha256": "0" if name == "ads hash" else file_sha256(spark, path)})

    jobs |= {name: functools.partial(of_vectors, name, *x) for name, x in vectors.items()} | {name: functools.partial(of_ads, name, x) for name, x in ads.items()}

    def error(job: Callable) -> str:
        try:
            job()
        except BundleError as e:
            return type(e).__name__
        return "none"

    return spark.createDataFrame(list(zip(jobs, together(*(functools.partial(error, j) for j in jobs.values())), strict=True)), "fault string, error string")


@query("file_checksums")
def _(spark, sf_dir):
    return table_checksums(spark, sf_dir)


#: The generator's parts per thousand.
_RATES = "E001 3 E002 15 E003 8 E004 5 E005 10 E006 8 E007 6 E008 20 E009 10 E010 15 E011 10 E012 6".split()


@query("generated_defects", f"""
WITH r(code, rate) AS (VALUES {', '.join(f"('{c}', {n})" for c, n in zip(_RATES[::2], _RATES[1::2], strict=True))})
SELECT code, 2000 * rate // 1000 AS expected, 2000 * rate // 1000 AS actual, true AS agree FROM r""")
def _(spark, sf_dir):
    """2,000 generated records through the validation: each seeded defect is found as what it is."""
    lines, chosen = raw_lines(spark, 2_000, 42)
    rejects = validate_lines(lines.select(F.col("i").alias("line_no"), "line")).rejects
    return diff_counts(chosen.where("defect IS NOT NULL").groupBy(F.col("defect").alias("code")).agg(F.count(F.lit(1)).alias("n")), counts_by_code(rejects))
