"""Registered queries of the stages' refusals, gates, limits, messages and files, beside the SQL that each must agree with."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import report as reports
from ..operators.bundle import PublishError, latest, load, publish
from ..operators.embed import BucketEmbedder, TruncationError, embed, load_clean
from ..operators.evaluate import PROBES, oracle_diff, probe, read_ground_truth, replay, write_ground_truth
from ..operators.records import judged
from ..operators.report import examples
from ..operators.validate import GateError, gate, validate, validate_lines
from ..schema import TEXT_FIELDS, Limits
from ..sources.generate import assigned, base_records, earlier_source, generate
from ..sources.lines import numbered_lines
from ..storage import exists, file_sha256, fixed, read_text, scratch_path, together, write_json, write_lines, write_text
from .catalog import _CLEAN_ROWS, _JUDGED, _KINDS, _RATES, _TOKENS, _clean_documents, _published, _raw_events, _validated_file, query, table


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _error(job: Callable) -> tuple[str, str]:
    """The class and message of what a job raises, or two empty texts."""
    try:
        job()
    except (RuntimeError, ValueError, OSError) as error:
        return type(error).__name__, str(error)
    return "", ""


# ---------------------------------------------------------------- validation


@query("pass_gate", _JUDGED + """
SELECT f AS fail_under, (SELECT count(*) FILTER (code IS NULL) / count(*) FROM v) < f AS refused, (SELECT count(*) FILTER (code IS NULL) FROM v) AS accepted
FROM (SELECT unnest([0.0, 0.01, 0.02, 0.5])::DOUBLE AS f)""")
def _(spark, sf_dir):
    """The events through the stage under the highest gate, and its report, as written, held against each of the others;
    what is refused is written too."""
    folder, gates = scratch_path(spark, "gate"), (0.0, 0.01, 0.02, 0.5)
    write_lines(_raw_events(spark, sf_dir), "line_no", "line", f"{folder}/raw.jsonl")
    refused = lambda job: _error(job)[0] == GateError.__name__
    last = refused(lambda: validate(spark, f"{folder}/raw.jsonl", f"{folder}/out", limits=Limits(categories=_KINDS), fail_under=gates[-1], ordered_files=False))
    report = json.loads(read_text(spark, f"{folder}/out/validation_report.json"))
    told = [refused(functools.partial(gate, report, least)) for least in gates[:-1]] + [last]
    accepted = spark.read.parquet(f"{folder}/out/clean.parquet").count()
    return spark.createDataFrame([(least, t, accepted) for least, t in zip(gates, told, strict=True)], "fail_under double, refused boolean, accepted long")


@query("validation_summary", _JUDGED + """
, t AS (SELECT count(*) AS read, count(*) FILTER (code IS NULL) AS good, count(code) AS bad FROM v), c AS (SELECT code, count(*) AS n, min(event_id) AS first FROM v WHERE code IS NOT NULL GROUP BY code)
SELECT 0::BIGINT AS at, format('read {:,}  accepted {:,}  rejected {:,}  pass rate {:.2f}%', read, good, bad, 100.0 * round(good / read, 6)) AS line FROM t
UNION ALL SELECT row_number() OVER (ORDER BY n DESC, first), format('  {}  {}  {:.2f}%', code, lpad(format('{:,}', n), 9, ' '), 100.0 * n / read) FROM c, t
UNION ALL SELECT (SELECT count(*) FROM c) + k, format('  {}  {}', w, lpad(format('{:,}', good), 9, ' ')) FROM (VALUES (1, 'W006'), (2, 'W001')) x(k, w), t""")
def _(spark, sf_dir):
    """The lines that the stage tells: totals, codes and warnings by falling count, ties by first occurrence."""
    _, told = _validated_file(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(reports.summary(told).split("\n"))), "at long, line string")


_WRONG = {"[1]": "list", '{"a": 1}': "dict", "7": "int", "1.5": "float", "true": "bool"}
_ROOTS = {"[1]": "list", '"x"': "str", "null": "NoneType", "3": "int"}


@query("wrong_types", f"""
SELECT doc_id AS line_no, 'E003' AS code, CASE WHEN doc_id % 10 < 6 THEN {[*TEXT_FIELDS]}[doc_id % 10 + 1] || ' is ' || {[*_WRONG.values()]}[doc_id // 10 % 5 + 1] || ', not text'
  ELSE 'top level is ' || {[*_ROOTS.values()]}[doc_id % 10 - 5] || ', not an object' END AS detail FROM documents""")
def _(spark, sf_dir):
    """A record for each document in which one field is no text, or which is no object."""
    of = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    base = {"ad_id": '"a"', "headline": '"A headline that will do"', "description": '"d"', "category": '"travel"', "advertiser_id": '"v"', "created_at": '"2026-01-01"'}
    kind, wrong = F.col("doc_id") % 10, of(_WRONG, F.floor(F.col("doc_id") / 10) % 5)
    fields = [F.concat(F.lit(f'"{name}": '), F.when(kind == TEXT_FIELDS.index(name), wrong).otherwise(F.lit(value))) for name, value in base.items()]
    line = F.when(kind < 6, F.concat(F.lit('{"bid_cpm_usd": 1, '), F.concat_ws(", ", *fields), F.lit("}"))).otherwise(of(_ROOTS, kind - 6))
    rows = judged(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_no"), line.alias("line")))
    return rows.select("line_no", "verdict.code", "verdict.detail")


@query("reject_excerpts", "SELECT 'E001' AS code, row_number() OVER (ORDER BY doc_id)::INT AS rank, doc_id AS line_no, 'not valid JSON' AS detail, left(text, 200) AS excerpt FROM documents WHERE trim(text) <> '' QUALIFY rank <= 5")
def _(spark, sf_dir):
    """Documents as raw lines: the report's examples."""
    return examples(validate_lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_no"), F.col("text").alias("line"))).rejects)


@query("limited_lines", f"""
SELECT 'lines' AS kind, n AS "at", id FROM (SELECT row_number() OVER (ORDER BY doc_id) AS n, CASE WHEN doc_id % 7 <> 3 THEN 'd' || doc_id END AS id FROM documents) WHERE n <= 100
UNION ALL SELECT 'records', row, ad_id FROM ({_CLEAN_ROWS}) WHERE row < 100""")
def _(spark, sf_dir):
    """A limit counts lines of raw files, blank ones too, and records of clean files."""
    path = scratch_path(spark, "limited.jsonl")
    write_lines(_clean_documents(spark, sf_dir), "doc_id", "line", path)
    lines = numbered_lines(spark, path, 100).select(F.lit("lines").alias("kind"), F.col("line_no").alias("at"), F.get_json_object("line", "$.ad_id").alias("id"))
    return lines.unionByName(load_clean(spark, path, 100).select(F.lit("records").alias("kind"), F.col("row").alias("at"), F.col("ad_id").alias("id")))


# ---------------------------------------------------------------- generated records

_GENERATED = f"(VALUES {', '.join(f'({_quoted(c)}, {n})' for c, n in zip(_RATES[::2], _RATES[1::2], strict=True))}) r(code, n)"


@query("generated_file", f"""
SELECT code, n::BIGINT AS expected, n::BIGINT AS actual, true AS agree FROM (SELECT * FROM {_GENERATED} UNION ALL SELECT 'rejected', sum(n) FROM {_GENERATED} UNION ALL SELECT 'accepted', 1000 - sum(n) FROM {_GENERATED})""")
def _(spark, sf_dir):
    """1,000 generated records as a file, validated: the generator's counts and the report's, each read from its file."""
    folder = scratch_path(spark, "generated")
    generate(spark, 1_000, 7, f"{folder}/ads_raw.jsonl")
    validate(spark, f"{folder}/ads_raw.jsonl", f"{folder}/out", ordered_files=False)
    return oracle_diff(spark, *(json.loads(read_text(spark, f"{folder}/{name}.json")) for name in ("expected_defects", "out/validation_report")))


@query("generated_shape", "SELECT 2000::BIGINT AS n, 2000::BIGINT AS ids, 2000::BIGINT AS headlines, 12::BIGINT AS categories, 0::BIGINT AS far_bids, 0::BIGINT AS far_times, 300::BIGINT AS noised, 50::BIGINT AS repeats, 0::BIGINT AS bad_sources")
def _(spark, sf_dir):
    """2,000 base records, and what is chosen of them: each repeat has a clean record before it as its source."""
    rows = fixed(base_records(spark, 2_000, 42, "2026-01-01T00:00:00Z"))
    chosen = fixed(assigned(rows, 2_000, 42))
    found = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("ad_id").alias("ids"), F.count_distinct("headline").alias("headlines"), F.count_distinct("category").alias("categories"),
        F.count_if((F.col("bid_cpm_usd") <= 0) | (F.col("bid_cpm_usd") > 45)).alias("far_bids"), F.count_if(~F.col("created_at").between("2025-07-05T00:00:00Z", "2026-01-01T00:00:00Z")).alias("far_times"),
    )
    clean = chosen.where("defect IS NULL AND NOT noised").select(F.col("i").alias("j"), F.lit(True).alias("clean"))
    sources = earlier_source(rows, chosen, 42).join(clean, "j", "left").agg(F.count(F.lit(1)).alias("repeats"), F.count_if(F.col("clean").isNull() | (F.col("j") >= F.col("i"))).alias("bad_sources"))
    return found.join(chosen.agg(F.count_if("noised").alias("noised"))).join(sources)  # one row each


# ---------------------------------------------------------------- embedding, bundles, ground truth


@query("truncation_gate", f"""
WITH l AS (SELECT *, row_number() OVER (ORDER BY row) AS k, count(*) OVER () AS total FROM (SELECT row, ad_id, {_TOKENS} AS n FROM ({_CLEAN_ROWS})) WHERE n > 100)
SELECT 'TruncationError' AS error, any_value(total) || ' texts exceed 100 tokens: ' || string_agg(ad_id || ' (' || n || ')', ', ' ORDER BY row) || CASE WHEN any_value(total) > 10 THEN ' and ' || any_value(total) - 10 || ' more' ELSE '' END AS message, false AS encoded
FROM l WHERE k <= 10""")
def _(spark, sf_dir):
    """Texts of more tokens than the model reads are named, and none is encoded."""
    folder = scratch_path(spark, "gated")
    write_lines(_clean_documents(spark, sf_dir), "doc_id", "line", f"{folder}/clean.jsonl")
    told = ("", "")
    try:
        embed(spark, f"{folder}/clean.jsonl", f"{folder}/out", BucketEmbedder(16, 100))
    except TruncationError as error:
        told = type(error).__name__, str(error)
    return spark.createDataFrame([(*told, exists(spark, f"{folder}/out/embedded.parquet"))], "error string, message string, encoded boolean")


#: Why each is refused; n stands for the number of records.
_REFUSED = {
    "changed file": "the clean file has changed since it was embedded", "count": "{n} records, {n} vectors, 1 in the manifest", "dimension": "{n} vectors of another dimension", "first id": "first or last id differs", "last id": "first or last id differs",
    "swapped": "ids of records and vectors differ by row", "blank id": "blank ids", "repeated id": "repeated ids", "not finite": "1 vectors aren't finite", "not unit": "1 vectors aren't of unit length", "missing": "",
}


@query("publish_refusals", f"""
SELECT fault, CASE fault WHEN 'missing' THEN 'FileNotFoundError' ELSE 'PublishError' END AS error, replace(message, '{{n}}', (SELECT count(*) FROM embeddings)::VARCHAR) AS message, true AS kept
FROM (VALUES {', '.join(f'({_quoted(k)}, {_quoted(v)})' for k, v in _REFUSED.items())}) f(fault, message)""")
def _(spark, sf_dir):
    """One fault at a time in what is to be published; the version that was current stays so."""
    root = _published(spark, sf_dir)
    folder, before = root.removesuffix("/root"), latest(spark, root)
    told = json.loads(read_text(spark, f"{folder}/emb/embed_manifest.json"))
    vectors, lines = spark.read.parquet(f"{folder}/emb/embedded.parquet"), numbered_lines(spark, f"{folder}/clean.jsonl")
    at = lambda row, new, column: F.when(F.col("row") == row, new).otherwise(F.col(column)).alias(column)
    named = lambda new: (vectors.select("row", at(1, F.lit(new), "ad_id"), "vector"), lines.select("line_no", F.regexp_replace("line", '"ad_1"', f'"{new}"').alias("line")))
    scaled = lambda x: vectors.select("row", "ad_id", at(3, F.transform("vector", lambda c: (c * F.lit(x)).cast("float")), "vector"))
    edits = {"changed file": {"source_sha256": "0"}, "count": {"count": 1}, "dimension": {"dim": 63}, "first id": {"first_ad_id": "x"}, "last id": {"last_ad_id": "x"}}
    tables = {
        "swapped": (vectors.withColumn("ad_id", F.when(F.col("row") == 1, "ad_2").when(F.col("row") == 2, "ad_1").otherwise(F.col("ad_id"))), None),
        "blank id": named(" "), "repeated id": named("ad_2"), "not finite": (scaled(float("nan")), None), "not unit": (scaled(1.5), None),
    }

    def attempt(fault: str) -> tuple:
        own, clean, manifest = f"{folder}/{fault.replace(' ', '-')}", f"{folder}/clean.jsonl", told | edits.get(fault, {})
        rows, changed = tables.get(fault, (vectors, None))
        if changed is not None:
            clean = f"{own}/clean.jsonl"
            write_lines(changed, "line_no", "line", clean)
            manifest = manifest | {"source_sha256": file_sha256(spark, clean)}
        if fault != "missing":
            rows.write.parquet(f"{own}/embedded.parquet")
            write_json(spark, f"{own}/embed_manifest.json", manifest)
        error, message = _error(lambda: publish(spark, clean, own, root))
        return fault, error, message.split(" (")[0] if error == PublishError.__name__ else "", latest(spark, root) == before

    return spark.createDataFrame(together(*(functools.partial(attempt, f) for f in _REFUSED)), "fault string, error string, message string, kept boolean")


@query("bundle_lookups", "SELECT asked, vec_id AS row, round(embedding[1]::DOUBLE, 6) AS first, (SELECT count(*) FROM embeddings) AS n FROM (VALUES ('ad_0'), ('ad_7'), ('ad_41'), ('none')) a(asked) LEFT JOIN embeddings ON 'ad_' || vec_id = asked")
def _(spark, sf_dir):
    """Rows by id and vectors by row, as a loaded bundle gives them."""
    loaded = load(spark, _published(spark, sf_dir))
    found = [(a, loaded.row_of(a)) for a in ("ad_0", "ad_7", "ad_41", "none")]
    return spark.createDataFrame([(a, r, None if r is None else round(loaded.vector(r)[0], 6), len(loaded)) for a, r in found], "asked string, row long, first double, n long")


def _truth(spark: SparkSession, sf_dir: str) -> tuple:
    """A bundle, and a file of what the probes find in it."""
    loaded, embedder = load(spark, _published(spark, sf_dir)), BucketEmbedder(64)
    hits, _ = probe(loaded, embedder, PROBES, 5)
    path = scratch_path(spark, "truth.json")
    write_ground_truth(loaded, embedder, hits, PROBES, 5, path)
    return loaded, path


@query("ground_truth_file", f"""
WITH w AS (SELECT query_id, unnest(regexp_extract_all(lower(q), '[a-z0-9]+')) AS w FROM (VALUES {', '.join(f'({i}, {_quoted(q)})' for i, (q, _) in enumerate(PROBES))}) p(query_id, q)),
b AS (SELECT query_id, ('0x' || substr(md5(w), 1, 8))::UBIGINT::BIGINT % 64 AS b, count(*) AS n FROM w GROUP BY ALL), x AS (SELECT query_id, b, (n / sqrt(sum(n * n) OVER (PARTITION BY query_id)))::FLOAT::DOUBLE AS x FROM b),
s AS (SELECT query_id, vec_id, sum(x * embedding[b + 1]::DOUBLE) AS score FROM x CROSS JOIN embeddings GROUP BY ALL)
SELECT query_id::BIGINT AS query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS row, 'ad_' || vec_id AS ad_id, round(score, 5) AS score, 0::BIGINT AS faults FROM s QUALIFY rank <= 5""")
def _(spark, sf_dir):
    """What the probes find, written for other readers and read back; the replay finds no fault in it."""
    loaded, path = _truth(spark, sf_dir)
    faults = replay(loaded, path).count()
    return read_ground_truth(spark, path)[3].select("query_id", "rank", "row", "ad_id", F.round("score", 5).alias("score"), F.lit(faults).cast("long").alias("faults"))


_UNREAD = {"no pointer": "ManifestError", "empty pointer": "ManifestError", "pointer out": "ManifestError", "no version": "ManifestError", "stale truth": "StaleError", "empty truth": "StaleError", "short query": "ValueError", "sound": ""}


@query("reader_refusals", f"SELECT * FROM (VALUES {', '.join(map(str, _UNREAD.items()))}) f(fault, error)")
def _(spark, sf_dir):
    """What a reader refuses: pointers that name no version, ground truth of another version, queries of another dimension."""
    loaded, path = _truth(spark, sf_dir)
    folder, truth = path.removesuffix("/truth.json"), json.loads(read_text(spark, path))
    for name, content in (("empty", "\n"), ("out", "../root\n"), ("gone", "gone\n")):
        write_text(spark, f"{folder}/{name}/LATEST", content)
    for name, change in (("stale", {"bundle_version": "other"}), ("void", {"queries": []})):
        write_json(spark, f"{folder}/{name}.json", truth | change)
    jobs = {
        "no pointer": lambda: load(spark, folder), "empty pointer": lambda: load(spark, f"{folder}/empty"), "pointer out": lambda: load(spark, f"{folder}/out"), "no version": lambda: load(spark, f"{folder}/gone"),
        "stale truth": lambda: replay(loaded, f"{folder}/stale.json"), "empty truth": lambda: replay(loaded, f"{folder}/void.json"), "short query": lambda: loaded.top_k([1.0], 3), "sound": lambda: replay(loaded, path),
    }
    return spark.createDataFrame([(name, _error(job)[0]) for name, job in jobs.items()], "fault string, error string")
