"""The validation stage: raw lines to clean records, rejects and a report."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CLEAN_COLUMNS, Limits
from ..sources.lines import input_files, numbered_lines
from ..storage import clean_up, file_sha256, fixed, is_file, make_dirs, scratch_tables, together, write_json, write_lines
from . import report as reports
from .dedup import duplicates
from .records import judged


class GateError(RuntimeError):
    """The share of accepted records is below what was asked for. Outputs are written."""


@dataclass
class Validated:
    accepted: DataFrame  # line_no, warnings, the clean columns, and print (of the content)
    rejects: DataFrame  # line_no, code, detail, line


def validate_lines(lines: DataFrame, limits: Limits = Limits(), taken: DataFrame | None = None) -> Validated:
    """lines: line_no, line. taken: id, print of records that were accepted before these."""
    rows = fixed(judged(lines, limits).withColumn("print", F.when(F.col("verdict").isNull(), F.sha2("r.folded", 256))).withColumn("r", F.col("r").dropFields("folded")))
    passed = rows.where("verdict IS NULL").select("line_no", "line", "r.*", "print")
    twice = fixed(duplicates(passed.select("line_no", F.col("ad_id").alias("id"), "print"), taken=taken))
    named = F.when(F.col("code") == "E010", F.concat(F.lit("id seen before: "), "ad_id")).otherwise(F.concat(F.lit("same content as a record before, "), F.left("print", F.lit(12))))
    repeated = passed.join(twice, "line_no").select("line_no", "code", named.alias("detail"), "line")
    rejects = rows.where("verdict IS NOT NULL").select("line_no", "verdict.code", "verdict.detail", "line").unionByName(repeated)
    good = passed.join(twice, "line_no", "left_anti").withColumnsRenamed({"bid": "bid_cpm_usd", "time": "created_at"})
    return Validated(good.select("line_no", "warnings", *CLEAN_COLUMNS, "print"), rejects)


def gate(report: dict, fail_under: float) -> None:
    """GateError if the share of accepted records that a report tells is below ``fail_under``. A run's counts don't depend
    on the gate, so one report can be held against any number of them."""
    totals = report["totals"]
    if reports.pass_rate(totals["read"], totals["accepted"]) < fail_under:
        raise GateError(f"pass rate {totals['pass_rate']:.4f} is below {fail_under}")


def reject_lines(rejects: DataFrame) -> DataFrame:
    """line_no, told: each reject as a line of JSON, with the record as it came (null if it isn't JSON)."""
    payload = F.when(F.col("code") == "E001", F.lit("null")).otherwise(F.trim("line"))
    head = F.regexp_replace(F.to_json(F.struct(F.col("line_no").alias("line"), "code", "detail")), r"\}$", "")
    return rejects.select("line_no", F.concat(head, F.lit(',"record":'), payload, F.lit("}")).alias("told"))


def clean_lines(accepted: DataFrame) -> DataFrame:
    """line_no, told: each accepted record as a line of JSON."""
    return accepted.select("line_no", F.to_json(F.struct(*CLEAN_COLUMNS)).alias("told"))


def validate(spark: SparkSession, source: str, out_dir: str, *, limits: Limits = Limits(), limit: int | None = None, fail_under: float | None = None, ordered_files: bool = True) -> dict:
    """Writes clean.parquet and rejected.parquet in parallel, validation_report.json, and, unless ``ordered_files`` is
    false, ads_clean.jsonl and ads_rejected.jsonl, single files in line order. ``source``: a file, or a folder or pattern
    of several, whose lines are numbered in the order of their names.

    Raises FileNotFoundError without input, GateError below ``fail_under`` after everything is written."""
    if not is_file(spark, source) and not input_files(spark, source):
        raise FileNotFoundError(source)
    began, out, before = time.monotonic(), out_dir.rstrip("/"), scratch_tables()
    make_dirs(spark, out)
    done = validate_lines(numbered_lines(spark, source, limit), limits)
    together(
        lambda: done.accepted.drop("print").write.mode("overwrite").parquet(f"{out}/clean.parquet"),
        lambda: done.rejects.write.mode("overwrite").parquet(f"{out}/rejected.parquet"),
    )
    accepted = spark.read.schema(done.accepted.drop("print").schema).parquet(f"{out}/clean.parquet")
    rejects = spark.read.schema(done.rejects.schema).parquet(f"{out}/rejected.parquet")
    clean_up(before)
    files = input_files(spark, source)
    jobs = [lambda: reports.build(accepted, rejects, limits), lambda: file_sha256(spark, files[0]) if len(files) == 1 else None]
    if ordered_files:
        jobs.append(lambda: write_lines(clean_lines(accepted), "line_no", "told", f"{out}/ads_clean.jsonl"))
        jobs.append(lambda: write_lines(reject_lines(rejects), "line_no", "told", f"{out}/ads_rejected.jsonl"))
    counts, digest, *_ = together(*jobs)
    facts = dict(input_path=source, input_sha256=digest, config=limits.config() | {"limit": limit}, duration_seconds=round(time.monotonic() - began, 3))
    report = facts | counts
    write_json(spark, f"{out}/validation_report.json", report)
    if fail_under is not None:
        gate(report, fail_under)
    return report
