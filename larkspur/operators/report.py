"""Counts of a validation run as a document, and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import Limits
from ..storage import together


def counts_by_code(rejects: DataFrame) -> DataFrame:
    """code, n: by falling count, ties by first line."""
    return rejects.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first")).orderBy(F.desc("n"), "first").select("code", "n")


def warning_counts(accepted: DataFrame) -> DataFrame:
    """warning, n over accepted records, once for each occurrence."""
    return accepted.select("line_no", F.posexplode("warnings").alias("at", "warning")).groupBy("warning").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line_no", "at")).alias("first")).orderBy(F.desc("n"), "first").select("warning", "n")


def examples(rejects: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The first rejects of each code in line order; the ranking is limited before it is shuffled."""
    rank = F.row_number().over(W.partitionBy("code").orderBy("line_no"))
    return rejects.withColumn("rank", rank).where(F.col("rank") <= limits.examples).select("code", "rank", "line_no", "detail", F.substring("line", 1, limits.excerpt).alias("excerpt"))


def pass_rate(read: int, accepted: int) -> float:
    """1 for no input."""
    return accepted / read if read else 1.0


def build(accepted: DataFrame, rejects: DataFrame, limits: Limits, **facts) -> dict:
    """The report; only a few counts and at most ``limits.examples`` rows a code come to the driver."""
    codes, warned, first, good = together(
        lambda: counts_by_code(rejects).collect(), lambda: warning_counts(accepted).collect(), lambda: examples(rejects, limits).collect(), accepted.count,
    )
    by_code = {r["code"]: r["n"] for r in codes}
    shown: dict[str, list] = {code: [] for code in by_code}
    for r in sorted(first, key=lambda r: (r["code"], r["rank"])):
        shown[r["code"]].append({"line": r["line_no"], "detail": r["detail"], "excerpt": r["excerpt"]})
    bad = sum(by_code.values())
    totals = {"read": good + bad, "accepted": good, "rejected": bad, "pass_rate": round(pass_rate(good + bad, good), 6)}
    return facts | {"totals": totals, "rejections_by_code": by_code, "warnings_by_code": {r["warning"]: r["n"] for r in warned}, "examples": shown}


def summary(report: dict) -> str:
    t = report["totals"]
    lines = [f"read {t['read']:,}  accepted {t['accepted']:,}  rejected {t['rejected']:,}  pass rate {t['pass_rate']:.2%}"]
    lines += [f"  {code}  {n:>9,}  {n / t['read']:.2%}" for code, n in report["rejections_by_code"].items()]
    lines += [f"  {code}  {n:>9,}" for code, n in report["warnings_by_code"].items()]
    return "\n".join(lines)
