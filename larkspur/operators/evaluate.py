"""Probe queries, ground truth for other readers of a bundle, and the comparison of counts with a generator's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import write_json
from .bundle import Bundle
from .embed import Embedder
from .vectors import diff_counts, disagreements, dot, precision_at_k, search

#: Query and expected category.
PROBES = [
    ("sturdy boots for long hikes", "footwear"), ("headphones for a noisy office", "electronics"), ("language course for beginners", "education"), ("cheap flights in autumn", "travel"),
    ("food for an old cat", "pet_supplies"), ("cast iron pan", "home_kitchen"), ("weights for the living room", "fitness"), ("savings account without fees", "finance"),
]


def probe(bundle: Bundle, embedder: Embedder, queries: list[tuple[str, str | None]], k: int) -> tuple[DataFrame, float | None]:
    """Hits with their attributes, and precision over the queries that name a category."""
    spark = bundle.rows.sparkSession
    vectors = embedder.encode([q for q, _ in queries], 256)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "query_id long, vector array<float>")
    hits = search(bundle.rows, asked, min(k, len(bundle))).join(bundle.rows.drop("vector"), "row")
    named = [(i, c) for i, (_, c) in enumerate(queries) if c]
    if not named:
        return hits, None
    expected = spark.createDataFrame(named, "query_id long, category string")
    return hits, precision_at_k(hits.select("query_id", "rank", "row"), expected, bundle.rows, min(k, len(bundle))).first()["precision"]


def write_ground_truth(bundle: Bundle, embedder: Embedder, hits: DataFrame, queries: list[tuple[str, str | None]], k: int, path: str) -> None:
    """The hits with the vectors that asked and the version that answered, so that another reader can replay them."""
    found: dict[int, list] = {}
    for r in hits.orderBy("query_id", "rank").select("query_id", "ad_id", "row", F.col("score").cast("double")).collect():
        found.setdefault(r[0], []).append({"row": r[2], "ad_id": r[1], "score": r[3]})
    vectors = embedder.encode([q for q, _ in queries], 256)
    # Fixed names: the fields of the file.
    told = [{"query": q, "expected_category": c, "vector": [float(x) for x in vectors[i]], "top_k": found.get(i, [])} for i, (q, c) in enumerate(queries)]
    stamp = {"bundle": bundle.folder, "bundle_version": bundle.version, "vectors_sha256": bundle.manifest["vectors"]["sha256"]}
    write_json(bundle.rows.sparkSession, path, stamp | {"model": bundle.manifest["model"], "k": k, "queries": told})


class StaleError(RuntimeError):
    """The ground truth is of another version than the bundle, or empty."""


_TRUTH = "bundle_version string, vectors_sha256 string, k int, queries array<struct<query: string, vector: array<double>, top_k: array<struct<ad_id: string, row: long, score: double>>>>"


def read_ground_truth(spark: SparkSession, path: str) -> tuple[str, str, DataFrame, DataFrame]:
    """version, vectors_sha256, asked (query_id, vector) and told (query_id, rank, row, ad_id, score)."""
    whole = spark.read.schema(_TRUTH).json(path, multiLine=True, mode="FAILFAST")
    head = whole.first()
    each = whole.select(F.posexplode("queries").alias("query_id", "q")).withColumn("query_id", F.col("query_id").cast("long"))
    told = each.select("query_id", F.posexplode("q.top_k").alias("at", "t")).select("query_id", (F.col("at") + 1).alias("rank"), "t.row", "t.ad_id", "t.score")
    return head["bundle_version"], head["vectors_sha256"], each.select("query_id", "q.vector"), told


def parity(rows: DataFrame, asked: DataFrame, told: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """query_id, at, fault: where what another reader found isn't what these rows (row, ad_id, vector) give.

    Faults: count (of a query's hits; at 0), score (at a position), ad_id (a row's), missing (a row that scores above
    the last hit here by more than the tolerance, and isn't found)."""
    sizes = told.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    k = sizes.agg(F.max("n")).first()[0] or 0
    ours = search(rows.select("row", "vector"), asked, k).join(sizes, "query_id").where("rank <= n").drop("n")
    counts = ours.groupBy("query_id").agg(F.count(F.lit(1)).alias("m"))
    fault = lambda df, at, name: df.select("query_id", F.col(at).cast("long").alias("at") if at else F.lit(0).cast("long").alias("at"), F.lit(name).alias("fault"))
    count = sizes.join(counts, "query_id", "left").where(F.coalesce("m", F.lit(0)) != F.col("n"))
    score = told.join(ours.select("query_id", "rank", F.col("score").alias("s")), ["query_id", "rank"]).where(F.abs(F.col("s") - F.col("score")) > tolerance)
    ids = told.join(rows.select("row", F.col("ad_id").alias("own")), "row", "left").where(~F.col("ad_id").eqNullSafe(F.col("own")))
    # A row that is told but not found here is scored here.
    lost = told.join(ours.select("query_id", "row"), ["query_id", "row"], "left_anti").select("query_id", "row", "rank").join(asked.withColumnRenamed("vector", "q"), "query_id").join(rows.select("row", "vector"), "row")
    lost = lost.select("query_id", "rank", "row", dot(F.col("q"), F.col("vector")).alias("score"))
    missing = disagreements(lost.drop("rank"), ours, tolerance).join(lost.select("query_id", "row", "rank"), ["query_id", "row"])
    return fault(count, None, "count").unionByName(fault(score, "rank", "score")).unionByName(fault(ids, "rank", "ad_id")).unionByName(fault(missing, "rank", "missing"))


def replay(bundle: Bundle, path: str, tolerance: float = 1e-5) -> DataFrame:
    """The faults of a ground truth file against the bundle. StaleError if it is of another version, or empty."""
    version, digest, asked, told = read_ground_truth(bundle.rows.sparkSession, path)
    if version != bundle.version or digest != bundle.manifest["vectors"]["sha256"]:
        raise StaleError(f"the ground truth is of version {version}, the bundle is {bundle.version}")
    if asked.isEmpty():
        raise StaleError("the ground truth holds no queries")
    return parity(bundle.rows, asked, told, tolerance)


def oracle_diff(spark: SparkSession, expected: dict, report: dict) -> DataFrame:
    """code, expected, actual, agree: every code of either side, and the totals."""

    def rows(by_code: dict, accepted: int, rejected: int) -> DataFrame:
        return spark.createDataFrame([*by_code.items(), ("accepted", accepted), ("rejected", rejected)], "code string, n long")

    t = report["totals"]
    return diff_counts(rows(expected["expected_rejections_by_code"], expected["expected_accepted_total"], expected["expected_rejected_total"]), rows(report["rejections_by_code"], t["accepted"], t["rejected"]))
