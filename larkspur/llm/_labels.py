"""A bounded, seeded sample of labelled documents, without moving the texts of the others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, seed: str, measure: Callable) -> DataFrame:
    """x, y, place: documents outside the held-out fifth with a label of 0 or 1, at most ``rows``, chosen and ordered by
    a seeded hash of id and label. ``measure`` turns Arrow batches of (text, y, place) into (x, y, place), x binary; of
    an id that has several texts one counts, that with the smallest x, whatever their number. The sample of ids is that
    small by construction, hence the broadcast."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out()).dropDuplicates(["doc_id", "y"])
    place = F.md5(F.concat(F.lit(seed + ":"), F.col("doc_id").cast("string"), F.lit(":"), F.col("y").cast("string")).cast("binary"))
    chosen = known.withColumn("place", place).orderBy("place").limit(rows).withColumnRenamed("doc_id", "i")
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("i")).select("text", "y", "place")
    return met.mapInArrow(measure, "x binary, y int, place string").groupBy("place", "y").agg(F.min("x").alias("x")).select("x", "y", "place")
