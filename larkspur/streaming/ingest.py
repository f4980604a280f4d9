"""Raw files as a stream: each micro-batch is judged like the next part of one file.

Ids and contents of records that earlier batches accepted are taken: who repeats one of them is out before the batch's
own records meet, since what is rejected reserves nothing. So any split of a file into batches accepts the same lines. Of each
batch the taken keys are written to a table of their own, two columns, from which later batches read; a batch's keys are
few beside it and meet it by a semi-join.

Accepted and rejected records and keys are written as Parquet by batch number, so a batch that is run again replaces its
own output and sees only the batches before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.validate import Validated, validate_lines
from ..schema import Limits
from ..storage import clean_up, exists, scratch_tables

_KEYS = "id string, print string, batch int"


def judge_batch(lines: DataFrame, batch: int, out: str, limits: Limits = Limits()) -> Validated:
    """Judges one batch of line_no, line after those with smaller numbers, and writes its parts of accepted, rejected and
    keys under ``out``."""
    spark, before = lines.sparkSession, scratch_tables()
    done = validate_lines(lines, limits, _taken(spark, out, batch))
    done.accepted.write.mode("overwrite").parquet(f"{out}/accepted/batch={batch}")
    done.rejects.write.mode("overwrite").parquet(f"{out}/rejected/batch={batch}")
    accepted = spark.read.schema(done.accepted.schema).parquet(f"{out}/accepted/batch={batch}")
    accepted.select(F.col("ad_id").alias("id"), "print").write.mode("overwrite").parquet(f"{out}/keys/batch={batch}")
    clean_up(before)
    return Validated(accepted, spark.read.schema(done.rejects.schema).parquet(f"{out}/rejected/batch={batch}"))


def start(spark: SparkSession, source: str, out: str, checkpoint: str, limits: Limits = Limits(), available_now: bool = True, files_at_once: int = 100) -> StreamingQuery:
    """Reads text files as they arrive under ``source``; line order is the order within a micro-batch's files."""

    def judge(lines: DataFrame, batch: int) -> None:
        judge_batch(lines.select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line")), batch, out, limits)

    stream = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(source).writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream.trigger(processingTime="10 seconds")).start()


def _taken(spark: SparkSession, out: str, batch: int) -> DataFrame | None:
    """Keys of all batches before this one."""
    if not exists(spark, f"{out}/keys"):
        return None
    return spark.read.schema(_KEYS).parquet(f"{out}/keys").where(F.col("batch") < batch).select("id", "print")
