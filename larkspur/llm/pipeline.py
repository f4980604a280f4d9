"""A corpus pipeline: toxic documents go, poor ones go, near copies go, sources are mixed, texts become tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
``run`` writes each stage's rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import minhash, mixing, quality, toxicity
from ._common import Staged, table, tidy
from .queries.op4 import digests, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, fitted on those given here that have labels, doesn't reject."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on those given here that have labels, doesn't reject."""
    return quality.of_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles agree to 0.8 or more."""
    return minhash.without_near_duplicates(docs, width=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count, and digests of the ids and of the decoded text."""
    return digests(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("minhash", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", to_tokens),
]

#: Trained models and tokenization are beyond SQL.
ORACLE_SQL = None


@tidy
def _written(name: str, stage: Callable, spark: SparkSession, docs: DataFrame, sf_dir: str) -> Staged:
    return Staged(stage(spark, docs, sf_dir), name)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table goes when the next one is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        now = _written(name, stage, spark, docs, sf_dir)
        if last:
            last.drop()
        docs, last = now.df, now
    return docs
