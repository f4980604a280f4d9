from pyspark.sql import functions as F

from .._common import table
from ..bpe import encode

NAME = "op4_bpe"
SQL = None


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(docs, path):
    coded = encode(docs, path, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def run(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), vocabulary())
