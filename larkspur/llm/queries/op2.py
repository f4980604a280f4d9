from .._common import table
from ..quality import fit, score

NAME = "op2_quality"
SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
