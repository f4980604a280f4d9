from .._common import table
from ..toxicity import fit, score

NAME = "op9_toxicity"
SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
