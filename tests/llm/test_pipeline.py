import pytest

from larkspur.llm import pipeline as corpus_pipeline
from larkspur.llm import mixing, quality, toxicity
from larkspur.llm.queries import pipeline

from .helpers import DOCUMENTS, LABELS, rows_of, with_clashes, write
from .test_op4 import PATH, brute, library  # noqa: F401
from .test_op6 import brute as near_brute
from .test_op7 import filled

SF = "/root/testdata/sf0.001"


def test_stages_agree_with_their_definitions(spark, library):  # noqa: F811
    """Each stage on what the one before kept: classifiers by their scores, copies and tokens by brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "minhash", "mixing", "bpe"]

    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    clean = stage["toxicity"](spark, docs, SF)
    marks = toxicity.score(docs, toxicity.fit(docs, labels)).where("predicted = 0")
    assert clean.columns == docs.columns and ids(clean) == ids(marks)
    fine = stage["quality"](spark, clean, SF)
    marks = quality.score(clean, quality.fit(clean, labels)).where("predicted = 1")
    assert fine.columns == docs.columns and ids(fine) == ids(marks)
    own = [(r["doc_id"], r["text"], r["source"]) for r in fine.collect()]
    single = stage["minhash"](spark, fine, SF)
    kept = [r[0] for r in near_brute([o[:2] for o in own], 5) if r[3]]
    assert single.columns == docs.columns and ids(single) == sorted(kept)
    mixed = stage["mixing"](spark, single, SF)
    assert mixed.columns == docs.columns
    sizes = {}
    left = {i: (len(t.split()), s) for i, t, s in own if i in set(kept)}
    for n, s in left.values():
        sizes[s] = sizes.get(s, 0) + n
    want, words = filled(sizes), dict.fromkeys(sizes, 0)
    for i in ids(mixed):
        words[left[i][1]] += left[i][0]
    for s in sizes:
        assert abs(words[s] - want[s]) <= max(n for n, x in left.values() if x == s)
    last = stage["bpe"](spark, mixed, SF)
    texts = {i: t for i, t, _ in own}
    assert rows_of(last, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == brute(library, [(i, texts[i]) for i in ids(mixed)])
    assert rows_of(pipeline.run(spark, SF)) == rows_of(last)


@pytest.mark.parametrize("clash", [True])  # the plain table is that of the other tests
def test_odd_tables(spark, tmp_path, clash):
    text = "the quick brown fox jumps over the lazy dog near the quiet river bank today"
    rows = [(1, text, "en", "a", 1), (2, text + " again", "en", "a", None), (None, "no id at all but some words", None, None, None), (3, None, "en", "b", 0), (4, "", "en", "b", 0), (5, text, "en", "c", 3), (5, text, "en", "c", 3), (6, "w " * 40_000, "en", "c", 3)]
    table = (DOCUMENTS, rows)
    folder = write(tmp_path, documents=with_clashes(*table) if clash else table, labels=(LABELS, [(1, 1, 0), (None, None, None)]))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_empty_tables(spark, tmp_path):
    folder = write(tmp_path, documents=(DOCUMENTS, []), labels=(LABELS, []))
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_mixing_takes_no_document_more_often_than_allowed(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, "x", "a"), (3, "w " * 5000, "b")], "doc_id long, text string, source string")
    taken = [r["doc_id"] for r in mixing.mixed_documents(docs).collect()]
    assert max(map(taken.count, set(taken))) <= 3
