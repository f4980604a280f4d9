import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import toxicity
from larkspur.llm._common import held_out
from larkspur.llm._labels import labelled_sample
from larkspur.llm.queries import op9
from larkspur.llm.toxicity import Ftrl, features, fit, train, without_toxic

from .helpers import DOCUMENTS, LABELS, documents, rows_of, with_clashes, write
from .test_op2 import BIG, held


@pytest.fixture(scope="module")
def scored(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    return [(r, labels.get(r["doc_id"])) for r in op9.run(spark, BIG).collect()]


def test_every_document_is_scored(spark, scored):
    assert len(scored) == spark.read.parquet(f"{BIG}/documents.parquet").count()
    for r, _ in scored:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == held(r["doc_id"])


def test_held_out_accuracy(scored):
    pairs = [(r["score"], r["predicted"], y) for r, y in scored if r["held_out"] and y is not None]
    toxic, clean = [s for s, _, y in pairs if y], [s for s, _, y in pairs if not y]
    auc = np.mean([[(t > c) + 0.5 * (t == c) for c in clean] for t in toxic])
    assert len(toxic) > 4 and auc > 0.95 and np.mean([p == y for _, p, y in pairs]) > 0.95


def test_the_same_weights_whatever_the_partitions_and_the_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = fit(docs, labels), fit(docs.repartition(7), turned.repartition(3))
    assert np.array_equal(a.keys, b.keys) and np.array_equal(a.values, b.values) and a.bias == b.bias
    assert 0 < len(a.keys) < 200_000


def naive(rows, labels, how, epochs):
    """The same, coordinate by coordinate."""
    count = {}
    for r in rows:
        for k in r.tolist():
            count[k] = count.get(k, 0) + 1
    z, n = {k: 0.0 for k, c in count.items() if c >= toxicity.MIN}, {}
    share = (sum(labels) + 0.5) / (len(labels) + 1)
    bias, bn = math.log(share / (1 - share)), 0.0

    def weight(k):
        if abs(z[k]) <= how.l1:
            return 0.0
        return -(z[k] - math.copysign(how.l1, z[k])) / ((how.beta + math.sqrt(n.get(k, 0.0))) / how.alpha + how.l2)

    for _ in range(epochs):
        for r, y in zip(rows, labels, strict=True):
            w = {k: weight(k) for k in r.tolist() if k in z}
            g = 1 / (1 + math.exp(-(bias + sum(w.values())))) - y
            for k, v in w.items():
                sigma = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / how.alpha
                z[k] += g - sigma * v
                n[k] = n.get(k, 0.0) + g * g
            bn += g * g
            bias -= 0.02 * g / (1 + math.sqrt(bn))
    return {k: weight(k) for k in z if weight(k)}, bias


def test_training_agrees_with_a_plain_loop():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 60, 12).astype(np.uint32)) for _ in range(200)]
    labels = [int(3 in r or 7 in r) for r in rows]
    how = Ftrl(l1=0.5)
    keys, values, bias = train(rows, labels, how, 3)
    want, want_bias = naive(rows, labels, how, 3)
    assert dict(zip(keys.tolist(), values.tolist(), strict=True)) == pytest.approx(want) and bias == pytest.approx(want_bias)
    assert train([], [], how, 1)[2] == 0.0


def test_features_of_odd_texts(monkeypatch):
    known = toxicity._WordHash()
    assert not len(features(None, known)) and not len(features("", known)) and not len(features(" ... !", known))
    a, b = features("You, there: stop!", known), features("you there stop", toxicity._WordHash())
    assert np.array_equal(np.sort(a), np.sort(b))
    text = " ".join(f"word{i}ing" for i in range(500))
    whole = features(text, toxicity._WordHash())
    monkeypatch.setattr(toxicity, "_KEPT", 100)  # the memory is cleared amid a text
    small = toxicity._WordHash()
    for _ in range(3):
        assert np.array_equal(np.sort(features(text, small)), np.sort(whole))


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows(spark, tmp_path, clash):
    rows = [(i, f"you are a foul rotten scoundrel number {i}" if i % 3 == 0 else f"the weather over the harbour is fine today {i}") for i in range(90)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(90)] + [(None, 1, 1), (1, 1, None), (2, 5, 9), (9999, 1, 1), (200, 1, 0)]
    rows += [(None, "you are a foul rotten scoundrel"), (200, None), (201, ""), (202, "fine weather " * 30_000), (203, "you are a foul rotten scoundrel"), (203, "you are a foul rotten scoundrel")]
    t, lab = documents(rows), (LABELS, labels)
    folder = write(tmp_path, documents=with_clashes(*t) if clash else t, labels=with_clashes(*lab) if clash else lab)
    got = op9.run(spark, folder).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[203]["score"] == by[None]["score"] > 0.5 > by[202]["score"] and by[200]["score"] == by[201]["score"] < 0.5 and by[None]["held_out"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = without_toxic(docs, fit(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    assert kept.schema == docs.schema
    assert rows_of(kept, ["doc_id"]) == sorted(((r["doc_id"],) for r in got if not r["predicted"]), key=repr)


def test_without_labels_or_documents(spark, tmp_path):
    folder = write(tmp_path, documents=documents([(1, "a b"), (2, None)]), labels=(LABELS, []))
    got = op9.run(spark, folder)
    assert rows_of(got, ["doc_id", "score"]) == [(1, 0.5), (2, 0.5)]
    folder = write(tmp_path, documents=(DOCUMENTS, []), labels=(LABELS, [(1, 1, 1)]))
    assert op9.run(spark, folder).collect() == []


def test_the_sample_is_bounded_in_rows_and_features(spark):
    ids = [i for i in range(40) if not held(i)]
    docs = spark.createDataFrame([(ids[0], f"word{i} again and again") for i in range(20_000)] + [(i, "a text " * i) for i in ids[1:]], "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    some = labelled_sample(docs, labels, "toxic", 10, "ftrl", toxicity._featured)
    every = labelled_sample(docs, labels, "toxic", 100, "ftrl", toxicity._featured)
    assert some.count() == 10 and every.count() == len(ids) == every.select("place").distinct().count()
    sizes = [("b", 5), ("a", 3), ("c", 9), ("d", 1)]
    assert [toxicity._last_place(sizes, n) for n in (2, 3, 8, 16, 17, 18)] == ["", "a", "b", "b", "c", "d"]
    assert not len(fit(docs, labels, features=0).keys)
