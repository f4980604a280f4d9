import numpy as np
import pytest

from larkspur.llm.quality import NAMES, fit, lift, of_quality, rising, score, statistics
from larkspur.llm.queries import op2

from .helpers import DOCUMENTS, LABELS, documents, rows_of, with_clashes, write

BIG = "/root/testdata/sf0.01"


def held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def scored(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    return [(r, labels.get(r["doc_id"])) for r in op2.run(spark, BIG).collect()]


def test_every_document_is_scored(spark, scored):
    assert len(scored) == spark.read.parquet(f"{BIG}/documents.parquet").count()
    for r, _ in scored:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == held(r["doc_id"])


def test_held_out_accuracy(scored):
    pairs = [(r["score"], r["predicted"], y) for r, y in scored if r["held_out"] and y is not None]
    good, bad = [s for s, _, y in pairs if y == 1], [s for s, _, y in pairs if y == 0]
    assert len(pairs) > 50 and bad
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > 0.9 and np.mean([p == y for _, p, y in pairs]) > 0.9


def test_labels_of_the_held_out_fifth_are_not_learned(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    from pyspark.sql import functions as F

    from larkspur.llm._common import held_out

    turned = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = fit(docs, labels), fit(docs.repartition(5), turned)
    for x, y in zip(vars(a).values(), vars(b).values(), strict=True):
        assert np.array_equal(x, y)


def test_summed_equations_solve_the_ridge(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    m = fit(docs, labels, ridge=0.01)
    import hashlib

    rows = []
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in labels.collect():
        place = hashlib.md5(f"rff:{r['doc_id']}:{r['quality']}".encode()).hexdigest()
        if not held(r["doc_id"]) and int(place[:4], 16) % 4:
            rows.append((statistics(text[r["doc_id"]]), r["quality"]))
    x, y = np.array([a for a, _ in rows]), np.array([b for _, b in rows], float)
    z = lift((x - m.mean) / m.scale, m.directions, m.phases)
    penalty = np.eye(z.shape[1]) * 0.01 * len(y)
    penalty[0, 0] = 0
    assert np.allclose(np.linalg.solve(z.T @ z + penalty, z.T @ y), m.weights, atol=1e-3)


def test_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 5))
    z = lift(x, rng.normal(size=(5, 20_000)), rng.uniform(0, 2 * np.pi, 20_000))[:, 1:]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 2)
    assert np.abs(z @ z.T - kernel).max() < 0.05


def test_isotonic_curve():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=300), 1)
    y = (rng.random(300) < 1 / (1 + np.exp(-3 * x))).astype(float)
    knots, levels = rising(x, y)
    assert (np.diff(knots) > 0).all() and (np.diff(levels) > 0).all() and 0 <= levels[0] and levels[-1] <= 1
    assert np.array_equal(rising(np.array([1.0, 2, 3]), np.array([1.0, 1, 1]))[1], [1.0])


def test_statistics_of_odd_texts():
    assert not statistics("").any() and not statistics(None).any()
    for t in (" ", "\n\n", "a", "\x00", "😀" * 10, "|" * 100_000, "ß\t."):
        assert np.isfinite(statistics(t)).all() and len(statistics(t)) == len(NAMES)


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows(spark, tmp_path, clash):
    good = "The committee met on Tuesday and agreed on the plan for the coming year."
    rows = [(i, good + f" Item {i} was read." if i % 2 else "||| $$$ ### " * (i % 7 + 1)) for i in range(40)] + [(None, good), (50, None), (51, ""), (52, good * 2000), (53, good), (53, good)]
    labels = [(i, i % 2, 0) for i in range(40)] + [(None, 1, None), (1, 1, 0), (1, None, 1), (2, 7, 7), (999, 1, 1), (50, 0, 0)]
    t, lab = documents(rows), (LABELS, labels)
    folder = write(tmp_path, documents=with_clashes(*t) if clash else t, labels=with_clashes(*lab) if clash else lab)
    got = op2.run(spark, folder).collect()
    assert sorted((r["doc_id"] or -1 for r in got)) == sorted(-1 if r[0] is None else r[0] or -1 for r in rows)
    assert all(0 <= r["score"] <= 1 for r in got) and all(r["held_out"] for r in got if r["doc_id"] is None)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[53] == by[None] and by[50] == by[51]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = of_quality(docs, fit(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    assert kept.schema == docs.schema
    assert rows_of(kept, ["doc_id"]) == sorted(((r["doc_id"],) for r in got if r["predicted"]), key=repr)


def test_without_labels_or_documents(spark, tmp_path):
    folder = write(tmp_path, documents=documents([(1, "a b"), (2, None)]), labels=(LABELS, []))
    assert rows_of(op2.run(spark, folder), ["doc_id", "score", "predicted"]) == [(1, 0.5, 1), (2, 0.5, 1)]
    folder = write(tmp_path, documents=documents([(1, "a b"), (2, None)]), labels=(LABELS, [(1, 1, 0)]))
    assert all(0 <= r["score"] <= 1 for r in op2.run(spark, folder).collect())
    folder = write(tmp_path, documents=(DOCUMENTS, []), labels=(LABELS, [(1, 1, 1)]))
    assert op2.run(spark, folder).collect() == []


def test_a_score_does_not_depend_on_its_neighbours(spark, scored):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    some = score(docs.where("doc_id % 50 = 0"), fit(docs, labels))
    whole = {r["doc_id"]: r["score"] for r, _ in scored}
    assert all(abs(r["score"] - whole[r["doc_id"]]) < 1e-9 for r in some.collect())
