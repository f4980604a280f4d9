"""What keeps the figures of larger tables in bounds."""

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from larkspur.functions import cleaning, types
from larkspur.operators import bundle, dedup, embed, records, vectors
from larkspur.operators.validate import GateError, gate
from larkspur.plans import catalog, stages

SF = "/root/testdata/sf0.001"


def test_one_run_for_all_gates(spark, monkeypatch):
    runs = []
    monkeypatch.setattr(stages, "validate", lambda *a, run=stages.validate, **named: runs.append(a) or run(*a, **named))
    got = catalog.QUERIES["pass_gate"](spark, SF).collect()
    assert len(runs) == 1 and len({r["accepted"] for r in got}) == 1 and [r["refused"] for r in got][-1]


def test_gate_of_a_report():
    report = {"totals": {"read": 4, "accepted": 1, "pass_rate": 0.25}}
    gate(report, 0.25)
    gate({"totals": {"read": 0, "accepted": 0, "pass_rate": 1.0}}, 1.0)
    with pytest.raises(GateError, match="0.2500 is below 0.26"):
        gate(report, 0.26)


def test_texts_in_slices(monkeypatch):
    monkeypatch.setattr(types, "BYTES", 10)
    monkeypatch.setattr(types, "ROWS", 3)
    texts = ["aaaa", None, "éé", "x", "long enough to go alone", "", "bbbbbbbbbb", "c"]
    parts = [p.to_pylist() for p in types.slices([pa.array(texts), pa.array([], pa.string()), pa.array(["z"])])]
    assert parts == [["aaaa", None, "éé"], ["x"], ["long enough to go alone"], ["", "bbbbbbbbbb"], ["c"], ["z"]]


def test_cleaning_answers_slice_by_slice():
    """A batch of long texts is answered in parts, each of a bounded size."""
    texts = pa.array([f"<b>{'é' * 50_000} {i}" for i in range(100)])
    parts = list(cleaning.clean_text.func(iter([texts])))
    assert sum(map(len, parts)) == 100 and max(map(len, parts)) <= types.BYTES // 100_000
    assert [x["text"][-2:].strip() for p in parts for x in p.to_pylist()] == [str(i) for i in range(100)]


def test_casefold_sends_only_what_needs_it(spark):
    texts = ["Plain ASCII", "", None, "STRASSE ß", "İstanbul", "K", "ﬁ", "ΣΑΣ", "a\x7fB\n"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", cleaning.casefold("t").alias("c"))
    assert [r["c"] for r in rows.orderBy("i").collect()] == [None if t is None else t.casefold() for t in texts]
    crossing = next(x for x in rows._jdf.queryExecution().executedPlan().toString().split("\n") if "ArrowEvalPython" in x)
    assert "octet_length" in rows._jdf.queryExecution().optimizedPlan().toString() and "_casefold(t#" not in crossing


def test_embedding_takes_a_slice_at_a_time():
    """A batch of long texts reaches the embedder in bounded parts, and every row comes out in order."""
    asked = []

    class Watched(embed.BucketEmbedder):
        def count_tokens(self, texts):
            asked.append(len(texts))
            return super().count_tokens(texts)

        def encode(self, texts, batch_size):
            asked.append(len(texts))
            return super().encode(texts, batch_size)

    n, one = 64, Watched(8)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["a"] * n), pa.array(["word " * 20_000] * n)], ["row", "ad_id", "text"])
    out = pa.Table.from_batches(embed._vectors(one, 256, embed._counts(one, iter([batch, batch.slice(0, 0)]))))
    assert out.column("row").to_pylist() == list(range(n)) and set(out.column("n_tokens").to_pylist()) == {20_002}
    assert max(asked) <= types.BYTES // 100_000 and sum(asked) == 2 * n


def test_records_are_read_slice_by_slice():
    lines = pa.array(['{"ad_id": "a", "headline": "%s"}' % ("h" * 100_000)] * 50 + ["{"])
    parts = list(records.read_record.func(iter([lines])))
    assert sum(map(len, parts)) == 51 and max(map(len, parts)) <= types.BYTES // 100_000 + 1
    assert [x["state"] for p in parts for x in p.to_pylist()] == ["missing"] * 50 + ["json"]


def _vectors(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row long, vector array<float>")


@pytest.mark.parametrize("at_once", [2048, 0])
def test_equal_vectors_tie_wherever_they_lie(spark, monkeypatch, at_once):
    """Copies in blocks of other shapes have the same score, and the smaller rows win; a large group of copies too."""
    monkeypatch.setattr(vectors, "BLOCK", 37)
    monkeypatch.setattr(vectors, "ROWS_IN_CELL", 60)
    monkeypatch.setattr(vectors, "QUERIES_IN_CELL", 11)
    x = np.random.default_rng(5).normal(size=(40, 64)).astype("f4")
    x = np.vstack([np.tile(x, (5, 1)), np.tile(x[:1], (90, 1)), x[:3]])
    rows = _vectors(spark, x).repartition(5)
    got = vectors.search(rows, rows.where("row < 25").withColumnRenamed("row", "query_id"), 7, at_once=at_once).select("query_id", "rank", "row").collect()
    scores = np.array([[np.dot(a.astype(float), b.astype(float)) for b in x[:40]] for a in x[:25]])
    of = np.array([*np.tile(np.arange(40), 5), *[0] * 90, 0, 1, 2])
    want = [(q, n + 1, r) for q in range(25) for n, r in enumerate(sorted(range(len(x)), key=lambda i: (-scores[q, of[i]], i))[:7])]
    assert sorted(map(tuple, got)) == want


def test_cells_bound_the_work_of_a_task(spark, monkeypatch):
    """Vectors and queries in many cells: as many tasks, and no more rows than k for each query and group of vectors."""
    monkeypatch.setattr(vectors, "BLOCK", 10)
    monkeypatch.setattr(vectors, "ROWS_IN_CELL", 50)
    monkeypatch.setattr(vectors, "QUERIES_IN_CELL", 20)
    rows = _vectors(spark, np.random.default_rng(6).normal(size=(400, 8)).astype("f4")).repartition(3)
    found = vectors._blockwise(rows, rows.where("row < 60").select(F.col("row").alias("query_id"), F.col("vector").cast("array<double>")), 3)
    assert found.rdd.getNumPartitions() == 8 * 3 and found.count() <= 60 * 8 * 3


def test_vectors_that_are_no_number_come_first_as_in_sql(spark):
    rows = _vectors(spark, np.array([[1, 0], [0, 1], [np.nan, 0], [1, 1]], "f4"))
    for at_once in (2048, 0):
        got = vectors.search(rows, spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>"), 3, at_once=at_once)
        assert [r["row"] for r in got.orderBy("rank").collect()] == [2, 0, 3]


@pytest.mark.parametrize("piece", [1, 2, 4096])
def test_vectors_are_written_without_the_driver(spark, monkeypatch, tmp_path, piece):
    """Whatever the lengths of partitions and pieces; no row comes to the driver as a result."""
    monkeypatch.setattr(bundle, "_PIECE", piece)
    x = np.random.default_rng(7).normal(size=(101, 5)).astype("<f4")
    rows = _vectors(spark, x).repartition(3)
    for way in ("toLocalIterator", "collect"):
        monkeypatch.setattr(type(rows), way, lambda *a, **named: pytest.fail("rows come to the driver"))
    bundle.write_vectors(rows, f"file://{tmp_path}/v.f32")
    assert (tmp_path / "v.f32").read_bytes() == x.tobytes()
    bundle.write_vectors(rows.where("row < 0"), f"file://{tmp_path}/none.f32")
    assert (tmp_path / "none.f32").read_bytes() == b""


def test_rounds_join_back_only_shared_keys(spark, monkeypatch):
    """Lone fingerprints aren't aggregated again in the rounds, and the result is the loop's."""
    asked = []
    monkeypatch.setattr(dedup, "_least", lambda rows, key, least=dedup._least: asked.append((key, rows.count())) or least(rows, key))
    rng = np.random.default_rng(8)
    rows = [(i, f"u{rng.integers(40)}", f"p{rng.integers(30) if i % 4 == 0 else 1000 + i}") for i in range(300)]
    got = dedup.duplicates(spark.createDataFrame(rows, "line_no long, id string, print string"), tail=0).collect()
    ids, prints, want = set(), set(), []
    for n, i, p in rows:
        if i in ids or p in prints:
            want.append((n, "E010" if i in ids else "E011"))
        else:
            ids.add(i)
            prints.add(p)
    assert sorted(map(tuple, got)) == want and max(n for key, n in asked if key == "print") <= 75
