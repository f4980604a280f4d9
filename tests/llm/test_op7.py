import random

import pytest

from larkspur.llm.mixing import mix, mixed_documents, plan_mix, water_fill
from larkspur.llm.queries import op7

from .helpers import DOCUMENTS, SF, documents, rows_of, sql_rows, with_clashes, write


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by the definition: clamp, share anew, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    clamped, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in order if s not in clamped]
        left = total - sum(most * sizes[s] for s in clamped)
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s for s in rest if share[s] >= most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in clamped else share[s] for s in order}
        clamped |= over


def test_agrees_with_sql(spark):
    assert rows_of(op7.run(spark, SF)) == sql_rows(SF, op7.SQL, "documents")


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {rng.choice(["a", "b", "é", "Z", "😀", "￿", ""]) + str(i): int(rng.paretovariate(0.6) * 10) for i in range(20)} | {None: 50, "zero": 0}
    got = {r["source"]: r["target"] for r in water_fill(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(filled(sizes))


def test_words_come_near_their_targets(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(["w"] * rng.randint(1, 40)), rng.choices(["a", "b", "c", "d", None], [60, 5, 5, 20, 10])[0]) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mix(df).collect()
    source = {i: s for i, _, s in docs}
    for s in set(source.values()):
        mine = [r for r in got if source[r["doc_id"]] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 40
        assert all(r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"] for r in mine)
        assert mine[0]["source_size"] == sum(r["size"] for r in mine)
    assert rows_of(mix(df.repartition(7))) == rows_of(mix(df))
    times = {r["doc_id"]: r["taken"] // r["size"] for r in got}
    out = [r["doc_id"] for r in mixed_documents(df).collect()]
    assert all(out.count(i) == n for i, n in list(times.items())[:300]) and len(out) == sum(times.values())


@pytest.mark.parametrize("clash", [True])  # the plain table is that of the other tests
def test_odd_rows(spark, tmp_path, clash):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (None, "x y z", "b"), (4, " \t ", "c"), (5, "one", "d"), (5, "one", "d"), (6, "w " * 50_000, "a"), (7, "p q", "")]
    table = documents(rows)
    folder = write(tmp_path, documents=with_clashes(*table) if clash else table)
    assert rows_of(op7.run(spark, folder)) == sql_rows(folder, op7.SQL, "documents")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = mixed_documents(docs)
    assert out.schema == docs.schema
    by_id = [r["doc_id"] for r in out.collect()]
    assert all(by_id.count(i) <= 3 * sum(r[0] == i for r in rows) for i in set(by_id))


def test_empty_and_only_empty_texts(spark, tmp_path):
    folder = write(tmp_path, documents=(DOCUMENTS, []))
    assert op7.run(spark, folder).collect() == []
    assert mixed_documents(spark.read.parquet(f"{folder}/documents.parquet")).collect() == []
    folder = write(tmp_path, documents=documents([(1, "", "a"), (2, None, "b")]))
    assert rows_of(op7.run(spark, folder), ["doc_id", "size", "taken"]) == [(1, 0, 0), (2, 0, 0)]


def test_one_source(spark):
    df = spark.createDataFrame([(i, "a b c", "s") for i in range(50)], "doc_id long, text string, source string")
    plan = plan_mix(df).collect()
    assert [(r["source"], r["source_size"], r["target"]) for r in plan] == [("s", 150, 150.0)]
    assert {r["taken"] for r in mix(df).collect()} == {3}
