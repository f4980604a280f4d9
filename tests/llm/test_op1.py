import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import ann
from larkspur.llm.queries import op1
from larkspur.llm.ann import bounds, encode, rotation, search

from .helpers import EMBEDDINGS, SF, rows_of, sql_rows, with_clashes, write


def brute(rows, wanted, k=10):
    out = []
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    for q, x in {(i, tuple(v)) for i, v in fine if wanted(i)}:
        d = sorted((float(np.sqrt(np.cumsum((v - np.array(x)) ** 2)[-1])), i) for i, v in fine if i != q and len(v) == len(x))
        out += [(q, n + 1, i, round(s, 9)) for n, (s, i) in enumerate(d[:k])]
    return sorted(out, key=repr)


def test_agrees_with_sql_on_the_whole_table(spark):
    assert rows_of(op1.run(spark, SF)) == sql_rows(SF, op1.SQL, "embeddings")


def test_recall_on_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "INDEX_BLOCK", 256)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 32))
    x = (centres[rng.integers(0, 20, 1500)] + 0.3 * rng.normal(size=(1500, 32))).astype("f4")
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    got = rows_of(search(df, F.col("vec_id") % 25 == 0), ["query_id", "rank", "vec_id", "score"])
    want = brute(rows, lambda i: i % 25 == 0)
    assert len(got) == len(want)
    pairs = lambda r: {(a, c) for a, _, c, _ in r}
    assert len(pairs(got) & pairs(want)) >= 0.99 * len(want)


def test_estimates_lie_within_their_bounds():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(400, 48)), rng.normal(size=(20, 48))
    centre, codes, radius, overlap = encode(x)
    low, high = bounds(q, centre, codes, radius, overlap, 4.0)
    true = ((q[:, None] - x[None]) ** 2).sum(2)
    assert ((low <= true) & (true <= high)).mean() > 0.999
    assert (high - low).mean() < 2 * true.mean()  # they tell near from far
    assert np.allclose(rotation(48) @ rotation(48).T, np.eye(48))


@pytest.mark.parametrize("clustered", [False, True])
def test_few_are_reranked_and_nearly_all_neighbours_found(clustered):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20_000, 64))
    if clustered:
        x = 0.5 * x + rng.normal(size=(100, 64))[rng.integers(0, 100, len(x))]
    x = x.astype("f4").astype(float)
    kept, hits, asked = 0, 0, range(0, 20_000, 500)
    codes = [(s, *encode(x[s : s + ann.INDEX_BLOCK])) for s in range(0, len(x), ann.INDEX_BLOCK)]
    true = {q: set(np.argsort(((x - x[q]) ** 2).sum(axis=1))[1:11].tolist()) for q in asked}
    for s, *code in codes:
        low, high = bounds(x[list(asked)], *code, ann.BOUND)
        for i, q in enumerate(asked):
            limit = np.partition(np.delete(high[i], q - s) if s <= q < s + ann.INDEX_BLOCK else high[i], 9)[9]
            found = set((np.flatnonzero(low[i] <= limit) + s).tolist()) - {q}
            kept, hits = kept + len(found), hits + len(found & true[q])
    assert hits >= 0.98 * 10 * len(asked) and kept < (0.1 if clustered else 0.5) * len(asked) * len(x)


def test_products_from_packed_bits():
    rng = np.random.default_rng(3)
    turned, bits = rng.normal(size=(7, 21)), rng.random((50, 21)) > 0.5
    assert np.allclose(ann.code_products(turned, np.packbits(bits, axis=1)), turned @ (bits.T * 2.0 - 1), atol=1e-5)


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows(spark, tmp_path, clash):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (200, None), (300, [0.0, 0.0]), (400, [nan, 1.0]), (500, [1.0, inf]), (600, [None, 1.0]), (700, []), (800, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (900, [5.0, 5.0])]
    table = (EMBEDDINGS, [(i, v, 1) for i, v in rows])
    folder = write(tmp_path, embeddings=with_clashes(*table) if clash else table)
    assert rows_of(op1.run(spark, folder), ["query_id", "rank", "vec_id", "score"]) == brute(rows, lambda i: i % 100 == 0)


def test_empty(spark, tmp_path):
    assert op1.run(spark, write(tmp_path, embeddings=(EMBEDDINGS, []))).collect() == []
