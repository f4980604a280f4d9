import numpy as np
import pytest

from larkspur.llm import near_vectors as nv
from larkspur.llm.queries import op5

from .helpers import EMBEDDINGS, SF, rows_of, sql_rows, with_clashes, write

COLS = ["vec_id", "n_links", "component_id", "kept"]


def brute(rows, threshold=0.98):
    ok = [v is not None and label is not None and None not in v and len(v) and bool(np.isfinite(v).all()) and any(v) for _, v, label in rows]
    unit = [np.array(v, "f4").astype(float) / np.linalg.norm(np.array(v, "f4").astype(float)) if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    near = {i: [j for j in range(len(rows)) if j != i and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(len(rows))}
    out, home = [], {}
    for i in range(len(rows)):
        if i not in home:
            todo, seen = [i], {i}
            while todo:
                for j in near[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            ids = [rows[j][0] for j in seen if rows[j][0] is not None]
            home |= dict.fromkeys(seen, min(ids, default=None))
        out.append((rows[i][0], len(near[i]), home[i], home[i] is None or rows[i][0] == home[i]))
    return sorted(out, key=repr)


def test_agrees_with_sql(spark):
    assert rows_of(op5.run(spark, SF)) == sql_rows(SF, op5.SQL, "embeddings")


@pytest.mark.parametrize("clash", [True])  # the plain table is that of the other tests
def test_odd_rows(spark, tmp_path, clash):
    nan = float("nan")
    rows = [(5, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (9, [2.0, 0.0], 1), (1, [1.0, 0.0], 2), (3, [1.0, 0.0], None), (4, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [None, 1.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [], 1), (12, [0.0, 1.0], 1), (12, [0.0, 1.0], 1), (None, [0.7, 0.7], 1), (13, [0.7, 0.7], 1), (None, [-1.0, 0.0], 3), (14, [-0.0, 1.0], 1)]
    folder = write(tmp_path, embeddings=with_clashes(EMBEDDINGS, rows) if clash else (EMBEDDINGS, rows))
    assert rows_of(op5.run(spark, folder), COLS) == brute(rows)


def test_chains_and_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(nv, "BLOCK", 32)
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, (base + 0.05 * rng.normal(size=16)).astype("f4").tolist(), 1) for i in range(150)]
    rows += [(200 + i, rng.normal(size=16).astype("f4").tolist(), 1) for i in range(150)]
    turn = lambda t: [float(np.cos(t)), float(np.sin(t)), *[0.0] * 14]
    rows += [(400 + i, turn(0.15 * i), 2) for i in range(30)]  # each links with its neighbours only
    rows += [(600 + i, rows[0][1], 1) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    assert rows_of(nv.near_vectors(df), COLS) == brute(rows)


def test_every_link_of_a_dense_label_is_found(spark):
    """A narrow cone of different vectors, where hundreds that don't link lie between the two of a pair."""
    rng = np.random.default_rng(7)
    axis, *_ = np.linalg.qr(rng.normal(size=(64, 1)))[0].T
    x = rng.normal(size=(5000, 64))
    x = np.sqrt(0.9) * axis + np.sqrt(0.1) * (x - (x @ axis)[:, None] * axis) / 8
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = rng.normal(size=(100, 64))
    near -= (near * x[:100]).sum(axis=1)[:, None] * x[:100]
    near /= np.linalg.norm(near, axis=1)[:, None]
    x = np.vstack([x, 0.982 * x[:100] + np.sqrt(1 - 0.982**2) * near]).astype("f4")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    links = unit @ unit.T >= 0.98
    np.fill_diagonal(links, False)
    assert links.sum() == 200 and links.any(axis=1).sum() == 200
    order = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), x[i].tolist(), 1) for i in order], "vec_id long, embedding array<float>, label int").repartition(5)
    want = [(i, int(links[i].sum()), min([i, *np.flatnonzero(links[i]).tolist()]), not links[i, :i].any()) for i in range(len(x))]
    assert rows_of(nv.near_vectors(df), COLS) == sorted(want, key=repr)


def test_empty(spark, tmp_path):
    assert op5.run(spark, write(tmp_path, embeddings=(EMBEDDINGS, []))).collect() == []
    assert rows_of(op5.run(spark, write(tmp_path, embeddings=(EMBEDDINGS, [(1, [0.0], 1)]))), COLS) == [(1, 0, 1, True)]
