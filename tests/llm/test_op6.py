import random
import re

import numpy as np
import pytest

from larkspur.llm import _graph as graph
from larkspur.llm import minhash as mh
from larkspur.llm._graph import connected_components
from larkspur.llm.queries import op6

from .helpers import DOCUMENTS, SF, documents, rows_of, sql_rows, with_clashes, write

COLS = ["doc_id", "n_shingles", "component_id", "kept"]


def shingles(text, width):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width=4, percent=80):
    sets = [shingles(t, width) for _, t in rows]
    near = lambda p, q: bool(p and q) and 100 * len(p & q) >= percent * len(p | q)
    out, home = [], {}
    for i in range(len(rows)):
        if i not in home:
            todo, seen = [i], {i}
            while todo:
                now = todo.pop()
                for j in range(len(rows)):
                    if j not in seen and near(sets[now], sets[j]):
                        seen.add(j)
                        todo.append(j)
            home |= dict.fromkeys(seen, min((rows[j][0] for j in seen if rows[j][0] is not None), default=None))
        out.append((rows[i][0], len(sets[i]), home[i], home[i] is None or rows[i][0] == home[i]))
    return sorted(out, key=repr)


def family(rng, n, words, edits):
    """Variants of one text, each ``edits`` words away from it or from another variant."""
    made = [[f"w{rng.randrange(5000)}" for _ in range(words)]]
    while len(made) < n:
        one = list(rng.choice(made[-3:]))
        for _ in range(edits):
            one[rng.randrange(len(one))] = f"w{rng.randrange(5000)}"
        made.append(one)
    return [" ".join(w) for w in made]


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(2)
    texts = []
    for words, edits in ((60, 1), (200, 3), (200, 5), (400, 6), (30, 1)):
        texts += family(rng, 12, words, edits)
    texts += [texts[0]] * 40 + [texts[20].upper()] * 5
    texts += [" ".join(f"v{rng.randrange(9000)}" for _ in range(rng.randint(1, 90))) for _ in range(60)]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


def test_agrees_with_sql(spark):
    assert rows_of(op6.run(spark, SF)) == sql_rows(SF, op6.SQL, "documents")


@pytest.mark.parametrize("width", [4, 5])
def test_families(spark, mixed, width):
    df = spark.createDataFrame(mixed, "doc_id long, text string").repartition(6)
    assert rows_of(mh.near_duplicates(df, width), COLS) == brute(mixed, width)


def test_small_blocks_lose_nothing(spark, mixed, monkeypatch):
    monkeypatch.setattr(graph, "FEW", 0)
    monkeypatch.setattr(mh, "BLOCK", 4)
    monkeypatch.setattr(mh, "HUB_BANDS", 1)
    df = spark.createDataFrame(mixed, "doc_id long, text string").repartition(3)
    assert rows_of(mh.near_duplicates(df, 4), COLS) == brute(mixed, 4)


def test_one_document_of_each_group_stays(spark, mixed):
    df = spark.createDataFrame([(*r, "c", 1.5) for r in mixed], "doc_id long, text string, node string, score double")
    kept = mh.without_near_duplicates(df)
    assert kept.columns == df.columns
    assert rows_of(kept, ["doc_id", "text"]) == sorted(((r[0], dict(mixed)[r[0]]) for r in brute(mixed, 5) if r[3]), key=repr)


@pytest.mark.parametrize("clash", [True])  # the plain table is that of the other tests
def test_odd_rows(spark, tmp_path, clash):
    long = " ".join(f"z{i % 7001}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (4, "one"), (5, "One"), (6, "one two three"), (7, "one two three four"), (8, "ONE  two\nthree\tfour"), (8, "ONE  two\nthree\tfour"), (None, "one two three four"), (None, "lonely text without an id"), (9, long), (10, long + " tail"), (11, "ÄRGER über den Bach"), (12, "ärger über den Bach"), (13, "a b c d e"), (14, "a b c d e"), (15, "x\x00y z w v"), (16, "lonely Text without an id")]
    table = documents(rows)
    folder = write(tmp_path, documents=with_clashes(*table) if clash else table)
    assert rows_of(op6.run(spark, folder), COLS) == brute(rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert mh.without_near_duplicates(docs, width=4).schema == docs.schema


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(2, "a b c d e f")], "doc_id long, text string")
    assert [tuple(r) for r in mh.without_near_duplicates(df).collect()] == [(1, "a b c d e f")]


def test_one_row_of_a_group_stays_whatever_ids_repeat(spark):
    rows = [(1, "one two three four five six seven"), (1, "One Two Three Four Five Six Seven"), (2, "ONE two three four five six seven"), (None, "eight nine ten"), (None, "Eight nine ten"), (None, "two three"), (7, "two THREE"), (8, ""), (8, ""), (9, None)]
    got = mh.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), (r["text"] or "").lower()) for r in got) == [("1", rows[0][1]), ("7", "two three"), ("8", ""), ("9", ""), ("None", "eight nine ten")]


def test_empty(spark, tmp_path):
    folder = write(tmp_path, documents=(DOCUMENTS, []))
    assert op6.run(spark, folder).collect() == []
    assert mh.without_near_duplicates(spark.read.parquet(f"{folder}/documents.parquet")).collect() == []


def test_pairs_at_the_threshold_survive_the_batches():
    rng, least, lost = np.random.default_rng(0), mh.least_matches(0.8, mh.MISS), 0
    a = rng.integers(0, 2**32, (20_000, mh.HASHES), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.8, a, a + np.uint32(1))
    lost = 20_000 - len(mh.survivors(a, b, least))
    assert lost <= 3
    b = np.where(rng.random(a.shape) < 0.4, a, a + np.uint32(1))
    assert len(mh.survivors(a, b, least)) < 200  # and far ones go


@pytest.mark.parametrize("few", [0, 40, 20_000])
def test_components_of_random_graphs(spark, few):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(200)]
    home = {}

    def find(x):
        while home.setdefault(x, x) != x:
            x = home[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        home[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
