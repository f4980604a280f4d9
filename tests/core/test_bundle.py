import hashlib
import json
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import bundle as B
from larkspur.operators import embed as E
from larkspur.operators import evaluate, vectors
from larkspur.schema import CLEAN_COLUMNS


class Small(E.HashingEmbedder):
    def __init__(self, dim=8, max_tokens=16, revision="t"):
        super().__init__(dim, max_tokens, revision)


def record(i, **change):
    values = (f"ad_{i:05d}", f"Headline of record {i}.", f"Text {i}", "gaming", "adv", 1.5, "2026-01-01T00:00:00Z")
    return dict(zip(CLEAN_COLUMNS, values, strict=True)) | change


@pytest.fixture(scope="module")
def stage(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stage")
    (folder / "clean.jsonl").write_text("".join(json.dumps(record(i)) + "\n" for i in range(20)))
    E.embed(spark, str(folder / "clean.jsonl"), str(folder / "emb"), Small())
    told = B.publish(spark, str(folder / "clean.jsonl"), str(folder / "emb"), str(folder / "root"))
    return folder, told


@pytest.fixture
def copy(stage, tmp_path):
    shutil.copytree(stage[0], tmp_path / "c")
    return tmp_path / "c"


def test_compose(spark):
    rows = spark.createDataFrame([("Ends.", "more"), ("Open", "more"), ("Alone", ""), ("Alone", None)], "h string, d string")
    assert [r[0] for r in rows.select(E.compose_text(F.col("h"), F.col("d"))).collect()] == ["Ends. more", "Open. more", "Alone", "Alone"]


def test_token_gate(spark, tmp_path):
    (tmp_path / "c").write_text(json.dumps(record(0, description="w " * 40)) + "\n" + json.dumps(record(1)) + "\n")
    with pytest.raises(E.TruncationError, match="ad_00000"):
        E.embed(spark, str(tmp_path / "c"), str(tmp_path / "e"), Small())
    assert not (tmp_path / "e/embedded.parquet").exists()
    assert E.embed(spark, str(tmp_path / "c"), str(tmp_path / "e"), Small(), allow_truncation=True)["tokens"]["truncated"] == 1


def test_load_counts_records_not_lines(spark, tmp_path):
    (tmp_path / "c").write_text("\n" + json.dumps(record(5)) + "\n\n" + json.dumps(record(6)) + "\n" + json.dumps(record(7)))
    got = E.load_clean(spark, str(tmp_path / "c"), 2).orderBy("row").select("row", "ad_id").collect()
    assert [tuple(r) for r in got] == [(0, "ad_00005"), (1, "ad_00006")]


def test_round_trip(spark, stage):
    folder, told = stage
    got = B.load(spark, str(folder / "root"))
    assert len(got) == 20 and got.row_of("ad_00007") == 7 and got.row_of("none") is None
    for row in (0, 11):
        top = got.top_k(got.vector(row), 3).collect()
        assert top[0]["row"] == row and abs(top[0]["score"] - 1) < 1e-5
    assert told["vectors"]["bytes"] == 20 * 8 * 4
    raw = np.fromfile(folder / "root" / told["version"] / "vectors.f32", "<f4").reshape(20, 8)
    assert np.allclose(raw[3], got.vector(3))


def change(folder, edit, signed=True):
    at = folder / "root" / (folder / "root/LATEST").read_text().strip()
    m = json.loads((at / "manifest.json").read_text())
    edit(at, m)
    if signed:
        for part in ("vectors", "ads"):
            if (at / str(m[part]["file"])).is_file():
                m[part]["sha256"] = hashlib.sha256((at / m[part]["file"]).read_bytes()).hexdigest() if m[part]["sha256"] == "new" else m[part]["sha256"]
    (at / "manifest.json").write_text(json.dumps(m))


def put(*path, value):
    def edit(_, m):
        for p in path[:-1]:
            m = m[p]
        m[path[-1]] = value

    return edit


def vector(row, values):
    def edit(at, m):
        x = np.fromfile(at / "vectors.f32", "<f4").reshape(20, 8)
        x[row] = values
        x.tofile(at / "vectors.f32")
        m["vectors"]["sha256"] = "new"

    return edit


def lines(f):
    def edit(at, m):
        out = f((at / "ads.jsonl").read_text().splitlines())
        (at / "ads.jsonl").write_text("\n".join(out) + "\n")
        m["ads"]["sha256"] = "new"

    return edit


def flip(byte, bit):
    def edit(at, _):
        raw = bytearray((at / "vectors.f32").read_bytes())
        raw[byte] ^= 1 << bit
        (at / "vectors.f32").write_bytes(raw)

    return edit


FAULTS = [
    (put("vectors", "byte_order", value="big"), B.ManifestError), (put("model", "normalized", value=False), B.ManifestError), (put("model", "dim", value=9), B.ManifestError), (put("ads", "count", value=19), B.ManifestError),
    (put("vectors", "bytes", value=1), B.ManifestError), (put("vectors", "file", value="../x"), B.ManifestError), (put("format_version", value=2), B.ManifestError), (put("vectors", "sha256", value=""), B.ManifestError),
    (lambda at, m: m.pop("model"), B.ManifestError), (lambda at, m: (at / "vectors.f32").write_bytes(b"123"), B.VectorsError), (vector(3, np.nan), B.VectorsError), (vector(4, np.inf), B.VectorsError), (vector(5, 0), B.VectorsError), (vector(6, 1), B.VectorsError),
    *[(flip(byte, bit), B.ChecksumError) for byte, bit in ((0, 0), (36, 3), (37, 1), (38, 6), (39, 7))], (put("ads", "sha256", value="0" * 64), B.ChecksumError), (lines(lambda x: [x[1], x[0], *x[2:]]), B.AdsError), (lines(lambda x: [x[0].replace('"row":0,', ""), *x[1:]]), B.AdsError),
    (lines(lambda x: [x[0], x[1].replace("ad_00001", "ad_00000"), *x[2:]]), B.AdsError), (lines(lambda x: [x[0].replace("ad_00000", ""), *x[1:]]), B.AdsError), (lines(lambda x: x[:-1]), B.AdsError), (lines(lambda x: ["{", *x[1:]]), B.AdsError),
    (lines(lambda x: [x[0].replace("Text 0", "é" * 600_000), *x[1:]]), B.AdsError),
]


@pytest.mark.parametrize("at", range(len(FAULTS)))
def test_faults(spark, copy, at):
    edit, error = FAULTS[at]
    change(copy, edit)
    with pytest.raises(error):
        B.load(spark, str(copy / "root"))


@pytest.mark.parametrize("text", ["", "../x", "missing-version", None])
def test_pointer(spark, copy, text):
    pointer = copy / "root/LATEST"
    pointer.unlink() if text is None else pointer.write_text(text)
    with pytest.raises(B.ManifestError):
        B.load(spark, str(copy / "root"))


def test_long_line(spark, copy):
    change(copy, lines(lambda x: [x[0].replace("Text 0", "t" * 100_000), *x[1:]]))
    assert len(B.load(spark, str(copy / "root"))) == 20


@pytest.mark.parametrize("fault", ["clean", "rows", "nan"])
def test_publish_refuses_and_keeps(spark, copy, fault):
    before = (copy / "root/LATEST").read_text()
    if fault == "clean":
        with open(copy / "clean.jsonl", "a") as f:
            f.write(json.dumps(record(99)) + "\n")
    else:
        old = spark.read.parquet(str(copy / "emb/embedded.parquet"))
        new = old.where("row < 19") if fault == "rows" else old.withColumn("vector", F.when(F.col("row") == 2, F.array_repeat(F.lit(float("nan")).cast("float"), 8)).otherwise(F.col("vector")))
        new.write.parquet(str(copy / "emb/new"))
        shutil.rmtree(copy / "emb/embedded.parquet")
        (copy / "emb/new").rename(copy / "emb/embedded.parquet")
    with pytest.raises(B.PublishError):
        B.publish(spark, str(copy / "clean.jsonl"), str(copy / "emb"), str(copy / "root"))
    assert (copy / "root/LATEST").read_text() == before


def test_top_k_against_full_sort(spark):
    x = np.sin(np.arange(1, 401)).reshape(50, 8)
    x[20] = x[10]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row long, vector array<double>")
    order = sorted(range(50), key=lambda i: (-float(x[i] @ x[17]), i))
    for k in (1, 5, 50, 60, 0):
        assert [r["row"] for r in vectors.top_k(rows, x[17].tolist(), k).collect()] == order[:k]
    with pytest.raises(ValueError):
        vectors.top_k(rows, [1.0], 3)
    with pytest.raises(ValueError):
        vectors.top_k(rows, [float("nan")] * 8, 3)


def test_probe(spark, stage):
    loaded = B.load(spark, str(stage[0] / "root"))
    hits, rate = evaluate.probe(loaded, Small(), [("record 3", "gaming"), ("record", None)], 5)
    assert hits.count() == 10 and rate == 1.0
    path = stage[0] / "truth.json"
    evaluate.write_ground_truth(loaded, Small(), hits, [("record 3", "gaming"), ("record", None)], 5, str(path))
    told = json.loads(path.read_text())
    assert len(told["queries"][0]["top_k"]) == 5 and told["bundle_version"] == loaded.version and len(told["queries"][1]["vector"]) == 8
    assert evaluate.replay(loaded, str(path)).collect() == []

    def faults(edit):
        new = json.loads(json.dumps(told))
        edit(new["queries"][0]["top_k"])
        (stage[0] / "edited.json").write_text(json.dumps(new))
        return sorted((r["query_id"], r["at"], r["fault"]) for r in evaluate.replay(loaded, str(stage[0] / "edited.json")).collect())

    assert faults(lambda t: t[1].update(score=t[1]["score"] + 0.01)) == [(0, 2, "score")]
    assert faults(lambda t: t[0].update(ad_id="ad_00019x")) == [(0, 1, "ad_id")]
    other = next(i for i in range(20) if i not in [t["row"] for t in told["queries"][0]["top_k"]])
    assert faults(lambda t: t[4].update(row=other, ad_id=f"ad_{other:05d}")) == []  # it scores below the last hit: only its score would tell
    assert faults(lambda t: t.extend([t[0]] * 30)) [-1] == (0, 0, "count") or faults(lambda t: t.extend([t[0]] * 30))[0] == (0, 0, "count")
    for change in ({"bundle_version": "x"}, {"vectors_sha256": "x"}, {"queries": []}):
        (stage[0] / "stale.json").write_text(json.dumps(told | change))
        with pytest.raises(evaluate.StaleError):
            evaluate.replay(loaded, str(stage[0] / "stale.json"))


@pytest.mark.parametrize("at_once", [2048, 5, 0])
def test_search_by_broadcast_and_by_blocks(spark, monkeypatch, at_once):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "ROWS_IN_CELL", 12)
    x = np.random.default_rng(2).normal(size=(90, 6)).astype("f4")
    x[40] = x[3]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row long, vector array<float>").repartition(4)
    asked = rows.where("row < 30").withColumnRenamed("row", "query_id")
    got = sorted(map(tuple, vectors.search(rows, asked, 4, at_once=at_once).select("query_id", "rank", "row").collect()))
    scores = x[:30].astype(float) @ x.astype(float).T
    assert got == [(q, n + 1, r) for q in range(30) for n, r in enumerate(sorted(range(90), key=lambda i: (-scores[q, i], i))[:4])]
    for bad in ([1.0], [float("nan")] * 6, [None] * 6):
        with pytest.raises(ValueError):
            vectors.search(rows, spark.createDataFrame([(1, bad)], "query_id long, vector array<double>"), 4, at_once=at_once)
    assert vectors.search(rows, asked.limit(0), 4).collect() == [] and vectors.search(rows, asked, 0).collect() == []
