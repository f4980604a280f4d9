import hashlib
import json
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from larkspur.plans import catalog
from larkspur.streaming.ingest import start

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return db


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    want = duck.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda found, names: sorted(tuple(repr(dict(zip(names, r, strict=True))[c]) for c in cols) for r in found)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), want.columns)


def test_checksums_cover_every_file_of_every_table(spark, tmp_path):
    (tmp_path / "parts.parquet/deep").mkdir(parents=True)
    for name, content in {"a.parquet": b"", "parts.parquet/0.parquet": b"x" * 300_000, "parts.parquet/deep/1.parquet": b"y", "parts.parquet/_SUCCESS": b"", "other.txt": b"z"}.items():
        (tmp_path / name).write_bytes(content)
    tables = [f"{t}.parquet" for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()]
    for folder, names in ((SF, tables), (tmp_path, ["a.parquet", "parts.parquet/0.parquet", "parts.parquet/deep/1.parquet"])):
        content = {n: (Path(folder) / n).read_bytes() for n in names}
        got = catalog.QUERIES["file_checksums"](spark, str(folder)).collect()
        assert sorted(map(tuple, got)) == sorted((n, len(c), hashlib.sha256(c).hexdigest()) for n, c in content.items())


def test_stream_remembers_earlier_batches(spark, tmp_path):
    base = {"headline": "A headline that will do", "description": "d", "category": "travel", "advertiser_id": "v", "bid_cpm_usd": 1.0, "created_at": "2026-01-01T00:00:00Z"}
    (tmp_path / "in").mkdir()
    files = [[base | {"ad_id": "a"}], [base | {"ad_id": "a", "headline": "Another headline here"}, base | {"ad_id": "b"}, base | {"ad_id": "c", "headline": "A third headline here"}]]
    for n, records in enumerate(files):
        (tmp_path / f"in/{n}").write_text("\n".join(map(json.dumps, records)))
        start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    good = {r["ad_id"] for r in spark.read.parquet(str(tmp_path / "out/accepted")).collect()}
    codes = sorted(r["code"] for r in spark.read.parquet(str(tmp_path / "out/rejected")).collect())
    assert good == {"a", "c"} and codes == ["E010", "E011"]
