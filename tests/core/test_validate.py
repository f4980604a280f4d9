import json
import random

import pytest
from pyspark.sql import functions as F

from larkspur import cli
from larkspur.operators import dedup, report
from larkspur.operators.records import judged
from larkspur.operators.validate import GateError, validate, validate_lines
from larkspur.schema import FATAL, Limits
from larkspur.sources.generate import generate
from larkspur.sources.lines import numbered_lines
from larkspur.streaming.ingest import judge_batch

GOOD = {"ad_id": "a1", "headline": "Warm gloves for the winter", "description": "Wool inside.", "category": "apparel", "advertiser_id": "v1", "bid_cpm_usd": 2.5, "created_at": "2026-02-01T10:00:00Z"}


def line(**change):
    return json.dumps({k: v for k, v in (GOOD | change).items() if v is not ...}, ensure_ascii=False)


FILE = [
    line(),
    line(ad_id="a2", headline="<i>Warm</i>  socks for the winter", bid_cpm_usd="$3.10"),
    '{"ad_id": "a3", ',
    line(ad_id="a4", category=...),
    line(ad_id="a5", headline=["x"]),
    line(ad_id="a6", headline="   "),
    line(ad_id="a7", headline="<b>Deal</b>"),
    line(ad_id="a8", headline="x" * 200),
    line(ad_id="a9", bid_cpm_usd="N/A"),
    line(ad_id="a10", bid_cpm_usd=425.0),
    line(ad_id="a11", category="misc"),
    line(headline="Another headline altogether"),
    line(ad_id="a13"),
    line(ad_id="a14", created_at="yesterday"),
    "",
    line(ad_id="a16", headline="Something else to wear", category="  Apparel "),
]


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("validate")
    (folder / "raw.jsonl").write_text("\n".join(FILE) + "\n", encoding="utf-8")
    return folder, validate(spark, str(folder / "raw.jsonl"), str(folder / "out"))


def test_each_code_once(done):
    _, told = done
    assert told["totals"] == {"read": 15, "accepted": 3, "rejected": 12, "pass_rate": 0.2}
    assert told["rejections_by_code"] == dict.fromkeys(FATAL, 1) | {}
    assert told["warnings_by_code"] == {"W002": 1, "W001": 2, "W005": 1}


def test_files_in_line_order(done):
    folder, _ = done
    clean = [json.loads(x) for x in (folder / "out/ads_clean.jsonl").read_text().splitlines()]
    assert [r["ad_id"] for r in clean] == ["a1", "a2", "a16"]
    assert clean[1]["headline"] == "Warm socks for the winter" and clean[1]["bid_cpm_usd"] == 3.1 and clean[2]["category"] == "apparel"
    rejected = [json.loads(x) for x in (folder / "out/ads_rejected.jsonl").read_text().splitlines()]
    assert [r["line"] for r in rejected] == [3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14]
    assert set(rejected[0]) == {"line", "code", "detail", "record"} and rejected[0]["record"] is None and rejected[1]["record"]["ad_id"] == "a4"


def test_gate_writes_first(spark, done, tmp_path):
    folder, _ = done
    with pytest.raises(GateError):
        validate(spark, str(folder / "raw.jsonl"), str(tmp_path), fail_under=0.5)
    assert (tmp_path / "validation_report.json").exists()


def test_limits_and_limit(spark, tmp_path):
    (tmp_path / "r").write_text("\n".join([line(bid_cpm_usd=80), "", line(ad_id="z", headline="Quite another one")]), encoding="utf-8")
    assert validate(spark, str(tmp_path / "r"), str(tmp_path / "a"))["totals"]["accepted"] == 1
    assert validate(spark, str(tmp_path / "r"), str(tmp_path / "b"), limits=Limits(bid_max=100))["totals"]["accepted"] == 2
    assert validate(spark, str(tmp_path / "r"), str(tmp_path / "c"), limit=2)["totals"]["read"] == 1


def test_empty_file(spark, tmp_path):
    (tmp_path / "r").write_text("")
    assert validate(spark, str(tmp_path / "r"), str(tmp_path / "a"))["totals"] == {"read": 0, "accepted": 0, "rejected": 0, "pass_rate": 1.0}


def test_missing_input(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        validate(spark, str(tmp_path / "none"), str(tmp_path))
    assert cli.main(["validate", "--input", str(tmp_path / "none"), "--out-dir", str(tmp_path)]) == 2


@pytest.mark.parametrize(
    ("change", "code"),
    [
        ({"headline": "x" * 10}, None), ({"headline": "x" * 9}, "E005"), ({"headline": "x" * 120}, None), ({"headline": "x" * 121}, "E006"), ({"description": "y" * 1000}, None), ({"description": "y" * 1001}, "E006"),
        ({"description": None}, None), ({"description": 5}, "E003"), ({"bid_cpm_usd": 50}, None), ({"bid_cpm_usd": 50.01}, "E008"), ({"bid_cpm_usd": 0}, "E008"), ({"bid_cpm_usd": -0.01}, "E008"), ({"bid_cpm_usd": float("nan")}, "E008"),
        ({"bid_cpm_usd": float("inf")}, "E008"), ({"bid_cpm_usd": True}, "E007"), ({"bid_cpm_usd": 10**400}, "E008"), ({"category": ""}, "E009"), ({"category": "APPAREL"}, None), ({"created_at": None}, "E002"), ({"created_at": "now"}, "E012"), ({"ad_id": 7}, "E003"),
    ],
)
def test_boundaries(spark, change, code):
    got = judged(spark.createDataFrame([(1, line(**change))], "line_no long, line string")).select("verdict.code").first()[0]
    assert got == code


@pytest.mark.parametrize(("text", "code"), [("[1]", "E003"), ("null", "E003"), ("3", "E003"), ('{"a": 1} x', "E001"), ('{"ad_id": "\\ud800"}', "E001"), ("{'a': 1}", "E001")])
def test_not_a_record(spark, text, code):
    assert judged(spark.createDataFrame([(1, text)], "line_no long, line string")).select("verdict.code").first()[0] == code


def loop(rows):
    ids, prints, out = set(), set(), {}
    for n, i, p in sorted(rows):
        if i in ids:
            out[n] = "E010"
        elif p in prints:
            out[n] = "E011"
        else:
            ids.add(i)
            prints.add(p)
    return out


@pytest.mark.parametrize("tail", [0, 10**6])
@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_equals_the_loop(spark, seed, tail):
    rng = random.Random(seed)
    rows = [(n, f"i{rng.randrange(60)}", f"p{rng.randrange(60)}") for n in range(150)]
    df = spark.createDataFrame(rows, "line_no long, id string, print string").repartition(3)
    assert {r[0]: r[1] for r in dedup.duplicates(df, tail).collect()} == loop(rows)


def test_dedup_of_a_hot_id(spark):
    rows = [(n, "hot" if n % 10 else f"i{n}", f"p{n % 700}") for n in range(3000)]
    df = spark.createDataFrame(rows, "line_no long, id string, print string").repartition(5)
    assert {r[0]: r[1] for r in dedup.duplicates(df, 0).collect()} == loop(rows)


@pytest.mark.parametrize("seed", range(3))
def test_any_split_into_batches_equals_one_file(spark, tmp_path, seed):
    """Ids and contents repeat across batches; what is rejected reserves nothing."""
    rng = random.Random(seed)
    rows = [(n, line(ad_id=f"i{rng.randrange(12)}", headline=f"A headline, number {rng.randrange(12)}", bid_cpm_usd=rng.choice([1, 99]))) for n in range(60)]
    frame = lambda part: spark.createDataFrame(part, "line_no long, line string")
    whole = validate_lines(frame(rows))
    cuts = sorted(rng.sample(range(1, 60), 3))
    parts = [judge_batch(frame(rows[a:b]), n, str(tmp_path)) for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, 60], strict=True))]
    accepted = sorted(r["line_no"] for p in parts for r in p.accepted.collect())
    assert accepted == sorted(r["line_no"] for r in whole.accepted.collect())
    codes = sorted((r["line_no"], r["code"]) for p in parts for r in p.rejects.collect())
    assert codes == sorted((r["line_no"], r["code"]) for r in whole.rejects.collect())
    again = judge_batch(frame(rows[: cuts[0]]), 0, str(tmp_path))  # a batch that is run again sees only those before it
    assert sorted(r["line_no"] for r in again.accepted.collect()) == [n for n in accepted if n < cuts[0]]


def test_several_files_are_numbered_through(spark, tmp_path):
    for name, text in (("b", "3\n\n5\n"), ("a", "1\n2\n")):
        (tmp_path / name).write_text(text)
    assert sorted(map(tuple, numbered_lines(spark, str(tmp_path)).collect())) == [(1, "1"), (2, "2"), (3, "3"), (4, ""), (5, "5")]


def test_dedup_chain(spark):
    rows = [(1, "i1", "c1"), (2, "i2", "c1"), (3, "i2", "c3")]
    df = spark.createDataFrame(rows, "line_no long, id string, print string")
    assert {r[0]: r[1] for r in dedup.duplicates(df, 0).collect()} == {2: "E011"}


def test_two_key_query_equals_the_loop(spark):
    from larkspur.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars", F.sha2("text", 256)).collect()
    assert {r[0]: r[1] for r in QUERIES["dedup_two_keys"](spark, sf).collect()} == loop([(a, str(b), c) for a, b, c in docs])


def test_lines_keep_their_numbers(spark, tmp_path):
    text = "".join(f"{i}\n" if i % 7 else "\n" for i in range(1, 20_001))
    (tmp_path / "t").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        got = numbered_lines(spark, str(tmp_path / "t")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 20_000 and all(r["line"] == (str(r["line_no"]) if r["line_no"] % 7 else "") for r in got)


def test_generated_defects_are_found(spark, tmp_path):
    told = generate(spark, 1500, 7, str(tmp_path / "ads_raw.jsonl"))
    got = validate(spark, str(tmp_path / "ads_raw.jsonl"), str(tmp_path / "out"))
    assert got["rejections_by_code"] == told["expected_rejections_by_code"] and got["totals"]["accepted"] == told["expected_accepted_total"]
    first = (tmp_path / "ads_raw.jsonl").read_bytes()
    generate(spark, 1500, 7, str(tmp_path / "ads_raw.jsonl"))
    assert (tmp_path / "ads_raw.jsonl").read_bytes() == first
    for name, code in (("report", 0), ("other", 1)):
        if code:
            got["totals"]["accepted"] += 1
        (tmp_path / name).write_text(json.dumps(got))
        assert cli.main(["oracle", "--oracle", str(tmp_path / "expected_defects.json"), "--report", str(tmp_path / name)]) == code


def test_pass_rate_of_nothing():
    assert report.pass_rate(0, 0) == 1.0
