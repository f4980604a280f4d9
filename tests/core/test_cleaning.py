import math

import pytest

from larkspur.functions import cleaning as C


@pytest.mark.parametrize(
    ("given", "text", "codes"),
    [
        ("plain words", "plain words", []),
        ("  two \n\t gaps ", "two gaps", ["W001"]),
        ("a<b>x</b><i>y</i>", "a x y", ["W002", "W001"]),
        ("salt &amp; pepper", "salt & pepper", ["W002"]),
        ("&lt;b&gt; stays", "<b> stays", ["W002"]),
        ("zero​width", "zerowidth", ["W004"]),
        ("wide！", "wide!", ["W003"]),
        ("&#xFF01;", "！", ["W002"]),
        ("a\x0bb", "ab", ["W004"]),
        ("&nbsp;", "", ["W002", "W001"]),
        ("3 < 5 and 6 > 2", "3 2", ["W002", "W001"]),
        ("", "", []),
    ],
)
def test_clean_one(given, text, codes):
    assert C.clean_one(given) == (text, codes)


@pytest.mark.parametrize(
    ("given", "bid", "codes"),
    [(4.25, 4.25, []), (4, 4.0, []), (-3.0, -3.0, []), ("4.25", 4.25, ["W005"]), ("$4.25", 4.25, ["W005"]), ("1,250.00", 1250.0, ["W005"]), ("1_000", 1000.0, ["W005"]), (True, None, []), ("N/A", None, []), ("4d", None, []), ("", None, []), ([1], None, []), ({}, None, []), (None, None, [])],
)
def test_read_bid(given, bid, codes):
    assert C.read_bid(given) == (bid, codes)


def test_read_bid_beyond_double():
    assert C.read_bid(10**400) == (math.inf, [])


@pytest.mark.parametrize(
    ("given", "time", "codes"),
    [
        ("2026-03-14T09:21:00Z", "2026-03-14T09:21:00Z", []),
        ("2026-03-14T09:21:00+02:00", "2026-03-14T07:21:00Z", ["W007"]),
        ("2026-03-14T09:21:00", "2026-03-14T09:21:00Z", ["W007"]),
        (" 2026-03-14T09:21:00Z", "2026-03-14T09:21:00Z", ["W007"]),
        ("20260314", "2026-03-14T00:00:00Z", ["W007"]),
        ("14/03/2026", None, []), ("yesterday", None, []), ("2026-13-01", None, []), ("", None, []), ("0001-01-01T00:00:00+05:00", None, []),
    ],
)
def test_read_time(given, time, codes):
    assert C.read_time(given) == (time, codes)


def test_native_steps_agree_with_the_chain(spark):
    from pyspark.sql import functions as F

    texts = ["a<b>x</b>", " x\t\ny ", "c​d\x07", "no-break\xa0space", "plain", "", "<" + "z" * 201 + ">"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = rows.select("t", C.collapse_space(C.remove_controls(C.strip_tags(t))).alias("x"), C.clean_text("t")["text"].alias("y")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["x"] == r["y"], repr(r["t"])


def test_fingerprint_folds_case_only(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("Buy now!", "ẞ"), ("BUY NOW!", "ss"), ("Buy now!!", "ss")], "h string, d string")
    a, b, c = (r[0] for r in rows.select(C.fingerprint(F.col("h"), F.col("d"))).collect())
    assert a == b != c
