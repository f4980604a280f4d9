import random

import pytest

from larkspur.llm.queries import op3
from larkspur.llm.url_rules import judge

from .helpers import PAGES, SF, rows_of, sql_rows, with_clashes, write


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:end], rest[end:]
    stop = min((rest.index(c) for c in "?#" if c in rest), default=len(rest))
    return "".join(c.lower() if c.isascii() else c for c in host), rest[:stop]


def brute(urls, rules):
    out = []
    for n, u in urls:
        host, path = split(u)
        fits = [(len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        out.append((n, host, path, best and best[1], best[2] if best else "allow"))
    return sorted(out, key=repr)


COLS = ["page_id", "host", "path", "rule", "verdict"]
URLS = ["https://www.example.com/en/a?x#y", "http://EXAMPLE.com/en/", "https://sub.www.example.com/en/x", "https://a.net/es/q", "https://net/fr/z", "https://anet/fr/z", "ftp://x.org/", "no scheme", "", None, "://", "https://example.com?x=/en/", "https://example.com#://b/en/", "a://b://c/d", "https://ÄÖ.net/es/", "https://example.com/EN/", "https://.com/x", "https://com.", "https://x.com\n/en/", "https://example.com/en/\nmore?z"]


def test_agrees_with_sql(spark):
    assert rows_of(op3.run(spark, SF)) == sql_rows(SF, op3.SQL, "pages")


@pytest.mark.parametrize("clash", [False, True])
def test_odd_urls(spark, tmp_path, clash):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(None, URLS[0], "x"), (3, URLS[3], None), (3, URLS[3], None), (99, "https://example.com/en/" + "a" * 50_000, None)]
    folder = write(tmp_path, pages=with_clashes(PAGES, rows) if clash else (PAGES, rows))
    want = brute([(r[0], r[1]) for r in rows], op3.RULES)
    assert rows_of(op3.run(spark, folder), COLS) == want
    assert rows_of(op3.run(spark, folder)) == sql_rows(folder, op3.SQL, "pages")


def test_empty(spark, tmp_path):
    assert op3.run(spark, write(tmp_path, pages=(PAGES, []))).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_random_nested_rules(spark, seed):
    rng = random.Random(seed)
    host = lambda: ".".join(rng.choice(["a", "b", "ab", "c-d", "a0"]) for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "/".join(rng.choice(["p", "q", "pq"]) for _ in range(rng.randint(0, 3)))
    rules = list({(host(), path()): None for _ in range(60)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    urls = [(i, f"http://{host()}{path()}{rng.choice(['', '?x', '#y', '/z'])}") for i in range(400)] + [(1000 + i, "http://a.b/p") for i in range(300)]
    got = judge(spark.createDataFrame(urls, "page_id long, url string").repartition(5), spark.createDataFrame(rules, "host string, path string, action string"))
    # of rules of equal length on the same host and path only one exists; across host and path the name decides
    found = {r["page_id"]: r for r in got.collect()}
    for n, u in urls:
        h, p = split(u)
        fits = [(len(a + b), a + b, c) for a, b, c in rules if (h == a or h.endswith("." + a)) and p.startswith(b)]
        r = found[n]
        assert (r["host"], r["path"]) == (h, p)
        assert len(r["rule"] or "") == max((f[0] for f in fits), default=0)
        assert (r["rule"], r["verdict"]) in {(f[1], f[2]) for f in fits} | ({(None, "allow")} if not fits else set())


def test_odd_rules(spark):
    urls = spark.createDataFrame([(1, "http://a.b/x"), (2, "http://b"), (3, None)], "page_id long, url string")
    rules = spark.createDataFrame([("b", None, "block"), (None, "/", "allow"), ("B", "/x", None), ("A.b", "/x", "y"), ("a.b", "/x", "z")], "host string, path string, action string")
    assert rows_of(judge(urls, rules), COLS) == [(1, "a.b", "/x", "a.b/x", "y"), (2, "b", "", "b", "block"), (3, "", "", None, "allow")]
    assert [r["verdict"] for r in judge(urls, rules.limit(0)).collect()] == ["allow"] * 3


def test_a_host_of_many_labels_and_a_long_path(spark):
    urls = [(1, f"http://{'a.' * 30_000}net/es/{'x' * 1_000_000}"), (2, f"http://{'.' * 20_000}"), (3, f"http://{'é' * 50_000}.www.example.com/en/")]
    df = spark.createDataFrame(urls, "page_id long, url string")
    rules = spark.createDataFrame(op3.RULES, "host string, path string, action string")
    assert rows_of(judge(df, rules), COLS) == brute(urls, op3.RULES)
