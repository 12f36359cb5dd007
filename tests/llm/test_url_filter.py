"""URL filters against a loop over the rules."""

from __future__ import annotations

import random
import re

from stayrate.llm.url_filter import judge_urls

RULES = [
    ("com", "/", "allow"),
    ("com", "", "block"),
    ("a.com", "/x", "block"),
    ("a.com", "/x/", "allow"),
    ("b.a.com", "/x", "block"),
    ("net", "/en/deep/er", "block"),
    ("net", "/en/", "allow"),
    ("net", "/en/", "block"),
    (None, "/", "block"),
]


def expected(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(raw) :]).group()
        host = "".join(c.lower() if c.isascii() else c for c in raw)
    fits = [
        (len(h + p), v == "block", h, h + p, v)
        for h, p, v in RULES
        if h and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_against_all_rules(spark):
    rng = random.Random(1)
    hosts = ["a.com", "B.A.com", "xa.com", "com", "a.net", "net", "É.com", "", "a.com.", "www.b.a.com"]
    paths = ["", "/", "/x", "/x/", "/xy", "/en/", "/en/deep/", "/en/deep/erx/y", "//x", "/é/x"]
    tails = ["", "?q=/x/", "#/x/", "?a#b"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(tails)}" for _ in range(300)]
    urls += [None, "", "a.com/x", "http:/a.com", "x://y://a.com/x", "http://a.com" + "/x" * 500]
    urls += ["http://a.com" + "/" * 1_000_000, "http://" + "b." * 100_000 + "a.com/x/", "http://net/en/" + "/" * 99]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = judge_urls(df, rules).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {
        i: expected(u) for i, u in enumerate(urls)
    }


def test_repeated_rows_clashing_columns_and_empty_tables(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    rows = [(1, "http://a.com/x", "p"), (1, "http://a.com/x", "p"), (None, None, "q")]
    df = spark.createDataFrame(rows, "page_id long, url string, action string")
    df = df.withColumnsRenamed({}).selectExpr("*", "'old' AS verdict", "1 AS suffix")
    got = judge_urls(df, rules)
    assert got.columns == ["page_id", "url", "action", "suffix", "host", "path", "rule", "verdict"]
    assert sorted(r["action"] + r["verdict"] for r in got.collect()) == ["pblock", "pblock", "qallow"]
    assert judge_urls(df.limit(0), rules).collect() == []
    assert {r["verdict"] for r in judge_urls(df, rules.limit(0), default="block").collect()} == {"block"}
