"""Url rules against a plain loop over all rules."""

import random
import re

from statloom.llm import urls


def brute(url, rules, default="allow"):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for h, p, v in rules:
        if h and (host == h or host.endswith("." + h)) and path.startswith(p or ""):
            key = (len(h) + len(p or ""), len(h), [-ord(c) for c in v])
            if best is None or key > best[0]:
                best = (key, h + (p or ""), v)
    return host, path, best[1] if best else None, best[2] if best else default


def test_against_all_rules(spark, monkeypatch):
    monkeypatch.setattr(urls, "RANGE", 50)
    rnd = random.Random(5)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "x.org", "y.x.org", "ba.com", "com", "a-b.com", "z.net", "LOUD.Net"]
    paths = ["/", "/en/", "/en/7", "/en/78/x", "/de/", "", "/d", "/en/7?q=/de/", "#/en/"]
    rules = [(rnd.choice(hosts).lower(), rnd.choice(paths[:7]), rnd.choice(["allow", "block"])) for _ in range(25)] + [("", "/", "block"), (None, "/", "block"), ("a.com", None, "block")]
    pages = [(i, f"http{'s' * (i % 2)}://{rnd.choice(hosts)}{rnd.choice(paths)}") for i in range(400)]
    pages += [(i + 1000, "https://c.b.a.com/en/7") for i in range(300)]  # a hot url
    pages += [(None, "http://a.com/en/"), (5000, None), (5001, "no scheme/en"), (5002, "x://"), (5003, "http://a.com" + "/long" * 20000), pages[0]]
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()), key=repr)
    assert got == sorted(((i, *brute(u, rules)) for i, u in pages), key=repr)


def test_nothing(spark):
    none = spark.createDataFrame([], "page_id long, url string, rule string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert urls.judge(none, rules).count() == 0
    one = urls.judge(spark.createDataFrame([(1, "http://a/b")], "page_id long, url string"), rules).first()
    assert (one.host, one.path, one.rule, one.verdict) == ("a", "/b", None, "allow")
