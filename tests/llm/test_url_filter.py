"""Rules against a plain loop, the cascade against a set."""

import random

from pyspark.sql import functions as F

from plumbline.llm import url_filter as uf

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def judge(url, blocked):
    host, path = parts(url)
    best = None
    for said, h, p in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (said, h + p)
    if best:
        return host, path, best[1], best[0]
    return host, path, None, "block" if host in blocked else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://ORG", "https://a.ORG/x", "https://example.org/es/1?q#f", "https://x.example.org/en/12",
    "https://example.org/en/2", "http://notexample.org/es/", "http://a.com/fr/", "http://a.com/de/x", "http://a.com?x=/de/", "http://b.com#/de/",
    "ftp://É.net/path://more", "http://c.net/a\nb?c", "http://d.net" + "/x" * 5000, "http://.com/fr/", "http://a.com://de/",
]


def test_verdicts(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS * 2)] + [(None, "http://c.net/", "x")]
    urls = spark.createDataFrame(rows, "id long, url string, host string").repartition(3)
    blocked = {"c.net", "a.com", "é.net", "É.net", "unseen.net"}
    listed = spark.createDataFrame([(b,) for b in [*blocked, "c.net", None, ""]], "key string")
    got = uf.judge_urls(urls, RULES, listed).collect()
    assert len(got) == len(rows)
    for r in got:
        url = "http://c.net/" if r["id"] is None else rows[r["id"]][1]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judge(url, blocked)


def keys(spark, n, seed):
    draw = random.Random(seed)
    universe = [f"host{i}.net" for i in range(n)]
    listed = set(draw.sample(universe, n // 5))
    return universe, listed


def test_cascade_is_exact_over_its_universe(spark):
    universe, listed = keys(spark, 4000, 2)
    rows = spark.createDataFrame([(u,) for u in universe * 2] + [(None,)], "key string").repartition(4)
    given = spark.createDataFrame([(u,) for u in listed], "key string")
    cascade = uf.build_cascade(given, rows)
    got = cascade.test(rows).collect()
    assert len(got) == 2 * len(universe) + 1
    assert all(r["listed"] == (r["key"] in listed) for r in got)
    assert len(cascade.levels) > 1  # level 0 alone is not exact
    assert cascade.bytes * 8 < 3 * uf.BITS_PER_KEY * len(listed)


def test_shards_give_the_same(spark):
    universe, listed = keys(spark, 500, 3)
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(universe)] + [(None, None)], "id long, key string")
    given = spark.createDataFrame([(u,) for u in listed], "key string")
    for shards in (1, 3):
        got = uf.listed_keys(rows, given, shards).collect()
        assert len(got) == 501 and all(r["listed"] == (r["key"] in listed) for r in got)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "key string")
    some = spark.createDataFrame([("a",), ("b",)], "key string")
    assert {r["listed"] for r in uf.listed_keys(some, none).collect()} == {False}
    assert {r["listed"] for r in uf.listed_keys(some, some).collect()} == {True}
    assert uf.listed_keys(none, some).count() == 0
    empty = spark.createDataFrame([], "id long, url string")
    assert uf.judge_urls(empty, RULES, some.select(F.col("key"))).count() == 0
