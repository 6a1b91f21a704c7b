"""URL rules against every rule tried on every address."""

import random

from pyspark.sql import functions as F

from sheaf.llm import urls

LOW = str.maketrans(urls.UPPER, urls.LOWER)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [rest.index(c) for c in "/?#" if c in rest]
    host = rest[: min(ends, default=len(rest))]
    path = rest[len(host):]
    ends = [path.index(c) for c in "?#" if c in path]
    return host.translate(LOW), path[: min(ends, default=len(path))]


def naive(url, rules):
    host, path = parts(url)
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if h and v and p is not None and (host == h.translate(LOW) or host.endswith("." + h.translate(LOW))) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    best = max(fits)
    return host, path, best[3].translate(LOW) if best[3] != best[3].translate(LOW) else best[3], best[2]


def judged(spark, rows, rules):
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    out = urls.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string"))
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_nested_rules_equal_a_search_of_all(spark):
    rng = random.Random(4)
    labels = ["a", "b", "aa", "a-b", "net", "x!", "Ü", ""]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(["/", "a", "ab/", "é", "\U0010ffff", "/a/"]) for _ in range(rng.randint(0, 5)))
    rules = list({(h, p): (rng.choice(("allow", "block")), h, p) for h, p in ((host(), path()) for _ in range(150))}.values())
    rows = [(i, rng.choice(["http://", "://", "x://y://", ""]) + host().upper() * (i % 3 == 0) + host() + "/" * (i % 2) + path() + rng.choice(["", "?a://b/", "#c"])) for i in range(600)]
    rows += [(9000, "http://a.net/a/ab/")] * 500 + [(9001, None), (None, "http://b.net/a"), (9002, "")]
    assert judged(spark, rows, rules) == sorted(((i, *naive(u, rules)) for i, u in rows), key=repr)


def test_production_rules(spark):
    rows = list(enumerate(["https://blog.example.net/en/5", "http://example.net/de/5", "http://EXAMPLE.net/EN/", "http://notexample.net/en/", "http://net", "http://net/", "http://net?x", "http://internet/", "http://w.org/fr/", "http://org/fr", "https://example.com/de/?q", "nothing"]))
    assert [r[3] for r in sorted(judged(spark, rows, list(urls.RULES)))] == ["example.net/en/", "net/", "net/", "net/", None, "net/", None, None, "org/fr/", None, "example.com/de/", None]


def test_odd_rules_and_tables(spark):
    odd = [("allow", "net", "/"), ("block", "NET", "/"), (None, "net", "/a"), ("block", None, "/"), ("block", "", "/"), ("block", "com", None)]
    rows = [(1, "http://x.net/a"), (1, "http://x.net/a"), (2, "http://x.com/"), (3, "q://")]
    assert judged(spark, rows, odd) == [(1, "x.net", "/a", "net/", "block")] * 2 + [(2, "x.com", "/", None, "allow"), (3, "", "", None, "allow")]
    assert judged(spark, [], odd) == [] and {r[4] for r in judged(spark, rows, [])} == {"allow"}
    df = spark.createDataFrame([(1, "http://x.net/a", "k", 7, None, True)], "page_id long, url string, key string, range int, host string, is_url boolean")
    assert urls.judge(df, spark.createDataFrame(urls.RULES, "verdict string, host string, path string"), default="keep").collect() == [(1, "x.net", "/a", "net/", "block")]


def test_a_common_address_fills_several_ranges(spark):
    pages = spark.createDataFrame([(i, "http://hot.example.net/en/1" if i % 3 else f"http://h{i}.com/") for i in range(6000)], "page_id long, url string").repartition(4)
    keyed = pages.select(urls.host_key(urls.host_of(F.col("url"))).alias("key"), urls.path_of(F.col("url")).alias("path"), F.rand(1).alias("salt"))
    borders = urls._borders(keyed, 16)
    assert len(borders) >= 12 and sum(b[0] == b"net/example/hot/" for b in borders) >= 7
