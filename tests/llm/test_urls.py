import re

from tracespool.llm import urltrie
from tracespool.llm.catalog import URL_RULES

URLS = [None, "", "no scheme", "http://", "http://ORG", "http://ORG/", "https://a.Example.ORG/es/x", "https://example.org/es", "https://example.org/en/1",
        "https://x.y.example.org/en/17?q=/es/", "https://example.org/en/2", "https://notexample.org/es/1", "http://com/fr/", "http://a.com/de/1#x",
        "http://a.com:80/de/1", "http://a.com?u=http://b.org/es/", "x://b.org//es/", "http://bad..org/\nq", "ftp://Über.org/é/?", "http://org./"]


def slow(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]):])[0]
    fit = [(len(h.split(".")), len(p), v == "block", v, h + p) for v, h, p in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[4], best[3] if best else "allow"


def test_against_brute_force(spark):
    rules = [*URL_RULES, ("allow", "example.org", "/es/x"), ("block", "example.org", "/es/x"), ("block", "a.com", "")]
    table = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string, path string")
    for some in (URL_RULES, rules):
        got = {r.page_id: tuple(r)[1:] for r in urltrie.filter_urls(table, some).collect()}
        assert got == {i: slow(u, some) for i, u in enumerate(URLS + URLS)}


def test_empty(spark):
    table = spark.createDataFrame([], "page_id long, url string")
    assert urltrie.filter_urls(table, URL_RULES).count() == 0
