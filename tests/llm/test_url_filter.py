from quadloom.llm import url_filter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("same.org", "/a", "allow"), ("same.org", "/a", "block"), (None, "/", "block")]
URLS = [None, "", "no scheme", "http://a.com/x", "HTTP://WWW.Example.COM/en/x?q#f", "https://b.example.com/en/", "https://example.com/en", "https://notexample.com/en/", "http://x.net/es/1", "http://net/fr/", "http://x.net/ES/", "http://same.org/ab", "http://u@x.com:80/en/", "a://b://c.com/d", "http://.com/", "http://example.com", "http://x.com?y=http://example.com/en/", "http://x.net\n/es/", "http://a.b.c.d.e.f.example.com/en/" + "y" * 5000, "http://x.net/es/1"]


def brute(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), v, h + p) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best and best[2], best[1] if best else "allow")


def test_against_brute_force(spark, monkeypatch):
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(URLS)], "page_id long, url string, host string, _prefix string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    for bound in (200_000, 0):  # broadcast, and not
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", bound)
        got = {r[0]: tuple(r)[1:] for r in url_filter.judged(pages, rules).collect()}
        assert got == {k: brute(u) for k, u in enumerate(URLS)}


def test_repeated_rows_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")] * 3 + [(1, "http://x.net/es/"), (None, None)], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert sorted((r["page_id"], r["rule"]) for r in url_filter.judged(pages, rules).collect() if r["page_id"]) == [(1, "com/")] * 3 + [(1, "net/es/")]
    assert url_filter.judged(pages.limit(0), rules).count() == 0
    got = url_filter.judged(pages, rules.limit(0), default="block").collect()
    assert {r["verdict"] for r in got} == {"block"} and len(got) == 5
