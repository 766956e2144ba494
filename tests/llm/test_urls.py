from __future__ import annotations

from ledgerloom.llm.queries import URL_RULES, op6_url_filters
from ledgerloom.llm.urls import url_verdicts


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = rest[: min([i for i, c in enumerate(rest) if c in "?#"], default=len(rest))]
    fits = [(len(h + p), len(h), a == "block", h + p, a) for h, p, a in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_matches_brute_force(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    found = op6_url_filters(spark, "/root/testdata/sf0.001").collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found} == {k: brute(u, URL_RULES) for k, u in pages.items()}


def test_edge_urls(spark):
    rules = [*URL_RULES, ("a.b.net", "/x", "allow"), ("NET", "/xy", "allow"), ("net", "", "block"), ("org", "/fr/", "block")]
    urls = [
        None, "", "no scheme", "http://", "http:///p", "HTTP://WWW.Example.NET/en/a?b#c", "http://net/", "http://net", "http://net?x", "http://subnet/",
        "http://a.b.net/x", "http://z.a.b.net/xyz", "http://b.net/xy", "x://y://example.com/de/", "http://example.com/de", "http://u.org/fr/#f", "http://.org/fr/",
        "http://ÄB.org/fr/ä\n?q", "http://a.b.net:80/x", "http://" + "s." * 300 + "net/" + "p/" * 20000,
    ]
    rows = [(n, u, "h", "mine") for n, u in enumerate(urls)] + [(7, urls[7], "h", "mine"), (None, urls[10], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule string")
    table = spark.createDataFrame(rules, "host string, path string, action string")
    got = sorted((r.page_id is None, r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in url_verdicts(pages, table).collect())
    lowered = [("".join(c.lower() for c in h), p, a) for h, p, a in rules]
    want = sorted((n is None, n or 0, *brute(u, lowered)) for n, u, *_ in rows)
    assert [(*w[:4], w[4], w[5]) for w in want] == got
    assert url_verdicts(pages.limit(0), table).count() == 0
    assert {(r.rule, r.verdict) for r in url_verdicts(pages, table.limit(0)).collect()} == {(None, "allow")}


def test_no_python_on_executors(spark):
    df = op6_url_filters(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
