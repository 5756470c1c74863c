from __future__ import annotations

import re

from opsgauge.llm.url_filter import RULES, alias_links, url_verdicts

SCHEMA = "page_id bigint, url string, html string, host int, root string"


def pages_of(spark, rows):
    return spark.createDataFrame([(at, url, html, 1, "x") for at, (url, html) in enumerate(rows)], SCHEMA)


def own_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), v == "allow", h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, None))
    return host, path, best[2], best[3]


def test_rules(spark):
    urls = [
        "http://A.Example.ORG/es/x", "https://example.org/en/12?q", "https://example.org/en/2", "http://org", "http://org/",
        "http://x.com/fr/", "http://x.com/de/1#a", "http://com/de/", "http://xcom/de/", "http://x.net/de/", "no scheme", None, "",
        "://", "a://b://c.org/", "http://notexample.org/es/", "http://x.com?/fr/", "http://Ünï.org/a b", "http://x.com\n/fr/",
    ]
    found = url_verdicts(pages_of(spark, [(url, None) for url in urls])).collect()
    for row in found:
        host, path, rule, verdict = own_rule(urls[row.id])
        assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict or "allow"), urls[row.id]


def page(canonical=None, refresh=None):
    html = "<html><head>"
    if canonical:
        html += f'<LINK data-x="1" rel="canonical" href="{canonical}">'
    if refresh:
        html += f"<meta http-equiv='refresh' content='0; URL={refresh}'>"
    return html + "</head><body>text</body></html>"


def test_blocks_reach_aliases_unless_one_is_allowed(spark):
    rows = [
        ("http://a.net/1", page("http://a.net/2")),
        ("http://a.net/2", page(refresh="http://b.com/de/x")),
        ("http://a.net/3#top", page("/1")),
        ("http://c.net/1", page("http://d.com/de/1")),
        ("http://c.net/2", page("http://c.net/1", "http://e.com/fr/9")),
        ("http://f.net/dir/page", page("other?x=1&amp;y=2")),
        ("http://f.net/dir/other?x=1&y=2", None),
        ("http://f.net/dir/other", page("//g.com/de/")),
        ("https://a.net/2#x", None),
        ("http://alone.net/", page("http://alone.net/")),
    ]
    found = {row.id: (row.verdict, row.alias_of) for row in url_verdicts(pages_of(spark, rows)).collect()}
    assert [found[at][0] for at in range(10)] == [
        "block", "block", "block", "allow", "allow", "allow", "allow", "block", "block", "allow"
    ]
    assert len({found[at][1] for at in (0, 1, 2, 8)}) == 1 and found[5][1] == found[6][1] != found[7][1]


def test_addresses_without_a_host_connect_nothing(spark):
    rows = [
        ("http://b.com/de/1", page("http://")),
        ("http://b.com/de/2", page("http:///x")),
        (None, None),
        ("no scheme", page("http://b.com/de/1")),
        ("http://", page("http://b.com/de/1")),
        ("http:///x", None),
        ("http://?q", page(refresh="http://b.com/de/3")),
    ]
    links = spark.createDataFrame([(None, "http://b.com/de/1"), ("http://b.com/de/2", "x")], "a string, b string")
    found = url_verdicts(pages_of(spark, rows), links=links).collect()
    assert {row.id: row.verdict for row in found} == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "allow"}
    assert all(row.n_aliases_blocked == 0 for row in found)


def test_given_redirects_and_explicit_rules(spark):
    links = spark.createDataFrame([("http://x.net/", "http://y.com/de/"), (None, "http://q.net/")], "a string, b string")
    rows = [("http://x.net/", None), ("http://y.com/fr/", None), ("http://y.com/de/", None)]
    found = url_verdicts(pages_of(spark, rows), links=links).collect()
    assert {row.id: row.verdict for row in found} == {0: "block", 1: "allow", 2: "block"}


def test_empty_table_repeated_rows_and_many_aliases(spark):
    assert url_verdicts(pages_of(spark, [])).count() == 0
    rows = [(f"http://s{at}.net/", page("http://hub.com/de/")) for at in range(200)] * 2
    found = url_verdicts(pages_of(spark, rows)).collect()
    assert len(found) == 400 and {row.verdict for row in found} == {"block"}
    assert alias_links(pages_of(spark, [("http://a.net/", page() + "x" * 2_000_000)])).count() == 0
