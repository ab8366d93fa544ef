from itertools import product
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import predicates as p, urls
from weftgraph.sources import html, sinks, tables

SCHEMES = {"http": "http", "HtTpS": "https"}
AUTHORITIES = {"shop.test": "shop.test", "ann:pw@SHOP.test": "shop.test", "Shop.Test..": "shop.test", "[2001:DB8::7]": "[2001:db8::7]"}
PORTS = {"": ("", ""), ":80": ("", ":80"), ":443": (":443", ""), ":9090": (":9090", ":9090")}  # kept under http, https
PATHS = {"": "/", "/": "/", "/Stock/Item/": "/Stock/Item/", "/a%20b": "/a%20b"}
QUERIES = {"": "", "?": "", "?z=1&m=2&z=0": "?m=2&z=1&z=0", "?Src_Ad=9&k=": "?k=", "?amp;src_ad=9&amp;AMP;b=1&a=2": "?a=2&b=1", "?x=a b&y=%C3%A9": "?x=a+b&y=%C3%A9"}


def test_normal_url_over_all_parts():
    for (scheme, s), (host, h), (port, kept), (path, at), (query, q), end in product(SCHEMES.items(), AUTHORITIES.items(), PORTS.items(), PATHS.items(), QUERIES.items(), ("", "#part")):
        raw, expected = f" {scheme}://{host}{port}{path}{query}{end}\n", f"{s}://{h}{kept[s == 'https']}{at}{q}"
        assert urls.normal_url(raw, None, ("SRC_*",)) == expected, raw
        assert urls.normal_url(expected, None, ("src_*",)) == expected


@pytest.mark.parametrize("raw", [None, "", " \n", "sms:5", "about:blank", "ws://shop.test/", "http://", "https:///only/path", "http://shop.test:port/", "http://shop.test:99999/", "http://[::1/", "no scheme"])
def test_no_page(raw):
    assert urls.normal_url(raw) is None


def test_relative_urls_and_parameters():
    for relative in ("deep/er", "../side", "/from/root", "?only=query", "//else.test/x", "", "./"):
        plain = urljoin("http://shop.test/one/two", relative) if relative else None
        assert urls.normal_url(relative, "http://shop.test/one/two") == plain
    assert urls.captured("/go?amp;Tag=%20;,FIRST_7%20&tag=second&other=,", ("tAg", "other", "none")) == {"tAg": "FIRST_7"}
    assert urls.captured(None, ("a",)) == {} and urls.captured("http://[bad?a=1", ("a",)) == {}


def test_given_urls(spark):
    rows = [
        ("shop.test", "https://shop.test/", "https://shop.test"),
        ("//Shop.test/A/", "https://shop.test/a/", "https://shop.test/A"),
        (" HTTP://u:p@Shop.Test.:8080/Buy//?q=1#x", "http://shop.test/buy//", "http://shop.test/Buy"),
        ("ftp://shop.test/x", "https://shop.test/x", "ftp://shop.test/x"),
        ("shop.test/?to=http://other.test", None, None),
        ("https://shop.test/LPeditor/1", None, "https://shop.test/LPeditor/1"),
        ("Null", None, "https://null"),
        ("", None, None),
        (None, None, None),
    ]
    frame = spark.createDataFrame([(u,) for u, *_ in rows], "u string")
    got = frame.select(urls.conversion_url(F.col("u")).alias("c"), urls.seed_url(F.col("u")).alias("s")).collect()
    assert [(r["c"], r["s"]) for r in got] == [(c, s) for _, c, s in rows]
    hosts = spark.createDataFrame([("https://me@WWW.Shop.test.:1/x",), ("https://[::1]:2/",), ("x",)], "u string").select(urls.host_of(F.col("u"))).collect()
    assert [r[0] for r in hosts] == ["www.shop.test", "::1", ""]


def test_columns(spark):
    row = spark.createDataFrame([("https://X.com/us/en/Track.html?a=1", "https://a.linkedin.com/feed/activity-7312345678901234567", " TAG_RETAIL_654321")], "u string, p string, t string")
    got = row.select(
        urls.section_of(F.col("u"), ("/us/en/",)), urls.page_type_of(F.col("u"), F.array().cast("array<string>"), F.lit(False), F.lit("track")), urls.host_of(F.col("u")),
        urls.conversion_url(F.col("u")), urls.is_post(F.col("p")), urls.post_date(F.col("p")).cast("string"), urls.strip_suffix(urls.clean_tag(F.col("t"))),
        urls.archetype_of(F.lit("TAG_BIG_SHOP_1"), r"TAG_(?P<archetype>[A-Z_]+?)_\d"),
    ).first()
    assert tuple(got) == ("track", "tool", "x.com", "https://x.com/us/en/track.html", True, "2025-03-31", "TAG_RETAIL", "BIG SHOP")


def test_robots():
    text = "# first\nUser-Agent : Crow # bird\nuser-agent:jay\nsitemap: s\nDisallow: /nest\nAllow: /nest/old$\nDisallow:\nCrawl-delay: 3\nuser-agent: *\nno colon\nDisallow: /\n"
    allowed = lambda path, bot: p._allowed("https://h" + path, p.robots_rules(text, bot))
    assert [allowed(x, "Big-Crow/2") for x in ("/nest/old", "/nest/older", "/sky", "/robots.txt")] == [True, False, True, True]
    assert not allowed("/sky", "owl") and allowed("/robots.txt", "owl")
    assert [p.robots_named(text, bot) for bot in ("CrowBot", "bluejay", "cro", "*")] == [True, True, False, False]
    assert [(b, named) for b, named, _ in p.robots_ai_rules("User-agent: GPT\nDisallow: /\n", "https://h", ("GPTBot", "CCBot"))] == [("GPTBot", True), ("CCBot", False)]
    assert p.robots_groups("") == [] and p.robots_rules("Disallow: /x", "a") == []


def test_states(spark):
    rows = [(404, "x", ""), (200, " 404 gone", ""), (200, "Page Not Found", ""), (200, "t", "This page no longer exists"), (403, "t", ""), (200, "Just a moment", ""), (200, None, "fine")]
    frame = spark.createDataFrame(rows, "s int, t string, b string")
    got = frame.select(p.detect_dead(F.col("s"), F.col("t"), F.col("b")).alias("d"), p.detect_block(F.col("s"), F.col("t"), F.col("b")).alias("b")).collect()
    assert [r["d"] is not None for r in got] == [True, True, True, True, False, False, False]
    assert [r["b"] is not None for r in got] == [False, False, False, False, True, True, False]


def test_globs(spark):
    win = p.Win(url_patterns=("*/Contact?us*", "re:https://x\\.com/[a-c]+"), exclude_patterns=("*no*",), classes=(p.WinClass("buy", ("https://x.com/shop",), False),))
    frame = spark.createDataFrame([("https://x.com/a/Contact-us/b",), ("https://x.com/abc",), ("https://x.com/abcd",), ("https://x.com/abc/no",), ("https://x.com/shop/1",)], "u string")
    got = frame.select(win.matches(F.col("u")).alias("m"), win.destination(F.col("u")).alias("d")).collect()
    assert [(r["m"], r["d"]) for r in got] == [(True, True), (True, True), (False, False), (False, False), (False, True)]


def test_html():
    page = """<html><head><base href="/b/"><title> A  B </title><script type="application/ld+json">{"@type":"BreadcrumbList","itemListElement":[
    {"position":10,"name":"Ocean"},{"position":"2","name":"Services"},{"position":1,"item":{"name":"Home"}}]}</script><script type="application/ld+json">{x</script></head>
    <body><header><a href="h">Head</a></header><nav><ul><li>Services<ul><li><a href="o">Ocean</a></li></ul></li></ul></nav>
    <article><header><a href="in"><img alt="Pic"></a></header><p>one<p>two <a href="mailto:x">mail</a></article><div role="contentinfo"><a href="f" title="T"></a></div><h1></h1><h1>Hi</h1></body></html>"""
    root = html.parse(page)
    links = [(x["url"], x["text"], x["region"]) for x in html.links_of(root, "https://x.com/p")]
    b = "https://x.com/b/"
    assert links == [(b + "h", "Head", "header"), (b + "o", "Ocean", "nav"), (b + "in", "Pic", "body"), (None, "mail", "body"), (b + "f", "T", "footer")]
    found = html.page_of(root, "https://x.com/p")
    assert found["breadcrumb"] == ["Home", "Services", "Ocean"] and found["title"] == "A B" and (found["h1_count"], found["h1_empty_count"]) == (1, 1)
    assert found["jsonld_types"] == ["BreadcrumbList", html.INVALID_JSONLD] and {"parent": "Services", "label": "Ocean"} in found["nav_labels"]


def test_lead_file_guards(spark):
    ok = spark.createDataFrame([(" ,TAG_1", "1,200", "https://X.com/Buy?q=1"), ("", "3", None)], "wt_mc_id string, leads_most_recent_tag string, main_conversion_page string")
    rows = {r["lead_tag"]: (r["leads"], r["page"]) for r in tables.checked_leads(ok).collect()}
    assert rows == {"TAG_1": (1200.0, "https://x.com/buy"), None: (3.0, None)}
    for bad in ("wt_mc_id string, leads_most_recent_tag string, user_id string", "wt_mc_id string, other string, x string"):
        with pytest.raises(tables.LeadFileError):
            tables.checked_leads(spark.createDataFrame([("a", "1", "x")], bad))
    with pytest.raises(tables.LeadFileError):
        tables.checked_leads(spark.createDataFrame([("a@b.c", "1")], "wt_mc_id string, leads_most_recent_tag string"))


def test_sinks():
    text = "".join(sinks.graphml([{"id": "a", "d": 1}, {"id": "b<", "d": None}], [{"source": "a", "target": "b<", "op": True}]))
    assert '<data key="d0">-1</data>' in text and 'id="b&lt;"' in text
    assert sinks.mermaid({"x": ["u", "v"]}).splitlines()[-1] == "  n0 --> n1"
    assert tables.read_sitemaps({"s": "<sitemapindex><loc>t</loc></sitemapindex>", "t": "<urlset><loc> u </loc><loc>u</loc></urlset>"}, "s") == (["u"], True)


def test_sitemap_limits_are_told(monkeypatch):
    files = {"s": "<sitemapindex><loc>t</loc><loc>v</loc></sitemapindex>", "t": "<urlset><loc>a</loc><loc>b</loc></urlset>", "v": "<urlset><loc>c</loc></urlset>"}
    assert tables.read_sitemaps(files, "s") == (["a", "b", "c"], True)
    monkeypatch.setattr(tables, "MOST_URLS", 1)
    assert tables.read_sitemaps(files, "s") == (["a"], False)
    monkeypatch.setattr(tables, "MOST_SITEMAPS", 1)
    assert tables.read_sitemaps(files, "s") == ([], False)


def test_headers():
    assert tables.seed_columns(["Link URL", "Final-URL", "Post  URL", "Seed", "landing page", "note"]) == {"seed_url": "Post  URL", "outbound_url_raw": "Link URL", "outbound_resolved_url": "landing page"}
    with pytest.raises(tables.SeedFileError):
        tables.seed_columns(["title"])
    assert tables.personal_columns(["Lead ID", "E-Mail", "leads", "IP address", "page"]) == ["Lead ID", "E-Mail", "IP address"]
