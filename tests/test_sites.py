import pytest

from weftgraph.functions import predicates as p
from weftgraph.operators import sites as s

PAGE = "url string, status string, win boolean, is_dead boolean, h1_count int, jsonld_types array<string>"
LINK = "src string, url string, region string, in_scope boolean, operator boolean"


def site(spark, base, pages, links, **more):
    rows = [(base + u, st, False, dead, h1, types) for u, st, dead, h1, types in pages]
    tables = {
        "pages": spark.createDataFrame(rows, PAGE),
        "links": spark.createDataFrame([(base + a, base + b, r, True, False) for a, b, r in links], LINK),
        "aliases": spark.createDataFrame([], "url string, final_url string"),
    }
    return s.Site(tables, base, p.Win(url_patterns=("*/buy",)), **more)


@pytest.fixture
def two(spark):
    one = [("", "ok", False, 1, ["WebSite"]), ("shop/a", "ok", False, 1, None), ("shop/b", "http_error", None, 2, None), ("old", "ok", True, 1, None), ("buy", "not_fetched", None, None, None), ("news/x", "ok", None, 0, None)]
    links = [("", "shop/a", "body"), ("", "buy", "nav"), ("shop/a", "shop/b", "body"), ("shop/b", "buy", "body"), ("shop/a", "buy", "footer"), ("news/x", "", "body"), ("old", "shop/a", "body")]
    # the second site has the same addresses, but for what leads to its win
    other = [(a, b, r) for a, b, r in links if b != "buy"] + [("news/x", "buy", "body")]
    base = "https://s.test/"
    return {"one": site(spark, base, one, links), "two": site(spark, base, one, other, slices=("https://s.test/(shop|news)/",))}


def test_pages_are_measured_by_site(two):
    found = {(r["site"], r["url"].removeprefix("https://s.test/")): r for r in s.measured_pages(two).collect()}
    assert set(found) == {("one", ""), ("one", "shop/a"), ("one", "shop/b"), ("one", "news/x"), ("two", "shop/a"), ("two", "shop/b"), ("two", "news/x")}
    get = lambda *key: tuple(found[key][c] for c in ("win_all", "win_body", "home_all", "home_body", "inbound_live"))
    assert get("one", "") == (1, 3, 0, 0, 1) and get("one", "shop/a") == (1, 2, 1, 1, 1) and get("one", "shop/b") == (1, 1, 2, 2, 1) and get("one", "news/x") == (2, 4, None, None, 0)
    assert get("two", "shop/a") == (None, None, 1, 1, 0) and get("two", "news/x") == (1, 1, None, None, 0)
    assert found["one", "shop/a"]["section"] == "shop" and found["one", "news/x"]["page_type"] == "content" and found["one", ""]["structured_data"] and not found["one", "shop/b"]["one_h1"]


def test_tables_of_a_comparison(spark, two, tmp_path):
    found = s.comparison(two)
    far = {(r["site"], r["way"]): (r["pages"], r["reached"], r["p50"], r["deepest"]) for r in found["distances"].collect()}
    assert far["one", "all_links"] == (4, 4, 1, 2) and far["one", "content_only"] == (4, 4, 2, 4) and far["two", "all_links"] == (3, 1, 1, 1) and far["two", "from_home"] == (3, 2, 1, 2)
    gaps = {(r["site"], r["figure"]): (r["value"], r["base"], r["difference"]) for r in found["differences"].collect()}
    assert gaps["two", "structured_data"] == (0.0, 25.0, -25.0) and gaps["one", "one_h1"] == (50.0, 50.0, 0.0)
    s.write_comparison(found, f"file://{tmp_path}/out")
    back = spark.read.csv(f"file://{tmp_path}/out/sections", header=True)
    assert sorted((r["site"], r["section"], r["pages"]) for r in back.collect()) == [("one", "(home)", "1"), ("one", "news", "1"), ("one", "shop", "2"), ("two", "news", "1"), ("two", "shop", "2")]
