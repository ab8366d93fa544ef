import pytest

from weftgraph.functions.predicates import Win
from weftgraph.operators import graph as g
from weftgraph.operators.store_graph import graph_from_store

X = "https://x.com/"
PAGE = "url string, status string, win boolean, win_source string, form_present boolean"
LINK = "src string, url string, region string, in_scope boolean, operator boolean"
#: F3: start links to old, an alias of win, to gone, which is offsite, to next and off scope; an operator link leads from wall to win.
PAGES = [("start", "ok", False, None, None), ("win", "ok", True, "form", True), ("gone", "offsite", False, None, None), ("wall", "skipped", False, None, None)]
LINKS = [("start", "old", "body", True, False), ("start", "gone", "body", True, False), ("start", "next", "nav", True, False), ("start", "off", "body", False, False), ("start", None, "body", True, False), ("wall", "win", "operator", True, True)]


def build(spark, pages, links, win=None, **more):
    full = lambda u: u and X + u
    tables = spark.createDataFrame([(full(u), *r) for u, *r in pages], PAGE), spark.createDataFrame([(full(s), full(u), *r) for s, u, *r in links], LINK)
    graph = graph_from_store(*tables, spark.createDataFrame([(X + "old", X + "win")], "url string, final_url string"), win, **more)
    return graph, {r["url"].removeprefix(X): r for r in graph.nodes.collect()}


def test_redirects_offsite_pages_and_scope(spark):
    graph, nodes = build(spark, PAGES, LINKS)
    assert {n: r["explored"] for n, r in nodes.items()} == {"start": True, "win": True, "next": False, "wall": False}
    edges = {(r["src"].removeprefix(X), r["dst"].removeprefix(X)): (r["regions"], r["operator"]) for r in graph.edges.collect()}
    assert edges == {("start", "win"): (["body"], False), ("start", "next"): (["nav"], False), ("wall", "win"): ([], True)}
    _, kept = build(spark, PAGES, LINKS, Win(url_patterns=("*/off",)))
    assert kept["off"]["win"] and kept["off"]["win_source"] == "pattern" and not kept["off"]["explored"]


def test_wins_that_were_not_loaded(spark):
    pages = [("start", "ok", False, None, None), ("win-1", "robots", False, None, None), ("other", "ok", False, None, None)]
    links = [("start", "win-1", "body", True, False), ("other", "win-2", "body", True, False)]
    graph, nodes = build(spark, pages, links, Win(url_patterns=("*/win-*",)))
    assert {n: (r["win_source"], r["explored"]) for n, r in nodes.items() if r["win"]} == {"win-1": ("pattern", False), "win-2": ("pattern", False)}
    assert sorted(r["d"] for r in g.distances_to_win(graph, ("all_links",)).collect()) == [0, 0, 1, 1]


@pytest.mark.parametrize("require_form", [True, False])
def test_required_forms(spark, require_form):
    pages = [("win-1", "ok", False, None, False), ("win-2", "robots", False, None, None), ("win-3", "ok", False, None, None)]
    _, nodes = build(spark, pages, [], Win(url_patterns=("*/win-*",)), require_form=require_form)
    assert {n: r["win"] for n, r in nodes.items()} == {"win-1": not require_form, "win-2": True, "win-3": True}


def test_known_pages_and_exclusions(spark):
    known = tuple((X + u, kind) for u, kind in (("form", "quote"), ("linked", "call"), ("preview/form", "quote")))
    pages = [("linked", "ok", False, None, None), ("preview/a", "ok", True, "form", None), ("preview/b", "ok", True, "operator", None), ("win", "ok", True, "form", None)]
    _, nodes = build(spark, pages, [], Win(name="contact", url_patterns=("*/win",), known_pages=known, exclude_patterns=("*/preview/*",)))
    assert {n: (r["win"], r["win_source"], r["win_type"], r["explored"]) for n, r in nodes.items()} == {
        "form": (True, "known", "quote", False),
        "linked": (True, "known", "call", True),
        "preview/a": (False, None, None, True),
        "preview/b": (True, "operator", "operator", True),
        "win": (True, "form", "contact", True),
    }
