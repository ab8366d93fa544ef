import pytest

from weftgraph.operators import graph as g

BODY = {
    "entry-near": ["win", "orphan"], "entry-far": ["article-1"], "article-1": ["article-2", "trap-a"], "article-2": ["win"],
    "trap-a": ["trap-b"], "trap-b": ["trap-c"], "trap-c": ["trap-a"],
}
PAGES = ["about", "article-1", "article-2", "entry-far", "entry-near", "orphan", "trap-a", "trap-b", "trap-c"]
PAGE, LINK = "url string, explored boolean, win boolean", "src string, dst string, region string, operator boolean"


def build(spark, pages, links):
    return g.build_graph(spark.createDataFrame(pages, PAGE), spark.createDataFrame(links, LINK))


def labelled(spark, urls, column, modes=("all_links", "content_only")):
    return spark.createDataFrame([(m, u) for m in modes for u in urls], f"label string, {column} string")


@pytest.fixture(scope="module")
def site(spark):
    links = [(p, "win", "nav", False) for p in PAGES if p != "orphan"] + [(p, "about", "footer", False) for p in PAGES if p != "orphan"]
    links += [(s, d, "body", False) for s, ds in BODY.items() for d in ds] + [("win", "about", "footer", False)]
    return build(spark, [(p, True, False) for p in PAGES] + [("win", False, True)], links)


def test_distances(spark, site):
    rows = g.distances_to_win(site).collect()
    count = lambda mode: sorted((r["d"]) for r in rows if r["label"] == mode)
    assert count("all_links") == [0] + [1] * 8
    assert count("content_only") == [0, 1, 1, 2, 3]


def test_paths(spark, site):
    views, entries = g.labelled_views(site), ["entry-near", "entry-far"]
    short = g.shortest_paths(views, labelled(spark, entries, "start"), labelled(spark, ["win"], "node")).collect()
    assert {(r["label"], r["start"]): list(r["path"]) for r in short} == {
        ("all_links", "entry-near"): ["entry-near", "win"],
        ("all_links", "entry-far"): ["entry-far", "win"],
        ("content_only", "entry-near"): ["entry-near", "win"],
        ("content_only", "entry-far"): ["entry-far", "article-1", "article-2", "win"],
    }
    dist = g.distances_to_win(site)
    long = g.longest_paths(views, labelled(spark, entries, "start"), dist, 8).collect()
    assert {(r["label"], r["start"]): list(r["path"]) for r in long} == {
        ("all_links", "entry-near"): ["entry-near", "about", "win"],
        ("all_links", "entry-far"): ["entry-far", "article-1", "trap-a", "trap-b", "trap-c", "about", "win"],
        ("content_only", "entry-near"): ["entry-near", "win"],
        ("content_only", "entry-far"): ["entry-far", "article-1", "article-2", "win"],
    }
    cut = g.longest_paths(views, labelled(spark, ["entry-far"], "start", ("all_links",)), dist, 4).first()
    assert list(cut["path"]) == ["entry-far", "article-1", "article-2", "about", "win"] and cut["exhaustive"]


def test_zones_and_loops(spark, site):
    views = g.labelled_views(site)
    zones = g.dead_zones(site, views, g.distances_to_win(site), labelled(spark, ["entry-near", "entry-far"], "node"))
    dead = {m: sorted(r["node"] for r in zones.collect() if r["label"] == m and r["state"] == "dead end") for m in ("all_links", "content_only")}
    assert dead == {"all_links": ["orphan"], "content_only": ["orphan", "trap-a", "trap-b", "trap-c"]}
    loops = g.trap_loops(views, zones.filter("state = 'dead end'")).collect()
    assert sorted(map(tuple, loops)) == [("content_only", "trap-a", f"trap-{x}") for x in "abc"]
    reached = zones.groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in reached} == {"all_links": 10, "content_only": 9}


def test_unknown_is_not_dead(spark):
    pages = [(p, True, False) for p in "abdx"] + [("c", False, False), ("w", True, True)]
    graph = build(spark, pages, [("a", "b", "body", False), ("b", "c", "body", False), ("a", "d", "body", False), ("x", "w", "body", False)])
    mode = ("content_only",)
    zones = g.dead_zones(graph, g.labelled_views(graph, mode), g.distances_to_win(graph, mode), labelled(spark, ["a"], "node", mode))
    assert {r["node"]: r["state"] for r in zones.collect()} == {"a": "unknown", "b": "unknown", "c": "unexplored", "d": "dead end"}


def test_operator_rescue(spark):
    pages = [(p, True, False) for p in ("trap-a", "trap-b", "trap-c")] + [("win", False, True)]
    links = [("trap-a", "trap-b", "body", False), ("trap-b", "trap-c", "body", False), ("trap-c", "trap-a", "body", False), ("trap-c", "win", "operator", True)]
    graph = build(spark, pages, links)
    row = g.operator_dependency(graph, spark.createDataFrame([("trap-a",)], "url string"), "content_only").first()
    assert (list(row["path"]), row["uses_operator"], row["d_without"], row["depends"]) == (["trap-a", "trap-b", "trap-c", "win"], True, None, True)
    assert all(r["regions"] == [] for r in graph.edges.filter("operator").collect())


def test_wins_end_journeys_and_parallel_links_merge(spark):
    pages = [("a", True, False), ("w", False, True), ("x", True, False)]
    links = [("a", "w", "body", False), ("a", "w", "nav", False), ("a", "a", "nav", False), ("w", "after", "body", False), ("w", "x", "body", False)]
    graph = build(spark, pages, links)
    assert [list(r["regions"]) for r in graph.edges.filter("src = 'a'").collect()] == [["body", "nav"]]
    assert not graph.nodes.filter("url = 'after'").first()["explored"]
    views = g.labelled_views(graph, ("all_links",))
    assert g.reachable(views, labelled(spark, ["a"], "node", ("all_links",))).count() == 2
    depths = {r["node"]: r["d"] for r in g.click_depths(graph, spark.createDataFrame([("a",)], "node string")).filter("label = 'body'").collect()}
    assert depths == {"a": 0, "w": 1, "after": 2, "x": 2}
