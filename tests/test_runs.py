import pytest
import yaml

from weftgraph.functions import predicates as p
from weftgraph.operators import crawl_store as cs, graph as g
from weftgraph.sources import runs

B = "https://site.test/"
CONFIG = {
    "client": {"name": "Site", "slug": "site"},
    "scope": {"allowed_domains": ["site.test"]},
    "win": {"name": "win", "url_patterns": [B + "win*"]},
    "campaigns": [{"id": "c", "name": "C", "platform": "mail", "ad_copy": "x", "entry_links": [{"label": "near", "url": B + "near.html"}]}],
}


def page(*body, nav=()):
    links = lambda to: "".join(f'<a href="{x}">{x}</a>' for x in to)
    return f"<html><body><nav>{links(nav)}</nav><main>{links(body)}</main></body></html>"


@pytest.fixture
def folder(tmp_path):
    site = tmp_path / "site"
    (site / "deep er").mkdir(parents=True)
    (site / "near.html").write_text(page("win.html", "https://other.test/", nav=("far.html",)))
    (site / "far.html").write_text(page("deep%20er/last.html", nav=("win.html",)))
    (site / "deep er" / "last.html").write_text(page("../near.html"))
    (site / "win.html").write_text(page("near.html"))
    (site / "notes.txt").write_text("no page")
    return f"file://{site}"


def test_pages_of_a_folder(spark, folder):
    found = {r["url"]: r["html"] for r in runs.html_files(spark, folder, B).collect()}
    assert set(found) == {B + "near.html", B + "far.html", B + "deep er/last.html", B + "win.html"} and "<nav>" in found[B + "win.html"]


def test_graph_of_a_folder(spark, folder):
    raw = runs.html_files(spark, folder, B)
    raw = raw.replace(B + "deep er/last.html", B + "deep%20er/last.html", "url")
    graph = runs.graph_from_html(raw, p.Scope(("site.test",)), p.Win(url_patterns=(B + "win*",)))
    nodes = {r["url"].removeprefix(B): (r["win"], r["explored"]) for r in graph.nodes.collect()}
    assert nodes == {"near.html": (False, True), "far.html": (False, True), "deep%20er/last.html": (False, True), "win.html": (True, False)}
    edges = {(r["src"].removeprefix(B), r["dst"].removeprefix(B)): r["regions"] for r in graph.edges.collect()}
    assert edges["near.html", "win.html"] == ["body"] and edges["near.html", "far.html"] == ["nav"] and ("win.html", "near.html") not in edges
    d = {r["node"].removeprefix(B): r["d"] for r in g.distances_to_win(graph, (g.CONTENT_ONLY,)).collect()}
    assert d == {"win.html": 0, "near.html": 1, "deep%20er/last.html": 2, "far.html": 3}


def test_many_files(spark, tmp_path):
    for k in range(3_000):
        (tmp_path / f"p{k}.html").write_text(page(f"p{k + 1}.html"))
    assert runs.html_files(spark, f"file://{tmp_path}", B).select("url").distinct().count() == 3_000


def test_runs_are_opened_at_a_version(spark, tmp_path):
    path = f"file://{tmp_path}/run"
    with pytest.raises(runs.RunError, match="can't be read"):
        runs.open_run(spark, path)
    store = runs.save_run(spark, path, yaml.safe_dump(CONFIG))
    with pytest.raises(runs.RunError, match="already"):
        runs.save_run(spark, path, "x")
    with pytest.raises(runs.RunError, match="no store"):
        runs.open_run(spark, path)
    change = store.change()
    cs.add_entries(change, spark.createDataFrame([("near", B + "near.html")], "label string, url string"), "label")
    cs.set_meta(change, crawl_overrides={"max_depth": 3}, note=[1])
    change.publish()
    change = store.change()
    link = "src string, url string, text string, region string, in_scope boolean, operator boolean"
    cs.save_crawled(change, spark.createDataFrame([(B + "near.html", "ok")], "url string, status string"), spark.createDataFrame([(B + "near.html", B + "win", "w", "body", True, False)], link), "url")
    change.publish()
    run = runs.open_run(spark, path)
    assert run.config.data["crawl"]["max_depth"] == 3 and cs.meta(run.tables, "note") == [1] and cs.meta(run.tables, "none", 7) == 7
    assert {r["url"]: r["win"] for r in run.graph().nodes.collect()} == {B + "near.html": False, B + "win": True}
    assert run.tables.table("queue").first()["state"] == "done"
    assert [tuple(r) for r in run.entries().collect()] == [("near", B + "near.html")]
    assert runs.open_run(spark, path, version=1).tables.table("pages").count() == 0
