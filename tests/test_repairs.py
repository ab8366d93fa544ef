import pytest
from pyspark.sql import functions as F

from weftgraph.functions import predicates as p, urls
from weftgraph.operators import crawl_store as cs, repairs, seeds
from weftgraph.sources.store import Store
from weftgraph.sources.tables import SEED_COLUMNS

B = "https://shop.test/"
LINK = "src string, href string, url string, text string, region string, in_scope boolean, mc_id string, operator boolean"
SCOPE = p.Scope(("shop.test",), strip_query_params=("sid", "camp.*", "extra"), capture_params=("camp.tag", "extra"))
normalize = lambda c: urls.normalize_url(c, stripped=SCOPE.strip_query_params)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def pages(spark, *rows):
    return spark.createDataFrame([(B + u, s) for u, s in rows], "url string, status string")


def links(spark, *rows):
    return spark.createDataFrame([(B + s, h, u and B + u, t, r, True, None, False) for s, h, u, t, r in rows], LINK)


def save(spark, store, own, found, **more):
    change = store.change()
    cs.save_crawled(change, own, found, "href", **more)
    change.publish()


def test_pages_are_saved_with_links_aliases_and_queue(spark, store):
    change = store.change()
    cs.add_to_queue(change, spark.createDataFrame([(B + "a", 0, None, 1), (B + "b", 0, None, 2), (B + "old", 1, B + "a", 3)], "url string, depth int, parent string, rank int"))
    change.publish()
    assert [(r["url"], r["seq"], r["state"]) for r in store.table("queue").orderBy("seq").collect()] == [(B + "a", 1, "pending"), (B + "b", 2, "pending"), (B + "old", 3, "pending")]
    own = spark.createDataFrame([(B + "a", "ok", B + "asked", [B + "hop"], [(1, " "), (1, "Top"), (2, "x")])], "url string, status string, requested_url string, redirect_chain array<string>, headings array<struct<level:int,text:string>>")
    save(spark, store, own, links(spark, ("a", "x", "x", "X", "body"), ("a", "y", "y", "Y", "nav"), ("z", "z", "z", "not saved", "nav")), visited=spark.createDataFrame([(B + "old",)], "url string"))
    row = store.table("pages").first()
    assert (row["h1_count"], row["h1_empty_count"], row["win"]) == (1, 1, False) and row["crawled_at"]
    assert {r["url"]: r["final_url"] for r in store.table("aliases").collect()} == {B + n: B + "a" for n in ("a", "asked", "hop")}
    assert {r["url"]: r["state"] for r in store.table("queue").collect()} == {B + "a": "done", B + "b": "pending", B + "old": "done"}
    change = store.change()
    cs.add_operator_links(change, spark.createDataFrame([(B + "a", B + "win")], "src string, url string"))
    cs.log_actions(change, spark.createDataFrame([("t", B + "a", "wall", "link", None)], "ts string, url string, problem string, action string, detail string"), "ts")
    change.publish()
    save(spark, store, pages(spark, ("a", "http_error")), links(spark, ("a", "new", "new", "N", "body")))
    assert sorted((r["id"], r["url"], r["operator"]) for r in store.table("links").collect()) == [(3, B + "win", True), (4, B + "new", False)]
    assert store.table("pages").first()["status"] == "http_error" and store.table("operator_actions").first()["id"] == 1
    change = store.change()
    before = len(store.versions())
    cs.add_to_queue(change, spark.createDataFrame([(B + "asked", 1, None, 1), (B + "b", 1, None, 2), (B + "c", 1, None, 3)], "url string, depth int, parent string, rank int"))
    assert sorted((r["url"], r["seq"]) for r in change.table("queue").filter("state = 'pending'").collect()) == [(B + "b", 2), (B + "c", 4)]
    assert len(store.versions()) == before


def test_duplicate_pages_are_merged_everywhere(spark, store):
    clean, twin = "r", "r?sid=1"
    change = store.change()
    change.append("entries", spark.createDataFrame([(0, "r", B + twin, B + twin, "pending")], "idx int, label string, requested_url string, node_url string, status string"))
    change.append("queue", spark.createDataFrame([(B + twin, 0, None, 1, "pending"), (B + "q", 0, None, 2, "pending")], "url string, depth int, parent string, seq long, state string"))
    change.append("page_entities", spark.createDataFrame([(B + twin, "T", "e", 1.0, "title")], "url string, entity_type string, entity string, score double, evidence string"))
    change.append("lead_attribution", spark.createDataFrame([(B + twin, "t", "t")], "src string, mc_id string, lead_tag string"))
    change.append("aliases", spark.createDataFrame([(B + "way", B + twin)], "url string, final_url string"))
    change.publish()
    both = ("A", "nav")
    save(spark, store, pages(spark, (clean, "http_error"), (twin, "ok"), ("other", "ok"), ("solo?sid=9", "ok"), ("far", "ok")), links(
        spark, (clean, "/t?camp.tag=T1", "t", "T", "body"), (clean, "/a", "a", *both), (twin, "/t?camp.tag=T2&extra=5", "t", "T", "body"), (twin, "/a", "a", *both),
        ("other", "x", twin, "r", "body"), ("solo?sid=9", "/a", "a", "a", "body"), ("far", "m", None, "mail", "footer"), ("far", "/b?sid=2", "b?sid=2", "b", "body")))
    change = store.change()
    done = repairs.repair(change, normalize, SCOPE.capture_params)
    change.publish()
    assert (done["pages_merged"], done["links_renormalized"], done["links_tagged"], done["distinct_tags"], done["source_pages"]) == (1, 2, 2, 2, 1)
    assert {r["url"]: r["status"] for r in store.table("pages").collect()} == {B + "r": "ok", B + "other": "ok", B + "solo": "ok", B + "far": "ok"}
    own = store.table("links").filter(F.col("src") == B + "r").orderBy("id").collect()
    assert sorted((r["href"], r["mc_id"]) for r in own) == [("/a", None), ("/t?camp.tag=T1", "T1"), ("/t?camp.tag=T2&extra=5", "T2")]
    assert [r["params"] for r in own if r["mc_id"] == "T2"] == [{"camp.tag": "T2", "extra": "5"}]
    assert {r["url"] for r in store.table("links").filter(F.col("src").isin(B + "other", B + "far")).collect()} == {B + "r", None, B + "b"}
    to = {r["url"]: r["final_url"] for r in store.table("aliases").collect()}
    assert to[B + twin] == to[B + "way"] == B + "r" and to[B + "solo?sid=9"] == B + "solo"
    assert [r["node_url"] for r in store.table("entries").collect()] == [B + "r"]
    assert [r["url"] for r in store.table("queue").collect()] == [B + "q"]
    assert store.table("page_entities").count() == 0 and store.table("lead_attribution").first()["src"] == B + "r"
    assert {r["url"]: r["source"] for r in store.table("page_tags").collect()} == {B + n: "backfill" for n in ("r", "other", "solo", "far")}
    before = store.snapshot()
    change = store.change()
    again = repairs.repair(change, normalize, SCOPE.capture_params)
    assert (again["pages_merged"], again["links_renormalized"], again["page_tags"], again["links_tagged"]) == (0, 0, 0, 2)
    assert all(change.files(t) == before.files(t) for t in ("pages", "links", "aliases", "entries", "queue"))


def test_pages_that_are_gone_canonical_and_tags(spark, store):
    kind = "url string, status string, http_status int, title string, canonical string, meta_description string, headings array<struct<level:int,text:string>>, jsonld_types array<string>, rdfa_types array<string>"
    rows = [
        (B + "x/y.html", "ok", 200, "T", B + "x/y.html?sid=3", "D", [(2, "s"), (1, " "), (1, "Head")], ["B", "A"], ["B"]),
        (B + "gone", "http_error", 410, "T", None, None, None, None, None),
        (B + "ext", "external", 404, "404", None, None, None, None, None),
    ]
    save(spark, store, spark.createDataFrame(rows, kind), links(spark, ("x/y.html", "1", "a", "Menu", "nav"), ("x/y.html", "2", "b", "Menu", "header"), ("x/y.html", "3", "c", "Body", "body"), ("x/y.html", "4", "d", "Foot", "footer")))
    change = store.change()
    repairs.repair(change, normalize)
    change.publish()
    found = {r["url"]: r for r in store.table("pages").collect()}
    assert found[B + "x/y.html"]["canonical"] == B + "x/y.html" and found[B + "x/y.html"]["is_dead"] is False
    assert found[B + "gone"]["is_dead"] and found[B + "gone"]["dead_reason"] == "HTTP 410" and found[B + "ext"]["is_dead"] is None
    tags = {r["url"]: r for r in store.table("page_tags").collect()}
    page = tags[B + "x/y.html"]
    assert (page["h1"], page["url_path_segments"], page["schema_types"], page["breadcrumb"]) == ("Head", ["x", "y.html"], ["A", "B"], [])
    assert [tuple(x) for x in page["nav_labels"]] == [("", "Menu"), ("", "Foot")] and set(tags) == {B + "x/y.html", B + "gone"}


def seed_rows(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, " + ", ".join(f"{c} string" for c in SEED_COLUMNS))


P1, P2, P3 = ("https://www.linkedin.com/posts/p1", "https://linkedin.com/feed/update/urn:li:activity:7000000000000000000", "https://www.linkedin.com/posts/p3")


def test_seeds_become_posts_links_and_entries(spark, store):
    change = store.change()
    change.append("entries", spark.createDataFrame([(0, "old", B + "old", B + "old", "ok"), (4, "late", B + "late", B + "late", "ok")], "idx int, label string, requested_url string, node_url string, status string"))
    change.append("pages", spark.createDataFrame([(B + "dead", "http_error", True)], "url string, status string, is_dead boolean"))
    change.publish()
    rows = seed_rows(
        spark,
        (P1 + "/?utm=1", "", "https://lnkd.in/x", "go", "1", B + "b?sid=1&camp.tag=T&extra=e"),
        ("WWW.linkedin.com/posts/p1", "First", "https://lnkd.in/x", "again", "2", B + "b?other"),  # the same post and page
        (P1, "Later", "https://lnkd.in/y", None, None, None),
        (P2, "Second", B + "a?camp.tag=R", None, None, None),
        (P2, None, "https://lnkd.in/p", None, None, P3),
        (P2, None, None, None, None, None),
        (P3 + "x", "Third", B + "b", None, None, None),
        (P3 + "x", "Third", B + "old", None, None, None),
        (P3 + "x", "Third", B + "dead", None, None, None),
        (P3 + "x", "Third", B + "win", None, None, None),
        (P3 + "x", "Third", "https://else.test/", None, None, None),
        ("https://ad.test/1/", "", B + "c", None, None, None),  # an advertisement
        (None, "", B + "c", None, None, None),
    )
    ads = spark.createDataFrame([("https://ad.test/1",)], "url string")
    change = store.change()
    found = seeds.ingest(change, rows, SCOPE, "posts", ads, p.Win(url_patterns=("*/win",)))
    change.publish("seeds")
    posts = {r["url"]: (r["title"], r["post_date_derived"], r["status"], r["channel"]) for r in store.table("pages").filter("status = 'external'").collect()}
    assert posts == {P1: ("First", None, "external", "posts"), P2: ("Second", "2022-11-20", "external", "posts"), P3: (None, None, "external", "posts"), P3 + "x": ("Third", None, "external", "posts")}
    tagged = {(r["src"], r["url"]): (r["mc_id"], r["params"], r["href"]) for r in store.table("links").collect()}
    assert tagged[P1, B + "b"] == ("T", {"camp.tag": "T", "extra": "e"}, "https://lnkd.in/x") and tagged[P2, B + "a"][0] == "R"
    assert sorted(r["id"] for r in store.table("links").collect()) == list(range(1, 10))
    assert [(r["idx"], r["label"], r["node_url"]) for r in store.table("entries").filter("idx > 4").orderBy("idx").collect()] == [(5, "posts: Second", B + "a"), (6, "posts: Third", B + "b")]
    assert [(r["url"], r["depth"], r["seq"]) for r in store.table("queue").orderBy("seq").collect()] == [(B + "a", 0, 1), (B + "b", 0, 2)]
    told = {r["target"]: r["reason"] for r in found.outcomes.collect()}
    assert told == {B + "a": "new entry", B + "b": "new entry", B + "old": "existing entry", B + "dead": "dead page", B + "win": "win page", "https://else.test/": "host", P2: "no landing page", P3: "another post", "https://lnkd.in/y": "shortener"}
    change = store.change()
    again = seeds.ingest(change, rows, SCOPE, "posts", ads, p.Win(url_patterns=("*/win",)))
    assert again.landing.filter("state = 'new entry'").count() == 0
    assert change.table("entries").count() == 4 and change.table("links").count() == 9 and change.table("queue").count() == 2


@pytest.mark.parametrize(("explored", "most", "depth", "expected"), [(0, 10, 9, (5, None)), (2, 5, 9, (3, "max_pages")), (7, 5, 9, (0, "max_pages")), (0, 9, 1, (4, "max_depth")), (0, 2, 1, (2, "max_pages"))])
def test_budget_cuts_at_an_exact_place(spark, explored, most, depth, expected):
    rows = [(f"u{k}", k // 3 + k % 2, k + 10, "pending") for k in range(5)] + [("done", 0, 1, "done")]
    queue = spark.createDataFrame(rows, "url string, depth int, seq long, state string")
    taken, reason = cs.next_batch(queue, explored, most, depth)
    found = [(r["url"], r["place"]) for r in taken.orderBy("place").collect()]
    order = [u for u, d, s, st in sorted(rows, key=lambda r: (r[1], r[2])) if st == "pending" and d <= depth]
    assert found == [(u, k + 1) for k, u in enumerate(order[: expected[0]])] and reason == expected[1] and len(found) == expected[0]
