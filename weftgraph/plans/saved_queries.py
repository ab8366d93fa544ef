"""Queries that write a crawl to a store in several commits, repair it there and read it back, each with its SQL beside it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftgraph.functions import predicates as p, urls
from weftgraph.operators import crawl_store as cs, graph as g, repairs, seeds, sites
from weftgraph.plans.journey import journey_graph
from weftgraph.plans.page_oracles import _JOURNEY
from weftgraph.plans.page_queries import _read
from weftgraph.plans.store_queries import _GRAPH, _LINKS, _link_rows
from weftgraph.sources.store import Store
from weftgraph.storage import shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


def _new_store(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


# ---- two crawls of one site


def _twice_saved(spark: SparkSession, sf_dir: str) -> Store:
    """The journey's pages and links, signups being an operator's links; then its wins are crawled again, with purchases as their links."""
    graph, _ = journey_graph(spark, sf_dir)
    store = _new_store(spark)
    status = F.when(F.col("explored"), "ok").otherwise("http_error")
    pages = graph.nodes.select("url", status.alias("status"), F.lit("first").alias("title"), "win")
    found = _link_rows(spark, sf_dir).select(F.col("id").alias("place"), "src", "url", "text", "region", F.lit(True).alias("in_scope"), (F.col("text") == "signup").alias("operator"))
    change = store.change()
    cs.save_crawled(change, pages, found, "place")
    change.publish("first crawl")
    change = store.change()
    cs.save_crawled(change, g.wins(graph).select("url", F.lit("ok").alias("status"), F.lit("second").alias("title"), F.lit(True).alias("win")), found.filter("text = 'purchase'"), "place")
    change.publish("second crawl")
    return store


@_query(f"""WITH RECURSIVE {_GRAPH}, {_LINKS}, old AS (SELECT row_number() OVER (ORDER BY src, id) AS id, src, url, text FROM ls), w AS (SELECT url FROM nodes WHERE win),
  fresh AS (SELECT (SELECT count(*) FROM ls) + row_number() OVER (ORDER BY src, id) AS id, src, url, text FROM ls WHERE text = 'purchase' AND src IN (SELECT url FROM w))
SELECT * FROM old WHERE text = 'signup' OR src NOT IN (SELECT url FROM w) UNION ALL SELECT * FROM fresh""")
def saved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _twice_saved(spark, sf_dir).table("links").select("id", "src", "url", "text")


@_query(f"""WITH RECURSIVE {_GRAPH} SELECT url, CASE WHEN win THEN 'second' ELSE 'first' END AS title, CASE WHEN explored OR win THEN 'ok' ELSE 'http_error' END AS status, win, url AS final_url FROM nodes""")
def saved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = _twice_saved(spark, sf_dir).snapshot()
    return now.table("pages").join(now.table("aliases"), "url").select("url", "title", "status", "win", "final_url")


# ---- repairs

_SHOP = "https://shop.example/"
_SCOPE = p.Scope(("shop.example",), strip_query_params=("sid", "camp"), capture_params=("camp",))


def _respelled_shop(spark: SparkSession, sf_dir: str) -> Store:
    """Customers as pages that were stored under up to three spellings, orders as links on them; then repaired."""
    orders = _read(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 3
    page = F.concat(F.lit(f"{_SHOP}c"), "o_custkey", F.when(k == 0, "").otherwise(F.concat(F.lit("?sid="), k)))
    to = F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1), F.lit("?camp="), "o_orderstatus")
    rows = orders.select(page.alias("src"), F.concat(F.lit("/"), to).alias("href"), F.concat(F.lit(_SHOP), to).alias("url"), F.col("o_orderpriority").alias("text"),
                         F.when(F.col("o_orderstatus") == "O", "body").otherwise("nav").alias("region"), F.lit(True).alias("in_scope"), F.col("o_orderkey").alias("place"), "o_orderstatus")
    pages = rows.groupBy(F.col("src").alias("url")).agg(F.when(F.bool_or(F.col("o_orderstatus") == "F"), "ok").otherwise("http_error").alias("status"))
    store = _new_store(spark)
    change = store.change()
    cs.save_crawled(change, pages, rows.withColumn("operator", F.lit(False)), "place")
    change.publish("crawl")
    change = store.change()
    repairs.repair(change, lambda url: urls.normalize_url(url, stripped=_SCOPE.strip_query_params), _SCOPE.capture_params)
    change.publish("repair")
    return store


_SHOP_SQL = f"""r AS (SELECT o_orderkey AS place, o_custkey AS c, '{_SHOP}c' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '?sid=' || (o_orderkey % 3) END AS src,
    '{_SHOP}p' || left(o_orderpriority, 1) AS url, '/p' || left(o_orderpriority, 1) || '?camp=' || o_orderstatus AS href, o_orderpriority AS text, o_orderstatus AS tag FROM orders),
  l AS (SELECT row_number() OVER (ORDER BY src, place) AS id, * FROM r), odd AS (SELECT DISTINCT c FROM r WHERE contains(src, '?'))"""


@_query(f"""WITH {_SHOP_SQL} SELECT min(id) AS id, '{_SHOP}c' || c AS src, url, tag AS mc_id, href FROM l WHERE c IN (SELECT c FROM odd) GROUP BY c, url, tag, href, text
UNION ALL SELECT id, src, url, tag, href FROM l WHERE c NOT IN (SELECT c FROM odd)""")
def renormalized_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _respelled_shop(spark, sf_dir).table("links").select("id", "src", "url", "mc_id", "href")


@_query(f"""WITH {_SHOP_SQL}, f AS (SELECT c, max(tag = 'F') AS ok, count(DISTINCT src) AS spellings, list_sort(list(DISTINCT text) FILTER (tag <> 'O')) AS labels FROM l GROUP BY c)
SELECT '{_SHOP}c' || c AS url, CASE WHEN ok THEN 'ok' ELSE 'http_error' END AS status, spellings - CASE WHEN c IN (SELECT c FROM r WHERE NOT contains(src, '?')) THEN 1 ELSE 0 END AS aliases,
  'backfill' AS source, 'c' || c AS path, coalesce(labels, []) AS labels FROM f""")
def repaired_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged pages with their aliases and the tags that were filled in."""
    now = _respelled_shop(spark, sf_dir).snapshot()
    names = now.table("aliases").filter("url <> final_url").groupBy(F.col("final_url").alias("url")).agg(F.count("*").alias("aliases"))
    tags = now.table("page_tags").select("url", "source", F.array_join("url_path_segments", "/").alias("path"), F.array_sort(F.transform("nav_labels", lambda x: x["label"])).alias("labels"))
    found = now.table("pages").join(names, "url", "left").join(tags, "url")
    return found.select("url", "status", F.coalesce("aliases", F.lit(0)).cast("long").alias("aliases"), "source", "path", "labels")


# ---- seeds


@_query("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS c, 'https://shop.example/k/' || o_orderpriority[1] || (o_orderkey % 1000) AS url, 'order ' || o_orderkey AS title FROM orders),
  first AS (SELECT c, min(id) AS place, arg_min(title, id) AS title FROM r GROUP BY c), once AS (SELECT c, url, min(id) AS id FROM r GROUP BY c, url),
  had AS (SELECT 'https://shop.example/k/1' || n_nationkey AS url FROM nation), gone AS (SELECT 'https://shop.example/k/2' || n_nationkey AS url FROM nation),
  new AS (SELECT url, arg_max(f.title, (f.place, o.id)) AS title FROM once o JOIN first f USING (c) WHERE url NOT IN (SELECT url FROM had) AND url NOT IN (SELECT url FROM gone) GROUP BY url)
SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY url) AS idx, 'posts: ' || title AS label, url AS node_url, 'pending' AS state, 0::BIGINT AS depth FROM new""")
def seed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of a seed file: customers' posts lead to pages; nations gave the entries there were, and pages that are gone."""
    nation, orders = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "orders")
    at = lambda n, c: F.concat(F.lit(f"{_SHOP}k/{n}"), c)
    store = _new_store(spark)
    change = store.change()
    had = at(1, F.col("n_nationkey"))
    change.append("entries", nation.select(F.col("n_nationkey").cast("int").alias("idx"), F.col("n_name").alias("label"), had.alias("requested_url"), had.alias("node_url"), F.lit("ok").alias("status")))
    change.append("pages", nation.select(at(2, F.col("n_nationkey")).alias("url"), F.lit("http_error").alias("status"), F.lit(True).alias("is_dead")))
    change.publish("before")
    page = F.concat(F.lit(f"{_SHOP}k/"), F.substring("o_orderpriority", 1, 1), (F.col("o_orderkey") % 1000).cast("string"), F.lit("?camp=x"))
    none = F.lit(None).cast("string")
    rows = orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("linkedin.com/posts/c"), "o_custkey", F.lit("/?rcm=1")).alias("seed_url"), F.concat(F.lit("order "), "o_orderkey").alias("post_title"),
                         F.concat(F.lit("https://lnkd.in/"), "o_orderkey").alias("outbound_url_raw"), none.alias("anchor_text"), none.alias("link_order"), page.alias("outbound_resolved_url"))
    change = store.change()
    seeds.ingest(change, rows, _SCOPE, "posts", spark.createDataFrame([], "url string"))
    change.publish("seeds")
    now = store.snapshot()
    fresh = now.table("entries").filter("status = 'pending'").join(now.table("queue").withColumnRenamed("url", "node_url"), "node_url")
    return fresh.select(F.col("idx").cast("long").alias("idx"), "label", "node_url", "state", F.col("depth").cast("long").alias("depth"))


# ---- what a crawl takes next


@_query(f"""WITH RECURSIVE {_GRAPH}, q AS (SELECT node AS url, least(min(ord) - 1, 12) AS depth, min(ord * 100000000 + user_id) AS seq FROM st GROUP BY node),
  near AS (SELECT url, row_number() OVER (ORDER BY depth, seq, url) AS place FROM q WHERE depth <= 8 AND url NOT IN (SELECT url FROM entries)), b AS (SELECT count(*) // 2 - (SELECT count(*) FROM entries) AS budget FROM q)
SELECT url, place, CASE WHEN (SELECT count(*) FROM near) > budget THEN 'max_pages' ELSE 'max_depth' END AS reason FROM near, b WHERE place <= budget""")
def crawl_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue in the order of users' steps, entries being explored; a budget of half of all pages ends inside a level."""
    from weftgraph.plans.journey import steps

    _, entries = journey_graph(spark, sf_dir)
    found = steps(spark, sf_dir).groupBy(F.col("node").alias("url")).agg((F.least(F.min("ord") - 1, F.lit(12))).cast("int").alias("depth"), F.lit(None).cast("string").alias("parent"), F.min(F.col("ord").cast("long") * 100_000_000 + F.col("user_id")).alias("rank"))
    store = _new_store(spark)
    change = store.change()
    cs.add_to_queue(change, found)
    cs.mark_queue(change, entries, "done")
    change.publish("queue")
    queue = store.table("queue")
    taken, reason = cs.next_batch(queue, queue.filter("state = 'done'").count(), queue.count() // 2, 8)
    return taken.select("url", "place", F.lit(reason).alias("reason"))


# ---- extraction

_TERMS = [("Function", "Conjunction", ["and", "und"]), ("Function", "Article", ["the", "der", "la", "le"]), ("Form", "Stem", ["ther*", "tion*"])]


@_query(r"""WITH m AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id), d AS (SELECT d.doc_id, CASE WHEN toxic IS NOT NULL THEN 'and the ' ELSE '' END || d.text AS text, d.source FROM documents d LEFT JOIN m USING (doc_id)),
  w AS (SELECT doc_id, source, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS w FROM d), k AS (SELECT *, list_transform(w, lambda t: regexp_replace(lower(t), '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g')) AS key FROM w),
  grams AS (SELECT doc_id, i, array_to_string(key[i : i + 7], chr(31)) AS gram FROM (SELECT doc_id, key, unnest(range(1, len(key) - 6)) AS i FROM k WHERE len(key) >= 8)),
  often AS (SELECT gram FROM grams GROUP BY gram HAVING count(DISTINCT doc_id) >= 3), gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 8)))) AS spots FROM grams WHERE gram IN (SELECT gram FROM often) GROUP BY doc_id),
  left_ AS (SELECT doc_id, source, list_filter(list_transform(w, lambda t, i: CASE WHEN list_contains(coalesce(spots, []), i) THEN NULL ELSE lower(t) END), lambda t: t IS NOT NULL) AS w FROM k LEFT JOIN gone USING (doc_id)),
  words AS (SELECT doc_id, source, flatten(list_transform(w, lambda t: regexp_split_to_array(t, '[^\p{L}\p{N}_]+'))) AS w FROM left_),
  n AS (SELECT doc_id, [len(list_filter(w, lambda t: t IN ('and', 'und'))), len(list_filter(w, lambda t: t IN ('the', 'der', 'la', 'le'))), len(list_filter(w, lambda t: starts_with(t, 'ther') OR starts_with(t, 'tion')))] AS n FROM words),
  s AS (SELECT doc_id, unnest([('Function', 'Conjunction', n[1]), ('Function', 'Article', n[2]), ('Form', 'Stem', n[3])]) AS x FROM n)
SELECT 'https://d.test/' || doc_id AS url, x[1] AS entity_type, x[2] AS entity, least(x[3], 5)::DOUBLE AS score, 'body' AS evidence FROM s WHERE x[3] >= 1""")
def extracted_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored pages, extracted; then those with labels are crawled again with two words more, and only what that touches is read again."""
    from weftgraph.operators import extraction

    docs = _read(spark, sf_dir, "documents")
    pages = docs.select("doc_id", F.concat(F.lit("https://d.test/"), "doc_id").alias("url"), F.lit("ok").alias("status"), F.col("text").alias("body_text"))
    links = spark.createDataFrame([], "src string, href string, url string, text string, region string, in_scope boolean, operator boolean")
    settings = extraction.Settings(window_pages=3)
    store = _new_store(spark)
    change = store.change()
    cs.save_crawled(change, pages, links)
    extraction.extract(store, change, _TERMS, settings)
    change.publish("first crawl")
    marked = _read(spark, sf_dir, "labels").select("doc_id").distinct()
    again = pages.join(marked, "doc_id", "left_semi").withColumn("body_text", F.concat(F.lit("and the "), "body_text"))
    change = store.change()
    cs.save_crawled(change, again, links)
    extraction.extract(store, change, _TERMS, settings)
    change.publish("second crawl")
    return store.table("page_entities")


# ---- several sites


@_query(_JOURNEY + """, pages AS (SELECT b.url, 'all_links' AS way, da.d FROM base b LEFT JOIN da ON node = url WHERE explored UNION ALL SELECT b.url, 'content_only', dc.d FROM base b LEFT JOIN dc ON node = url WHERE explored)
SELECT 'site ' || (split_part(url, ':', 1)::INT % 3) AS site, way, count(*) AS pages, count(d) AS reached, quantile_disc(d, 0.5)::BIGINT AS p50, quantile_disc(d, 0.9)::BIGINT AS p90, max(d)::BIGINT AS deepest FROM pages GROUP BY 1, 2""")
def sites_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journeys of three groups of users as three sites of their own, searched at once."""
    graph, _ = journey_graph(spark, sf_dir)
    none = spark.createDataFrame([], "url string, final_url string")
    status = F.when(F.col("explored"), "ok").otherwise("skipped")
    found = {}
    for k in range(3):
        mine = lambda c, k=k: F.substring_index(c, ":", 1).try_cast("int") % 3 == k
        pages = graph.nodes.filter(mine("url")).select("url", status.alias("status"), "win")
        links = graph.edges.filter(mine("src")).select("src", F.col("dst").alias("url"), F.explode("regions").alias("region"), F.lit(True).alias("in_scope"), F.lit(False).alias("operator"))
        found[f"site {k}"] = sites.Site({"pages": pages, "links": links, "aliases": none}, f"{k}:home")
    got = sites.comparison(found)["distances"].filter("way <> 'from_home'")
    return got.select("site", "way", "pages", "reached", *(F.col(c).cast("long").alias(c) for c in ("p50", "p90", "deepest")))
