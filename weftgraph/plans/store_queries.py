"""Queries over a stored crawl, its upkeep and its leads, each with its SQL beside it.

The crawl is the journey graph, with what its events and orders say about pages; texts and HTML come from their tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftgraph.functions import predicates as p
from weftgraph.operators import analysis, compare, entities, frontier, graph as g, leads, pages as pg, upkeep
from weftgraph.operators.store_graph import graph_from_store
from weftgraph.plans.graph_queries import _ZONE_SQL, _bfs_sql
from weftgraph.plans.journey import GRAPH_SQL, REGIONS, journey_graph, steps
from weftgraph.plans.page_oracles import _ENTITIES, _HOST, _JOURNEY, _LEADS, _PATH
from weftgraph.plans.page_queries import _journey_tags, _lead_view, _read, _tagged
from weftgraph.sources import html
from weftgraph.storage import durable

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


def _link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, src, url, text, region of every step, numbered by user and place in the user's steps."""
    rows = steps(spark, sf_dir).filter("next_node is not null")
    region = F.create_map(*(F.lit(x) for pair in REGIONS.items() for x in pair))[F.col("event_type")]
    number = F.col("user_id") * 1_000_000 + F.col("ord")
    return rows.select(number.alias("id"), F.col("node").alias("src"), F.col("next_node").alias("url"), F.col("event_type").alias("text"), region.alias("region"), "value")


_LINKS = """ls AS MATERIALIZED (SELECT user_id * 1000000 + ord AS id, node AS src, next_node AS url, event_type AS text,
    CASE event_type WHEN 'click' THEN 'body' WHEN 'view' THEN 'external' WHEN 'error' THEN 'footer' WHEN 'signup' THEN 'header' WHEN 'purchase' THEN 'nav' END AS region, value
  FROM st WHERE next_node IS NOT NULL)"""


def _classed(spark: SparkSession, sf_dir: str) -> g.Graph:
    """The journey graph, its wins typed by the largest purchase, other nodes with a signup in a class of their own."""
    graph, _ = journey_graph(spark, sf_dir)
    said = steps(spark, sf_dir).groupBy(F.col("node").alias("url")).agg(F.max("value").alias("most"), F.bool_or(F.col("event_type") == "signup").alias("signup"))
    nodes = graph.nodes.join(said, "url", "left")
    kind = F.when(F.col("win"), F.when(F.col("most") > 200, "large").otherwise("small"))
    nodes = nodes.select("url", "explored", "win", kind.alias("win_type"), F.coalesce(kind, F.when(F.col("signup"), "signup")).alias("conversion_class"))
    return g.Graph(durable(nodes, "classed-nodes"), graph.edges)


_CLASSED = """classed AS MATERIALIZED (SELECT n.url, n.explored, n.win, CASE WHEN n.win THEN CASE WHEN s.most > 200 THEN 'large' ELSE 'small' END END AS win_type,
    CASE WHEN n.win THEN CASE WHEN s.most > 200 THEN 'large' ELSE 'small' END WHEN s.signup THEN 'signup' END AS conversion_class
  FROM nodes n LEFT JOIN (SELECT node, max(value) AS most, bool_or(event_type = 'signup') AS signup FROM st GROUP BY node) s ON s.node = n.url)"""
_GRAPH = GRAPH_SQL.replace("SELECT user_id, event_type, value,", "SELECT user_id, event_id, event_type, value,")


@_query(f"""WITH RECURSIVE {_GRAPH}, {_CLASSED},
  goals AS (SELECT '(any)' AS label, url FROM classed WHERE win UNION SELECT win_type, url FROM classed WHERE win UNION SELECT conversion_class, url FROM classed WHERE NOT win AND conversion_class IS NOT NULL),
  walk(label, node, d) AS (SELECT label, url, 0 FROM goals UNION SELECT label, src, d + 1 FROM walk JOIN live ON dst = node WHERE d < 40),
  dist AS (SELECT label, node, min(d) AS d FROM walk GROUP BY ALL)
SELECT label, d::BIGINT AS clicks, count(*) AS pages, count(*) FILTER (n.explored) AS explored FROM dist JOIN nodes n ON n.url = node GROUP BY label, d""")
def win_type_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _classed(spark, sf_dir)
    found = g.win_type_distances(graph).join(graph.nodes.select(F.col("url").alias("node"), "explored"), "node")
    return found.groupBy("label", F.col("d").cast("long").alias("clicks")).agg(F.count("*").alias("pages"), F.count_if("explored").alias("explored"))


@_query(f"""WITH RECURSIVE {_GRAPH}, {_CLASSED}, d AS (SELECT dst, count(*) AS n FROM edges GROUP BY dst)
SELECT conversion_class, count(*) AS pages, count(d.n) AS linked, arg_min(win, url) AS counts_as_win FROM classed LEFT JOIN d ON dst = url WHERE conversion_class IS NOT NULL GROUP BY conversion_class""")
def win_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _classed(spark, sf_dir)
    return compare.win_classes(graph.nodes, g.in_degrees(graph))


@_query(f"""WITH RECURSIVE {_GRAPH},
  jumps AS MATERIALIZED (SELECT node AS src, next_node AS dst, bool_or(event_type <> 'error') AS plain FROM st WHERE next_node IS NOT NULL AND next_node <> node
    AND node NOT IN (SELECT url FROM nodes WHERE NOT explored OR win) GROUP BY 1, 2),
  a(start, node, d) AS (SELECT url, url, 0 FROM entries UNION SELECT start, dst, d + 1 FROM a JOIN jumps ON src = node WHERE d < 40),
  b(start, node, d) AS (SELECT url, url, 0 FROM entries UNION SELECT start, dst, d + 1 FROM b JOIN jumps ON src = node AND plain WHERE d < 40),
  x AS (SELECT start, min(d) AS d FROM a JOIN nodes ON url = node AND win GROUP BY start), y AS (SELECT start, min(d) AS d FROM b JOIN nodes ON url = node AND win GROUP BY start)
SELECT x.start, x.d::BIGINT AS clicks, y.d::BIGINT AS clicks_without, y.d IS NULL AS depends FROM x LEFT JOIN y USING (start)""")
def operator_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are an operator's jumps, which have no region."""
    graph, entries = journey_graph(spark, sf_dir)
    jump = F.array_contains("regions", "footer")
    edges = graph.edges.select("src", "dst", F.array_remove("regions", "footer").alias("regions"), jump.alias("operator"))
    found = g.operator_dependency(g.Graph(graph.nodes, durable(edges, "operator-edges")), entries, g.ALL_LINKS)
    return found.select("start", (F.size("path") - 1).cast("long").alias("clicks"), F.col("d_without").cast("long").alias("clicks_without"), "depends")


@_query(_JOURNEY + """, pages AS (SELECT b.url, 'all_links' AS mode, da.d FROM base b LEFT JOIN da ON node = url WHERE explored UNION ALL SELECT b.url, 'content_only', dc.d FROM base b LEFT JOIN dc ON node = url WHERE explored)
SELECT mode, d AS clicks, count(*) AS pages FROM pages GROUP BY mode, d""")
def distance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, _, dist = _journey_tags(spark, sf_dir)
    rows = graph.nodes.filter("explored").select("url", F.lit("journeys").alias("site")).join(dist, "url", "left")
    return compare.distance_histogram(rows, {g.ALL_LINKS: "d_all", g.CONTENT_ONLY: "d_content"}).drop("site")


@_query(f"""WITH RECURSIVE {_GRAPH}, {_LINKS} SELECT src, url, arg_min(text, id) AS text FROM ls GROUP BY src, url""")
def first_link_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.first_link_text(_link_rows(spark, sf_dir))


@_query(_JOURNEY + f""", {_LINKS}, texts AS (SELECT src, url, arg_min(text, id) AS text FROM ls GROUP BY src, url),
  step AS (SELECT e.src, min(e.dst) AS dst FROM live e JOIN dc x ON x.node = e.src AND x.d >= 2 JOIN dc y ON y.node = e.dst AND y.d = x.d - 1 WHERE content GROUP BY e.src)
SELECT s.src AS url, coalesce(t.text, '') AS text FROM step s LEFT JOIN texts t ON t.src = s.src AND t.url = s.dst""")
def first_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, _, dist = _journey_tags(spark, sf_dir)
    texts = pg.first_link_text(_link_rows(spark, sf_dir))
    return compare.first_steps(g.mode_view(graph, g.CONTENT_ONLY), dist.select(F.col("url"), F.col("d_content").alias("d")), texts)


@_query(_JOURNEY + """, most AS (SELECT max(score) AS m FROM tags), tagged AS (SELECT DISTINCT url FROM tags)
SELECT url AS source, entity_type || ': ' || entity AS target, 'mentions' AS kind, round_even(score / m, 3) AS weight FROM tags, most
UNION ALL SELECT src, dst, 'links', 1.0 FROM live WHERE content AND src IN (SELECT url FROM tagged) AND dst IN (SELECT url FROM tagged)""")
def knowledge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, tags, dist = _journey_tags(spark, sf_dir)
    return entities.knowledge_graph(tags, g.mode_view(graph, g.CONTENT_ONLY), dist.select("url", F.col("d_content").alias("d")))[1]


@_query(_JOURNEY + """SELECT t.url AS id, d::INT AS clicks, 'page' AS kind FROM (SELECT DISTINCT url FROM tags) t LEFT JOIN dc ON node = t.url
UNION ALL SELECT entity_type || ': ' || entity, round_even(median(d), 0)::INT, 'entity' FROM tags LEFT JOIN dc ON node = url GROUP BY 1""")
def knowledge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, tags, dist = _journey_tags(spark, sf_dir)
    return entities.knowledge_graph(tags, g.mode_view(graph, g.CONTENT_ONLY), dist.select("url", F.col("d_content").alias("d")))[0]


@_query(f"""WITH RECURSIVE {_GRAPH}, {_LINKS}, alias AS (SELECT n.url, e.url AS final_url FROM nodes n JOIN entries e ON split_part(e.url, ':', 1) = split_part(n.url, ':', 1) WHERE NOT n.explored),
  fresh AS (SELECT id, src, url FROM ls WHERE src IN (SELECT url FROM entries) AND url NOT IN (SELECT url FROM entries) AND url NOT IN (SELECT url FROM alias WHERE url <> final_url) AND url NOT IN (SELECT url FROM nodes WHERE win))
SELECT url, 1 AS depth, arg_min(src, (id, src)) AS parent, min(id) AS rank FROM fresh GROUP BY url""")
def enqueued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What links on the entries add to the queue: wins are stored pages, entries are queued, pages of errors are aliases of their user's entry."""
    graph, entries = journey_graph(spark, sf_dir)
    found = _link_rows(spark, sf_dir).join(entries.withColumnRenamed("url", "src"), "src")
    found = found.select("url", F.lit(1).alias("depth"), F.col("src").alias("parent"), F.col("id").alias("rank"))
    return frontier.enqueue(entries, g.wins(graph), _aliases(graph, entries), found)


def _aliases(graph: g.Graph, entries: DataFrame) -> DataFrame:
    user = F.substring_index("url", ":", 1)
    own = entries.select(user.alias("u"), F.col("url").alias("final_url"))
    return graph.nodes.filter("not explored").select("url", user.alias("u")).join(own, "u").select("url", "final_url")


@_query(f"""WITH RECURSIVE {_GRAPH}, {_LINKS}, alias AS (SELECT n.url, e.url AS final_url FROM nodes n JOIN entries e ON split_part(e.url, ':', 1) = split_part(n.url, ':', 1) WHERE NOT n.explored),
  once AS (SELECT DISTINCT src, url FROM ls), went AS (SELECT coalesce(final_url, o.url) AS url FROM once o LEFT JOIN alias a ON a.url = o.url)
SELECT url, count(*) AS links FROM went WHERE url IN (SELECT url FROM nodes WHERE ends_with(url, ':7') OR ends_with(url, ':17')) GROUP BY url""")
def win_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, entries = journey_graph(spark, sf_dir)
    win = p.Win(url_patterns=("*:7", "re:.*:17"))
    return upkeep.win_checks(_link_rows(spark, sf_dir), _aliases(graph, entries), win.destination(F.col("url")), None)


@_query(f"""WITH RECURSIVE {_GRAPH}, {_LINKS}, moves AS (SELECT n.url, e.url AS keep FROM nodes n JOIN entries e ON split_part(e.url, ':', 1) = split_part(n.url, ':', 1) WHERE NOT n.explored),
  moved AS (SELECT id, coalesce(a.keep, l.src) AS src, coalesce(b.keep, l.url) AS url, text, region FROM ls l LEFT JOIN moves a ON a.url = l.src LEFT JOIN moves b ON b.url = l.url)
SELECT min(id) AS id, src, url, text, region FROM moved GROUP BY src, url, text, region""")
def merged_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, entries = journey_graph(spark, sf_dir)
    links = _link_rows(spark, sf_dir).select("id", "src", "url", F.col("url").alias("href"), "text", "region", F.lit(False).alias("operator"), F.lit(None).cast("string").alias("mc_id"))
    same = links.withColumn("href", F.lit(""))
    return frontier.merge_links(same, _aliases(graph, entries).withColumnRenamed("final_url", "keep")).select("id", "src", "url", "text", "region")


@_query(f"""WITH RECURSIVE {_GRAPH}, {_LINKS}, pairs AS (SELECT src AS seed, url AS landing, arg_min(text, id) AS kind FROM ls GROUP BY src, url),
  pages AS (SELECT DISTINCT landing AS url FROM pairs WHERE kind = 'click')
SELECT reason, count(*) AS pages FROM (SELECT p.url, CASE WHEN NOT n.explored THEN 'dead' WHEN n.win THEN 'win' WHEN p.url IN (SELECT url FROM entries) THEN 'existing entry' ELSE 'new entry' END AS reason
  FROM pages p JOIN nodes n ON n.url = p.url) GROUP BY reason""")
def seed_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, entries = journey_graph(spark, sf_dir)
    rows = _link_rows(spark, sf_dir).select("id", F.col("src").alias("seed"), F.col("url").alias("landing"), F.col("text").alias("anchor"), F.when(F.col("text") == "click", "page").otherwise("offsite").alias("kind"))
    dead = graph.nodes.filter("not explored")
    _, planned = frontier.plan_seeds(rows, entries, dead, F.lit(False))
    won = planned.join(g.wins(graph).withColumn("won", F.lit(True)), "url", "left")
    reason = F.when((F.col("reason") != "dead") & F.col("won"), "win").otherwise(F.col("reason"))
    return won.groupBy(reason.alias("reason")).agg(F.count("*").alias("pages"))


@_query(f"""WITH RECURSIVE {_GRAPH} SELECT (SELECT count(*) FROM nodes WHERE explored) AS in_sitemap, (SELECT count(*) FROM nodes WHERE NOT explored AND ends_with(url, '7')) AS missed""")
def sitemap_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, _ = journey_graph(spark, sf_dir)
    return frontier.sitemap_coverage(graph.nodes, graph.nodes.filter("explored"), F.col("url").endswith("7"))[0]


@_query(_bfs_sql("SELECT url, 0 FROM entries", "live", True, "SELECT count(*) FILTER (NOT explored) = 0 AS complete, count(*) FILTER (NOT explored) AS queued_unvisited FROM dist JOIN nodes ON url = node WHERE d <= 8"))
def crawl_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, entries = journey_graph(spark, sf_dir)
    queue = frontier.crawl_levels(g.terminal(graph.edges, graph).select("src", "dst"), entries, graph, 8)
    return compare.crawl_coverage(graph.nodes.select("url", F.lit("ok").alias("status")), queue)[0]


@_query(f"""WITH RECURSIVE {_GRAPH} SELECT CASE WHEN win THEN 'win' WHEN explored THEN 'ok' ELSE 'http_error' END AS status, count(*) AS pages FROM nodes GROUP BY 1""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, _ = journey_graph(spark, sf_dir)
    return upkeep.status_counts(graph.nodes.select(F.when(F.col("win"), "win").when(F.col("explored"), "ok").otherwise("http_error").alias("status")))


@_query(f"""WITH RECURSIVE {_GRAPH}, {_LINKS} SELECT count(*) AS links, count(DISTINCT CASE WHEN value > 100 THEN text || floor(value)::BIGINT END) AS tags, count(DISTINCT CASE WHEN value > 100 THEN src END) AS tag_pages FROM ls""")
def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("value") > 100, F.concat("text", F.floor("value").cast("string")))
    return upkeep.link_counts(_link_rows(spark, sf_dir).withColumn("mc_id", tag))


@_query(f"""WITH RECURSIVE {_GRAPH}, {_LINKS}, marked AS (SELECT DISTINCT src FROM ls WHERE text = 'view')
SELECT url, list_transform(list_sort(coalesce(list((first, text)) FILTER (text IS NOT NULL), [])), lambda x: x[2]) AS nav_labels FROM nodes n
  LEFT JOIN (SELECT src, text, min(id) AS first FROM ls WHERE region IN ('nav', 'header', 'footer') GROUP BY src, text) c ON c.src = n.url WHERE explored AND url NOT IN (SELECT src FROM marked) GROUP BY url""")
def missing_page_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, _ = journey_graph(spark, sf_dir)
    links = _link_rows(spark, sf_dir)
    pages = graph.nodes.select("url", F.when(F.col("explored"), "ok").otherwise("skipped").alias("status"))
    return upkeep.missing_page_tags(pages, links.filter("text = 'view'").select(F.col("src").alias("url")).distinct(), links)


@_query(f"""WITH RECURSIVE {_GRAPH}, {_CLASSED}, d AS (SELECT dst, count(*) AS n FROM edges GROUP BY dst)
SELECT url, win_type, coalesce(n, 0) AS linked_from, CASE WHEN win_type = 'large' THEN 'marked by the operator' WHEN ends_with(url, '5') THEN 'gone' ELSE 'URL fits' END AS reason FROM classed LEFT JOIN d ON dst = url WHERE win""")
def win_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _classed(spark, sf_dir)
    nodes = graph.nodes.withColumn("win_source", F.when(F.col("win_type") == "large", "operator").otherwise("pattern"))
    gone = graph.nodes.filter(F.col("url").endswith("5")).select("url", F.lit(True).alias("gone"))
    return upkeep.win_pages(nodes, g.in_degrees(graph), gone)


@_query(_JOURNEY + """, d AS (SELECT dst, count(*) AS n FROM edges GROUP BY dst) SELECT url, coalesce(n, 0) AS linked_from FROM base LEFT JOIN d ON dst = url
WHERE NOT win AND (contains(regexp_extract(page, '^https://x.com(.*)', 1), 'track')) AND NOT contains(page, '/7') """.replace("FROM base", "FROM (SELECT *, 'https://x.com/' || CASE WHEN k < 20 THEN 'track/' ELSE 'shop/' END || u || '/' || k AS page FROM base)").replace("SELECT url,", "SELECT page AS url,").replace("dst = url", "dst = url"))
def near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, _ = journey_graph(spark, sf_dir)
    k, user = F.split("url", ":")[1].cast("int"), F.split("url", ":")[0]
    page = F.concat(F.lit("https://x.com/"), F.when(k < 20, "track/").otherwise("shop/"), user, F.lit("/"), k)
    named = graph.nodes.select(page.alias("page"), "url", "win")
    inbound = g.in_degrees(graph).join(named, "url").select(F.col("page").alias("url"), "in_degree")
    win = p.Win(url_patterns=("*/buy",), exclude_patterns=("*/7*",), near_miss_keywords=("track",))
    return upkeep.near_misses(named.select(F.col("page").alias("url"), "win"), inbound, win)


# ---- pages, texts


@_query(f"""WITH rules AS (SELECT unnest([(false, '^[a-z]+://[^/]*/de/', 4), (true, '^[a-z]+://[^/]*/de/1', 5), (false, '^[a-z]+://[^/]*/.*[.]html', 7)]) AS r),
  p AS (SELECT DISTINCT url, {_HOST} AS host FROM pages), hit AS (SELECT url, r[1] AS allow, r[3] AS size FROM p, rules WHERE contains(host, '.com') AND regexp_matches(url, r[2]))
SELECT p.url, coalesce(arg_max(allow, (size, allow)), true) AS allowed FROM p LEFT JOIN hit USING (url) GROUP BY p.url""")
def robots_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of .com hosts have rules of their own, others none."""
    from weftgraph.functions.urls import host_of

    pages = _read(spark, sf_dir, "pages").select(host_of(F.col("url")).alias("origin"), "url").distinct()
    rules = spark.createDataFrame([(False, "^[a-z]+://[^/]*/de/", 4), (True, "^[a-z]+://[^/]*/de/1", 5), (False, "^[a-z]+://[^/]*/.*[.]html", 7)], "allow boolean, regex string, size int")
    own = pages.filter(F.col("origin").contains(".com")).select("origin").distinct()
    return p.robots_join(pages, own.join(F.broadcast(rules), F.lit(True)))


@_query(f"""WITH h AS (SELECT url, {_HOST} AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS rest FROM pages), m AS (SELECT host FROM h GROUP BY host ORDER BY count(*) DESC, host LIMIT 1)
SELECT url, CASE WHEN host IN (SELECT host FROM m) THEN '' ELSE host END || CASE WHEN rest = '' THEN '/' ELSE rest END AS label FROM h""")
def short_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.short_labels(_read(spark, sf_dir, "pages"))


@_query(f"SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS base FROM pages WHERE {_HOST} IN ('therou.example.com', 'm.therou.example.com', 'thther.example.org')")
def site_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.site_bases(_read(spark, sf_dir, "pages"), ["therou.example.com", "m.Therou.example.com", "thther.example.org"])


@_query("SELECT page_id, left(sha1(url), 16) || '.png' AS name FROM pages")
def screenshot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", upkeep.screenshot_name(F.col("url")).alias("name"))


@_query(f"""WITH c AS (SELECT page_id, 'HTTPS://' || upper({_HOST}) || {_PATH} AS page FROM pages), n AS (SELECT 'https://' || {_HOST} || {_PATH} AS node FROM pages)
SELECT page_id, page, max(node) AS node FROM c LEFT JOIN n ON lower(node) = lower(page) GROUP BY page_id, page""")
def conversion_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.functions.urls import host_of, path_of

    rows = _read(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("at"))
    given = rows.select("page_id", F.concat(F.lit("HTTPS://"), F.upper("h"), "at").alias("page"))
    return upkeep.conversion_matches(given, rows.select(F.concat(F.lit("https://"), "h", "at").alias("url")))


@_query(r"""WITH p AS (SELECT url, replace(replace(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '\s+', ' ', 'g'), '&amp;', '&'), '&lt;', '<') AS t, html, regexp_extract(html, '<nav>(.*?)</nav>', 1, 's') AS nav FROM pages)
SELECT url, trim(t) AS title, len(regexp_extract_all(html, '<h1>'))::BIGINT AS h1, len(regexp_extract_all(html, '<h[1-6]>'))::BIGINT AS headings, len(list_distinct(regexp_extract_all(nav, '<a href="[^"]*">(.*?)</a>', 1)))::BIGINT AS nav_labels,
  0::BIGINT AS types, true AS no_description FROM p""")
def page_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract_pages(_read(spark, sf_dir, "pages"))
    size = lambda c: F.size(c).cast("long")
    types = F.concat("jsonld_types", "microdata_types", "rdfa_types", "og_properties", "hreflang", "breadcrumb", "article_tags", "meta_keywords", "service_entities")
    return found.select("url", "title", (F.col("h1_count") + F.col("h1_empty_count")).cast("long").alias("h1"), size("headings").alias("headings"), size("nav_labels").alias("nav_labels"), size(types).alias("types"), F.col("meta_description").isNull().alias("no_description"))


@_query(r"""WITH l AS (SELECT url AS src, unnest(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<a href="([^"]*)"', 1)) AS href FROM pages),
  near AS (SELECT DISTINCT src FROM l WHERE href IN ('/the', '/de', '/los'))
SELECT 'all_links' AS mode, count(*) AS pages FROM near""")
def stored_crawl_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From HTML through links, scope and wins to clicks: pages whose menus lead to a win, one click away."""
    raw = _read(spark, sf_dir, "pages").select("url", "html")
    links = html.extract_links(raw).filter("url is not null")
    pages = raw.select("url", F.lit("ok").alias("status"), F.lit(False).alias("win"), F.lit(None).cast("string").alias("win_source"), F.lit(None).cast("boolean").alias("form_present"))
    none = spark.createDataFrame([], "url string, final_url string")
    inside = links.select("src", "url", "region", F.lit(False).alias("operator"), F.lit(True).alias("in_scope"))
    graph = graph_from_store(pages, inside, none, p.Win(name="go", url_patterns=("re:[a-z]+://[^/]+/(the|de|los)",)))
    graph = g.Graph(durable(graph.nodes, "stored-nodes"), durable(graph.edges, "stored-edges"))
    return g.distances_to_win(graph).filter("d = 1").groupBy(F.col("label").alias("mode")).agg(F.count("*").alias("pages"))


_DOC_PAGES = """docs AS (SELECT 'https://x.com/' || source || '/' || doc_id AS url, split_part(text, chr(10), 1) AS title, split_part(text, chr(10), 2) AS meta, n_chars AS r, length(split_part(text, chr(10), 1)) AS raw, doc_id FROM documents),
  h AS (SELECT d.*, title <> '' AND count(*) OVER (PARTITION BY regexp_replace(lower(title), '^\\s+|\\s+$', '', 'g')) > 1 AS td, meta <> '' AND count(*) OVER (PARTITION BY CASE WHEN meta <> '' THEN regexp_replace(lower(meta), '^\\s+|\\s+$', '', 'g') END) > 1 AS md FROM docs d)"""


def _doc_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as loaded pages: the first line is the title, the second the description; labelled toxic ones carry tags, those of low quality leads."""
    docs = _read(spark, sf_dir, "documents")
    url = F.concat(F.lit("https://x.com/"), "source", F.lit("/"), "doc_id")
    none = F.array().cast("array<string>")
    lists = ("jsonld_types", "microdata_types", "rdfa_types", "og_properties", "hreflang", "redirect_chain")
    pages = docs.select(
        url.alias("url"), F.lit("ok").alias("status"), F.substring_index("text", "\n", 1).alias("title"), F.coalesce(F.get(F.split("text", "\n"), F.lit(1)), F.lit("")).alias("meta_description"),
        F.lit(1).alias("h1_count"), F.lit(0).alias("h1_empty_count"), F.lit("").alias("canonical"), F.lit("").alias("robots_meta"), F.lit(False).alias("is_dead"),
        F.col("n_chars").alias("rendered_text_len"), F.length(F.substring_index("text", "\n", 1)).alias("raw_text_len"), *(none.alias(c) for c in lists),
    )
    marks = _read(spark, sf_dir, "labels").join(docs.select("doc_id", url.alias("url")), "doc_id").dropDuplicates(["url"])
    empty = lambda s: spark.createDataFrame([], s)
    depths, dead = empty("url string, all_links int, body_links int"), empty("url string, pages long")
    same = pages.groupBy("title").agg(F.count("*").alias("in_degree"))
    inbound = pages.join(same, "title").select("url", "in_degree")
    return pg.page_health(pages, depths, inbound, dead, marks.filter("toxic = 1"), marks.filter("quality = 0").select("url", F.lit(2.5).alias("leads")))


_MARKS = "m AS (SELECT doc_id, any_value(toxic) AS toxic, any_value(quality) AS quality FROM labels GROUP BY doc_id)"


@_query(f"""WITH {_DOC_PAGES}, {_MARKS}, s AS (SELECT title, count(*) AS n FROM docs GROUP BY title)
SELECT url, s.n AS inbound_links, title <> '' AS has_title, td AS title_duplicated, meta <> '' AS has_meta_description, md AS meta_duplicated, CASE WHEN r > 0 THEN raw < r / 2 END AS js_dependent,
  CASE WHEN r > 0 THEN round_even(raw / r, 3) END AS raw_text_share, coalesce(toxic = 1, false) AS carries_lead_tags, CASE WHEN quality = 0 THEN 2 ELSE 0 END::BIGINT AS leads_allocated, coalesce(quality = 0, false) AS carries_leads
FROM h JOIN s USING (title) LEFT JOIN m USING (doc_id)""")
def page_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("url", "inbound_links", "has_title", "title_duplicated", "has_meta_description", "meta_duplicated", "js_dependent", "raw_text_share", "carries_lead_tags", "leads_allocated", "carries_leads")
    return _doc_health(spark, sf_dir).select(*names)


@_query(f"""WITH {_DOC_PAGES} SELECT count(*) AS pages, 0::BIGINT AS dead, count(*) AS no_structured_data, count(*) FILTER (r > 0 AND raw < r / 2) AS js_dependent, count(*) FILTER (title = '') AS missing_title,
  count(*) FILTER (td) AS title_duplicated, count(*) FILTER (meta = '') AS missing_meta_description, count(*) FILTER (md) AS meta_duplicated, count(*) AS unreachable_from_home_all FROM h""")
def health_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pg.health_summary(_doc_health(spark, sf_dir))
    return found.select("pages", "dead", "no_structured_data", "js_dependent", "missing_title", "title_duplicated", "missing_meta_description", "meta_duplicated", "unreachable_from_home_all")


@_query(r"""WITH tokens AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> ''), lambda t: regexp_replace(lower(t), '^[^\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_]+$', '', 'g')) AS w FROM documents),
  grams AS (SELECT doc_id, i, array_to_string(w[i : i + 7], chr(31)) AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM tokens WHERE len(w) >= 8)),
  often AS (SELECT gram FROM grams GROUP BY gram HAVING count(DISTINCT doc_id) >= 3),
  gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS at FROM grams WHERE gram IN (SELECT gram FROM often)), n AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id)
SELECT doc_id::VARCHAR AS url, coalesce(c, 0) AS dropped_words FROM documents LEFT JOIN n USING (doc_id)""")
def clean_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), F.lit("").alias("title"), F.array().cast("array<string>").alias("headings"), F.col("text").alias("body"))
    return entities.strip_boilerplate(docs, window_pages=3).select("url", "dropped_words")


@_query("""WITH c AS (SELECT 'https://c.example/' || c_mktsegment || '/' || replace(c_name, '#', '-') || '.html' AS url, c_custkey, c_name, c_mktsegment, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey),
  l AS (SELECT c_custkey, string_agg(o_orderpriority, ' | ' ORDER BY first) AS nav FROM (SELECT o_custkey AS c_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1, 2) GROUP BY c_custkey)
SELECT url, c_name AS title, c_mktsegment AS h1, n_name || ' | ' || c_mktsegment AS breadcrumb, coalesce(nav, '') AS nav_label, ' ' || c_mktsegment || ' ' || replace(c_name, '#', ' ') || ' ' AS url_path FROM c LEFT JOIN l USING (c_custkey)""")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages, orders as links in menus to them; open orders are links in texts."""
    customer, nation, orders = (_read(spark, sf_dir, n) for n in ("customer", "nation", "orders"))
    url = F.concat(F.lit("https://c.example/"), "c_mktsegment", F.lit("/"), F.replace("c_name", F.lit("#"), F.lit("-")), F.lit(".html"))
    rows = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select("c_custkey", url.alias("url"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("h1"), F.array("n_name", "c_mktsegment").alias("breadcrumb"))
    links = orders.join(rows.select("c_custkey", "url"), orders["o_custkey"] == rows["c_custkey"])
    links = links.select("url", F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "body").otherwise("nav").alias("region"), F.col("o_orderpriority").alias("text"))
    return entities.page_fields(rows.select("url", "title"), rows.select("url", "h1", "breadcrumb"), links)


@_query("""WITH r AS (SELECT 'd' || doc_id AS url, lang AS entity_type, split_part(text, ' ', 1) AS name, [split_part(text, ' ', 2), ' ' || split_part(text, ' ', 2) || ' ', source] AS terms FROM documents),
  k AS (SELECT *, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS key FROM r)
SELECT entity_type, min(name) AS name, list_sort(list_distinct(list_filter(list_transform(flatten(list(terms)), lambda t: lower(trim(regexp_replace(t, '\\s+', ' ', 'g')))), lambda t: t <> ''))) AS terms,
  list_sort(list_distinct(list(url))) AS urls, count(DISTINCT url)::INT AS pages, CASE WHEN entity_type = 'en' AND key = 'the' THEN 'known' WHEN count(DISTINCT url) < 3 THEN 'too few pages' ELSE 'accepted' END AS verdict
FROM k WHERE key <> '' GROUP BY entity_type, key""")
def merged_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    words = F.split("text", " ")
    second = F.coalesce(F.get(words, F.lit(1)), F.lit(""))
    rows = docs.select(F.concat(F.lit("d"), "doc_id").alias("url"), F.col("lang").alias("entity_type"), words[0].alias("name"), F.array(second, F.concat(F.lit(" "), second, F.lit(" ")), "source").alias("terms"))
    return upkeep.accept_proposals(upkeep.merge_proposals(rows), 3, spark.createDataFrame([("en", "The")], "entity_type string, name string"))


# ---- leads


@_query(_LEADS + """, n AS (SELECT lead_tag, count(DISTINCT src) AS n FROM kept GROUP BY lead_tag), a AS (SELECT src, lead_tag, any_value(leads) / any_value(n) AS share, any_value(n) AS n FROM kept JOIN n USING (lead_tag) GROUP BY src, lead_tag)
SELECT src AS url, round(sum(share), 4) AS leads, round(sum(CASE WHEN n = 1 THEN share ELSE 0 END), 4) AS exact_leads, floor(round(sum(share), 6) + 1e-9)::BIGINT AS leads_whole FROM a GROUP BY src""")
def node_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = leads.attribute(*_lead_view(spark, sf_dir))
    return leads.node_leads(rows).select("url", F.round("leads", 4).alias("leads"), F.round("exact_leads", 4).alias("exact_leads"), "leads_whole")


@_query(_LEADS + """, n AS (SELECT lead_tag, count(DISTINCT src) AS n FROM kept GROUP BY lead_tag), a AS (SELECT src, lead_tag, url, any_value(leads) / any_value(n) AS share FROM kept JOIN n USING (lead_tag) WHERE url <> 'https://s.example/3' GROUP BY ALL),
  b AS (SELECT *, share / count(*) OVER (PARTITION BY src, lead_tag) AS part FROM a)
SELECT src, url AS dst, round(sum(part), 4) AS leads FROM b GROUP BY src, url""")
def edge_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = leads.attribute(*_lead_view(spark, sf_dir))
    edges = rows.select("src", F.explode(F.split("targets", " ")).alias("dst")).distinct().filter("dst <> 'https://s.example/3'")
    return leads.edge_leads(rows, edges).select("src", "dst", F.round("leads", 4).alias("leads"))


@_query(_LEADS + """, paid AS (SELECT DISTINCT src FROM kept) SELECT DISTINCT src FROM carriers WHERE url = 'https://s.example/2' AND src NOT IN (SELECT src FROM paid WHERE src LIKE '%1')""")
def unrewarded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a link to a win whose name does not end in 1 count as pages without a share."""
    tags, carriers = _lead_view(spark, sf_dir)
    rows, _ = leads.attribute(tags, carriers)
    wins = spark.createDataFrame([("https://s.example/2",)], "url string")
    return leads.unrewarded_pages(carriers, rows.filter(F.col("src").endswith("1")), wins)


@_query(_LEADS + """, n AS (SELECT lead_tag, count(DISTINCT src) AS n FROM kept GROUP BY lead_tag),
  a AS (SELECT src, lead_tag, list_distinct(list(tag)) AS tags, any_value(leads) / any_value(n) AS share FROM kept JOIN n USING (lead_tag) GROUP BY src, lead_tag),
  parts AS (SELECT share / len(tags) AS part, unnest(tags) AS tag FROM a), s AS (SELECT split_part(tag, '_', 1) AS archetype, floor(round(sum(part), 6) + 1e-9)::BIGINT AS leads FROM parts GROUP BY 1)
SELECT c.archetype, tags, pages, win_pages, coalesce(leads, 0) AS leads FROM (SELECT split_part(tag, '_', 1) AS archetype, count(DISTINCT tag) AS tags, count(DISTINCT src) AS pages, count(DISTINCT CASE WHEN url = 'https://s.example/2' THEN src END) AS win_pages FROM carriers GROUP BY 1) c LEFT JOIN s USING (archetype)""")
def lead_archetypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags, carriers = _lead_view(spark, sf_dir)
    rows, _ = leads.attribute(tags, carriers)
    return leads.archetypes(carriers, rows, spark.createDataFrame([("https://s.example/2",)], "url string"), r"(?P<archetype>[A-Z]+)_")


@_query(_LEADS + """, m AS (SELECT t.lead_tag, any_value(t.leads) AS leads, any_value(k.join_type) AS j, any_value(t.main) AS main, bool_or(k.url = t.main) AS lands FROM tags t LEFT JOIN kept k USING (lead_tag) GROUP BY t.lead_tag),
  n AS (SELECT lead_tag, count(DISTINCT src) AS n FROM kept GROUP BY lead_tag), a AS (SELECT src, lead_tag, floor(any_value(leads) / any_value(n)) AS w, any_value(n) AS n FROM kept JOIN n USING (lead_tag) GROUP BY src, lead_tag)
SELECT count(*) AS tags, sum(leads) AS leads_total, count(*) FILTER (j = 'exact') AS matched_exact, count(*) FILTER (j = 'fallback') AS matched_fallback, coalesce(sum(leads) FILTER (j IS NOT NULL), 0) AS leads_matched,
  count(*) FILTER (coalesce(lands, false) = false) AS landed_elsewhere, (SELECT count(DISTINCT src) FROM a) AS origin_pages, (SELECT count(*) FROM a WHERE n = 1) AS exact_rows, (SELECT sum(w)::BIGINT FROM a) AS whole_leads FROM m""")
def lead_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags, carriers = _lead_view(spark, sf_dir)
    return leads.totals(tags, *leads.attribute(tags, carriers))


@_query("""WITH s AS (SELECT p_type || '_' || p_size AS tag, 's' || l_suppkey AS page, sum(l_quantity) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT tag AS lead_tag, arg_min(page, (-n, page)) AS main_conversion_page FROM s GROUP BY tag""")
def main_conversion_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    item, part = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "part")
    rows = item.join(part, item["l_partkey"] == part["p_partkey"])
    return leads.main_conversion_pages(rows.select(F.concat_ws("_", "p_type", F.col("p_size").cast("string")).alias("lead_tag"), F.concat(F.lit("s"), "l_suppkey").alias("page"), F.col("l_quantity").alias("leads")))


# ---- analyses and summaries


@_query(_ZONE_SQL.format(graph=GRAPH_SQL).rstrip() + """,
  fd(mode, start, node, d) AS (SELECT mode, url, url, 0 FROM entries, modes UNION SELECT f.mode, start, dst, d + 1 FROM fd f JOIN view v ON v.mode = f.mode AND src = node WHERE d < 40)
SELECT f.mode AS label, f.start, min(f.d)::BIGINT AS clicks FROM fd f JOIN zones z ON z.mode = f.mode AND z.node = f.node AND z.state = 'dead end' GROUP BY f.mode, f.start""")
def dead_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analysis.dead_clicks(*journey_graph(spark, sf_dir))
    return found.select("label", "start", F.col("clicks").cast("long").alias("clicks"))


@_query(f"""WITH {_DOC_PAGES}, {_MARKS}, x AS (SELECT h.*, split_part(url, '/', 4) AS section, coalesce(quality = 0, false) AS leads FROM h LEFT JOIN m USING (doc_id)),
  s AS (SELECT section AS "group", count(*) AS pages, count(*) FILTER (td) AS title_duplicated, count(*) FILTER (meta = '') AS missing_meta_description FROM x GROUP BY section ORDER BY pages DESC, section LIMIT 5)
SELECT * FROM s UNION ALL SELECT 'pages carrying leads', count(*), count(*) FILTER (td), count(*) FILTER (meta = '') FROM x WHERE leads""")
def health_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _doc_health(spark, sf_dir).withColumn("section", F.split("url", "/")[3])
    return pg.health_groups(rows, "section", 5).select("group", "pages", "title_duplicated", "missing_meta_description")


@_query(f"""WITH e AS ({_ENTITIES}) SELECT (SELECT count(*) FROM documents) AS pages, count(DISTINCT url) AS tagged, count(*) AS tags, count(DISTINCT entity_type || entity) AS entities, round_even(count(*) / count(DISTINCT url), 2) AS mean_tags FROM e""")
def tag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.tag_summary(_read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url")), _tagged(spark, sf_dir))
