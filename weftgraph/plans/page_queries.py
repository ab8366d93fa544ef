"""Queries over pages, texts and orders, each a view of the test tables that an operator is applied to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftgraph.functions import predicates as p, urls
from weftgraph.operators import compare, entities, graph as g, leads, pages as pg
from weftgraph.operators.frontier import survivors
from weftgraph.plans.journey import GRAPH_SQL, journey_graph
from weftgraph.sources import html
from weftgraph.storage import durable

STRIP = ("utm_*", "ref")
WIN = p.Win(name="contact", url_patterns=("*/en/1*", "re:.*/de/[0-9]+\\.html"), exclude_patterns=("*page=2*",), near_miss_keywords=("/en/",))
SCOPE = p.Scope(allowed_domains=("therou.example.com", "m.therou.example.com", "blog.tionsh.example.net", "thther.example.org"), locale_include=("/en/", "/de/"))
ROBOTS = """User-agent: *
Disallow: /de/
Allow: /de/1
Disallow: /*.html$
Allow: /en/*.html$
Sitemap: https://example.com/sitemap.xml
User-agent: OtherBot
Disallow: /
"""
TAXONOMY = [("Function", "Conjunction", ["and", "und"]), ("Function", "Article", ["the", "der", "la", "le"]), ("Form", "Stem", ["ther*", "tion*"]), ("Form", "Code", [r"re:[A-Z]{4}[0-9]{2}"])]
TOPICS = [("Joining", ["and", "und"]), ("Pointing", ["the", "der", "la"]), ("Ending", ["tion*"])]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalized_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return pages.select("page_id", urls.normalize_url(F.col("url"), stripped=STRIP).alias("normal"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    types = F.array().cast("array<string>")
    section = urls.section_of(url, ("/en/", "/de/"))
    return _read(spark, sf_dir, "pages").select(
        "page_id", urls.host_of(url).alias("host"), section.alias("section"), urls.page_type_of(url, types, F.lit(False), section).alias("page_type"),
        urls.conversion_url(url).alias("conversion"), urls.seed_url(url).alias("seed"), urls.slug(urls.host_of(url)).alias("slug"),
    )


def scope_and_win(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _read(spark, sf_dir, "pages").select("page_id", SCOPE.holds(url).alias("in_scope"), WIN.matches(url).alias("is_win"), WIN.type_of(url).alias("win_type"), WIN.near_miss(url).alias("near_miss"))


def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = p.robots_rules(ROBOTS, "weftbot")
    return _read(spark, sf_dir, "pages").select("page_id", p.robots_allowed(F.col("url"), rules).alias("allowed"))


def dead_and_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, (200, 404, 410, 403, 429, 200, 200))), (F.col("page_id") % 7 + 1).cast("int"))
    pages = _read(spark, sf_dir, "pages")
    found = html.extract_pages(pages.select(F.concat(F.coalesce("url", F.lit("")), F.lit("#"), "page_id").alias("url"), "html"))  # URLs repeat, page_ids do not
    read = found.select(F.substring_index("url", "#", -1).cast(pages.schema["page_id"].dataType).alias("page_id"), "title", "body_text")
    title, body = F.col("title"), F.col("body_text")
    return read.select("page_id", p.detect_dead(status, title, body).alias("dead_reason"), p.detect_block(status, title, body).alias("block_reason"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_links(_read(spark, sf_dir, "pages"), STRIP)


def link_extraction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).filter("region = 'nav'").groupBy("src", "href").agg(F.count("*").alias("n"), F.max("text").alias("text"))


def page_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract_pages(_read(spark, sf_dir, "pages"))
    return found.groupBy(F.col("h1_count").cast("long").alias("h1_count"), F.size("jsonld_types").cast("long").alias("n_types")).agg(F.count("*").alias("pages"), F.count("title").alias("titled"))


def survivor_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("url", F.when(F.col("page_id") % 5 == 0, "http_error").otherwise("ok").alias("status")).dropDuplicates(["url"])
    none = spark.createDataFrame([], "src string")
    key = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^http:", "https:")
    return survivors(pages, none, key).select("url", "key", "keep", "is_kept")


def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"))
    return pg.duplicated(docs, "title").select("doc_id", "title_duplicated")


def boilerplate_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), F.array().cast("array<string>").alias("headings"), F.col("text").alias("body"))
    grams = entities.repeated_grams(entities.page_words(docs), 8, 3)
    return entities.common_grams(grams, 3).select(F.replace("gram", F.lit("\x1f"), F.lit(" ")).alias("gram"), "pages")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    view = docs.select(F.col("doc_id").cast("string").alias("url"), F.substring_index("text", "\n", 1).alias("title"), F.array("source").alias("headings"), F.col("text").alias("body"))
    return entities.tag_entities(view, TAXONOMY, least_score=3.0)


def entity_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir)


def _journey_tags(spark: SparkSession, sf_dir: str) -> tuple[g.Graph, DataFrame, DataFrame]:
    """The journey graph with tags on its nodes: the place's number gives two entities and a score."""
    graph, _ = journey_graph(spark, sf_dir)
    k, user = F.split("url", ":")[1].cast("int"), F.split("url", ":")[0].cast("int")
    tag = lambda kind, c, score: F.struct(F.lit(kind).alias("entity_type"), c.cast("string").alias("entity"), score.cast("double").alias("score"))
    tags = graph.nodes.filter(k % 3 == 0).select("url", F.explode(F.array(tag("Place", k, k % 4 + 1), tag("Group", user % 50, user % 3 + 1))).alias("t")).select("url", "t.*")
    wide = g.distances_to_win(graph).groupBy(F.col("node").alias("url")).pivot("label", [g.ALL_LINKS, g.CONTENT_ONLY]).agg(F.first("d"))
    return graph, tags, durable(wide.withColumnsRenamed({g.ALL_LINKS: "d_all", g.CONTENT_ONLY: "d_content"}), "journey-dist")


def entity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, tags, dist = _journey_tags(spark, sf_dir)
    return entities.entity_coverage(tags, graph.nodes, dist)


def bridge_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, tags, dist = _journey_tags(spark, sf_dir)
    content = g.mode_view(graph, g.CONTENT_ONLY)
    found = entities.bridge_links(tags, graph.nodes, dist.select("url", F.col("d_content").alias("d")), content)
    return found.select("url", F.col("page_clicks_to_win_content").cast("long").alias("clicks"), F.col("rank").cast("long").alias("rank"), "bridge_page", "shared_score", "shared_entities")


def topic_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    title = F.substring_index("text", "\n", 1)
    rest = F.substr("text", F.length(title) + 2)  # all lines but the first
    fields = docs.select(F.col("doc_id").cast("string").alias("url"), title.alias("title"), F.col("lang").alias("h1"), F.lit(None).cast("string").alias("breadcrumb"), rest.alias("nav_label"), F.col("source").alias("url_path"))
    return entities.tag_topics(fields, TOPICS)


def topic_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), F.col("lang").alias("site"), (F.col("n_chars") % 9).alias("home_all"), F.when(F.col("n_chars") % 5 > 0, F.col("n_chars") % 5).alias("win_all"))
    topics = topic_tags(spark, sf_dir).join(docs.select("url", "site"), "url").select("site", "url", "topic")
    return compare.topic_matrix(topics, docs, [*(t for t, _ in TOPICS), "Nothing"])


def site_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    n = F.col("n_chars")
    pages = docs.select(
        F.col("source").alias("site"), (n % 9).alias("home_all"), F.when(n % 5 > 0, n % 5).alias("win_all"), F.when(n % 7 > 2, n % 7).alias("win_body"), (n % 4).alias("inbound_live"),
        F.when(n % 3 == 0, "content").otherwise("product").alias("page_type"), F.when(n % 11 > 0, n % 2 == 0).alias("one_h1"),
    )
    return compare.site_scalars(pages, "site")


def _lead_view(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Part types as campaign tags that suppliers' pages carry; leads are numbers of parts sold, some tags with a suffix."""
    item, part = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "part")
    kinds = part.select("p_partkey", F.concat_ws("_", "p_type", F.col("p_size").cast("string")).alias("kind"))
    sold = item.join(kinds, item["l_partkey"] == kinds["p_partkey"])
    counts = sold.groupBy("kind").agg(F.sum("l_quantity").alias("leads"))
    number = F.length("kind") % 4
    tag = F.when(number == 1, F.concat("kind", F.lit("_123456"))).when(number == 2, F.concat(F.lit("NONE_"), "kind")).otherwise(F.col("kind"))
    page = F.concat(F.lit("https://s.example/"), F.length("kind") % 7)
    tags = counts.select(tag.alias("lead_tag"), "leads", page.alias("main_conversion_page"))
    links = sold.select(F.col("kind").alias("mc_id"), F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("https://s.example/"), F.col("l_suppkey") % 7).alias("url"), F.lit("").alias("href"), F.when(F.col("l_linenumber") > 3, "nav").otherwise("body").alias("region"))
    none = spark.createDataFrame([], "url string, final_url string")
    return tags, durable(leads.tagged_links(links.distinct(), none), "lead-carriers")


def lead_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags, carriers = _lead_view(spark, sf_dir)
    rows, _ = leads.attribute(tags, carriers)
    return rows.select("src", "mc_id", "lead_tag", "join_type", "region", F.col("tag_source_pages").cast("long").alias("tag_source_pages"), F.round("leads_allocated", 6).alias("leads_allocated"), "attribution", F.col("leads_whole").cast("long").alias("leads_whole"))


def lead_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags, carriers = _lead_view(spark, sf_dir)
    _, found = leads.attribute(tags, carriers)
    return found.groupBy("join_type", "lands_on_target").agg(F.count("*").alias("tags"), F.sum("leads").alias("leads"), F.sum("tag_source_pages").alias("pages"))


def lead_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags, _ = _lead_view(spark, sf_dir)
    return leads.rollup(tags, 1000)


def zero_lead_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags, carriers = _lead_view(spark, sf_dir)
    rows, _ = leads.attribute(tags, carriers)
    wins = spark.range(3).select(F.concat(F.lit("https://s.example/"), "id").alias("url"), F.lit("shop").alias("win_type"))
    return leads.zero_lead_tags(carriers, rows, wins)


def section_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, "section")


def page_type_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, "page_type")


def _rollup(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """The journey's nodes as stored pages of sections by their place's number."""
    graph, _ = journey_graph(spark, sf_dir)
    k = F.split("url", ":")[1].cast("int")
    dist = g.distances_to_win(graph, (g.CONTENT_ONLY,)).select(F.col("node").alias("url"), "d")
    rows = graph.nodes.filter("explored").join(dist, "url", "left")
    label = F.when(F.col("win"), "win").when(F.col("d").isNotNull(), "reaches win").otherwise("dead end")
    page = F.concat(F.lit("https://x.com/en/"), F.element_at(F.array(*map(F.lit, ("Track", "news.html", "about", "shop", "support"))), k % 5 + 1), F.lit("/"), k)
    kind = urls.page_type_of(page, F.array().cast("array<string>"), F.col("win"), urls.section_of(page, ("/en/",)))
    cats = rows.select(
        urls.section_of(page, ("/en/",)).alias("section"), kind.alias("page_type"), F.lit("ok").alias("status"), label.alias("reach_all_links"), label.alias("reach_content_only"),
        F.col("d").alias("clicks_to_win_content_only"), (k % 2 == 0).alias("js_dependent"),
    )
    return pg.summarize(cats, key)


def dead_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, _ = journey_graph(spark, sf_dir)
    k = F.split("url", ":")[1].cast("int")
    dead = graph.nodes.filter(k == 7).select("url", F.lit("HTTP 404").alias("dead_reason"))
    links = graph.edges.select("src", F.col("dst").alias("url"), F.when(g.in_body(), "body").otherwise("nav").alias("region"))
    none = spark.createDataFrame([], "url string, final_url string")
    return pg.dead_annotations(dead, pg.dead_links(links, none, dead)).select("url", "links", "pages", "body_links")


QUERIES = {
    f.__name__: f
    for f in (
        normalized_urls, url_parts, scope_and_win, robots_allowed, dead_and_blocked, link_extraction_counts, page_heads, survivor_merge, duplicate_titles,
        boilerplate_grams, entity_tags, entity_coverage, bridge_links, topic_tags, topic_matrix, site_scalars, lead_attribution, lead_matches, lead_rollup,
        zero_lead_tags, section_rollup, page_type_rollup, dead_links,
    )
}
