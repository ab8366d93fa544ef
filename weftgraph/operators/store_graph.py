"""The link graph of a stored crawl, and the wins that the configuration adds to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftgraph.functions import predicates as p, urls
from weftgraph.operators.frontier import resolve
from weftgraph.operators.graph import Graph, build_graph

EXPLORED_STATUSES = ("ok", "http_error")


def graph_from_store(pages: DataFrame, links: DataFrame, aliases: DataFrame, win: p.Win | None = None, require_form: bool = False) -> Graph:
    """The graph of the stored pages, links and aliases; nodes have status and external, with win also win_type and
    conversion_class.

    Pages whose status is offsite go, as do links to them; so do links out of scope, but to a conversion page. Links are
    resolved through aliases.
    """
    offsite = pages.filter("status = 'offsite'").select("url")
    explored = F.coalesce(F.col("status").isin(*EXPLORED_STATUSES), F.lit(False))
    missing = explored & F.coalesce(~F.col("form_present"), F.lit(False))
    own = pages.filter(F.coalesce(F.col("status") != "offsite", F.lit(True))).select("url", explored.alias("explored"), F.coalesce("win", F.lit(False)).alias("win"), "win_source", "status", missing.alias("form_missing"))
    wanted = F.coalesce(F.col("in_scope"), F.lit(False))
    if win is not None:
        wanted |= F.coalesce(win.destination(F.col("url")), F.lit(False))
    held = resolve(links.filter("url <> ''").filter(wanted), aliases).join(offsite, "url", "left_anti")
    graph = build_graph(own, held.select("src", F.col("url").alias("dst"), "region", F.coalesce("operator", F.lit(False)).alias("operator")))
    graph = Graph(graph.nodes.withColumn("external", F.coalesce(F.col("status") == "external", F.lit(False))), graph.edges)
    return graph if win is None else mark_pattern_wins(graph, win, require_form)


def mark_pattern_wins(graph: Graph, win: p.Win, require_form: bool = False) -> Graph:
    """Nodes with the wins of the configuration: known pages that no node is are added, excluded wins that no operator
    marked are undone, and URLs that match are wins, but for loaded pages without a required form."""
    spark, url = graph.nodes.sparkSession, F.col("url")
    nodes = graph.nodes
    if win.known_pages:
        known = spark.createDataFrame([(page, urls.normal_url(page) or page) for page, _ in win.known_pages], "page string, url string").dropDuplicates(["url"])
        linked = nodes.select(win.known_page(url).alias("page")).filter("page is not null").distinct()
        fresh = known.join(linked, "page", "left_anti").filter(~win.excluded(F.col("page"))).join(nodes.select("url"), "url", "left_anti")
        added = fresh.select("url", *(F.lit(False).alias(c) for c in ("explored", "win", "form_missing", "external")))
        nodes = nodes.unionByName(added, allowMissingColumns=True)
    source = F.col("win_source")
    undone = F.col("win") & F.coalesce(source != "operator", F.lit(True)) & win.excluded(url)
    nodes = nodes.withColumns({"win": F.col("win") & ~undone, "win_source": F.when(~undone, source)})
    hit = ~F.col("win") & win.matches(url)
    if require_form:
        hit &= ~F.coalesce("form_missing", F.lit(False))
    name = F.when(win.known_page(url).isNotNull(), "known").otherwise("pattern")
    nodes = nodes.withColumns({"win": F.col("win") | hit, "win_source": F.when(hit, name).otherwise(source)})
    kind = F.when(source == "operator", "operator").otherwise(F.coalesce(win.type_of(url), F.lit(win.name)))
    nodes = nodes.withColumn("win_type", F.when(F.col("win"), kind)).withColumn("conversion_class", F.coalesce(win.class_of(url), F.col("win_type")))
    return Graph(nodes.drop("form_missing"), graph.edges)
