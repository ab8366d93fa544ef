"""Lead counts of campaign tags, shared out over the pages whose links carry the tag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from weftgraph.functions.urls import archetype_of, clean_tag, conversion_url, strip_suffix
from weftgraph.operators.frontier import resolve

# Fixed value: the name of the row for small counts.
OTHER = "(other, <{n} leads)"


def tagged_links(links: DataFrame, aliases: DataFrame) -> DataFrame:
    """(tag, src, targets, regions) of links(src, url, href, region, mc_id); a link without a URL is its raw href."""
    held = resolve(links.filter("mc_id is not null"), aliases).withColumn("tag", clean_tag(F.col("mc_id"))).filter("tag <> ''")
    target = F.coalesce("url", F.when(F.col("href") != "", F.col("href")))
    some = F.when(F.col("region") != "", F.col("region"))
    return held.groupBy("tag", "src").agg(F.array_sort(F.collect_set(target)).alias("targets"), F.array_sort(F.collect_set(some)).alias("regions"))


def attribute(leads: DataFrame, carriers: DataFrame, fallback: bool = True) -> tuple[DataFrame, DataFrame]:
    """(attribution, matches). leads(lead_tag, leads, main_conversion_page); carriers as given by tagged_links.

    A lead tag is joined to the equal link tag, or only where there is none to all link tags that are equal but for a
    numeric suffix. Its leads are shared evenly among the pages that carry it.
    """
    exact = leads.join(carriers.withColumn("lead_tag", F.col("tag")), "lead_tag").withColumn("join_type", F.lit("exact"))
    joined = exact
    if fallback:
        rest = leads.join(carriers.select(F.col("tag").alias("lead_tag")).distinct(), "lead_tag", "left_anti")
        loose = rest.withColumn("__s", strip_suffix(F.col("lead_tag"))).join(carriers.withColumn("__s", strip_suffix(F.col("tag"))), "__s").drop("__s")
        joined = exact.unionByName(loose.withColumn("join_type", F.lit("fallback")))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    rows = joined.groupBy("lead_tag", "src", "join_type", "leads").agg(
        F.array_sort(F.collect_set("tag")).alias("tags"), union("targets").alias("targets"), union("regions").alias("regions")
    )
    sources = joined.groupBy("lead_tag").agg(F.countDistinct("src").alias("tag_source_pages"), union("targets").alias("all_targets"), F.array_sort(F.collect_set("tag")).alias("link_tags"), F.first("join_type").alias("join_type"))
    share = F.col("leads") / F.col("tag_source_pages")
    attribution = rows.join(sources.select("lead_tag", "tag_source_pages"), "lead_tag").select(
        "src", F.array_join("tags", ", ").alias("mc_id"), "tags", "lead_tag", "join_type", F.array_join("targets", " ").alias("targets"),
        F.array_join("regions", ",").alias("region"), F.col("leads").alias("tag_leads_total"), "tag_source_pages", share.alias("leads_allocated"),
        F.when(F.col("tag_source_pages") == 1, "exact").otherwise("shared").alias("attribution"), share.alias("share"), F.floor(share).alias("leads_whole"),
    )
    landed = F.exists("all_targets", lambda t: conversion_url(t) == F.col("main_conversion_page"))
    lands = F.when(F.col("main_conversion_page").isNotNull(), F.coalesce(landed, F.lit(False)))
    matches = leads.join(sources, "lead_tag", "left").select("lead_tag", "join_type", "link_tags", "leads", F.coalesce("tag_source_pages", F.lit(0)).alias("tag_source_pages"), "main_conversion_page", lands.alias("lands_on_target"))
    return attribution, matches


def sorted_attribution(attribution: DataFrame) -> DataFrame:
    return attribution.orderBy(F.desc("leads_allocated"), "src", "lead_tag")


def node_leads(attribution: DataFrame) -> DataFrame:
    """(url, leads, exact_leads, leads_whole) of each page; the whole number allows for rounding errors, which sums in any order have."""
    exact = F.sum(F.when(F.col("attribution") == "exact", F.col("share")).otherwise(0.0))
    grouped = attribution.groupBy(F.col("src").alias("url")).agg(F.sum("share").alias("leads"), exact.alias("exact_leads"))
    return grouped.withColumn("leads_whole", F.floor(F.round("leads", 6) + 1e-9))


def edge_leads(attribution: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, leads): a page's share of a tag, split evenly over the targets that it has an edge to."""
    out = attribution.select("src", "lead_tag", "share", F.explode(F.split("targets", " ")).alias("dst")).join(edges.select("src", "dst"), ["src", "dst"], "left_semi")
    n = F.count("*").over(Window.partitionBy("src", "lead_tag"))
    return out.withColumn("part", F.col("share") / n).groupBy("src", "dst").agg(F.sum("part").alias("leads"))


def rollup(leads: DataFrame, least: int = 5) -> DataFrame:
    """(tag, leads, tags): tags with fewer leads than `least` are one row, so that no small count shows."""
    big = F.col("leads") >= least
    name = F.when(big, F.col("lead_tag")).otherwise(OTHER.format(n=least))
    return leads.groupBy(name.alias("tag")).agg(F.sum("leads").alias("leads"), F.count("*").alias("tags"))


def zero_lead_tags(carriers: DataFrame, attribution: DataFrame, wins: DataFrame) -> DataFrame:
    """(tag, pages, win_pages, win_types) of link tags that no joined lead tag with leads uses."""
    paid = attribution.filter("tag_leads_total > 0").select(F.explode("tags").alias("tag")).distinct()
    left = carriers.join(paid, "tag", "left_anti").select("tag", "src", F.explode_outer("targets").alias("url"))
    typed = left.join(wins.select("url", "win_type", F.lit(True).alias("is_win")), "url", "left")
    grouped = typed.groupBy("tag").agg(
        F.countDistinct("src").alias("pages"),
        F.countDistinct(F.when(F.col("is_win"), F.col("src"))).alias("win_pages"),
        F.array_join(F.array_sort(F.collect_set("win_type")), ", ").alias("win_types"),
    )
    return grouped.orderBy(F.desc("win_pages"), F.desc("pages"), "tag")


def unrewarded_pages(carriers: DataFrame, attribution: DataFrame, wins: DataFrame) -> DataFrame:
    """(src): pages with a tagged link to a win that have no share of any lead."""
    to_win = carriers.select("src", F.explode("targets").alias("url")).join(wins.select("url"), "url", "left_semi").select("src").distinct()
    return to_win.join(attribution.select("src"), "src", "left_anti")


def archetypes(carriers: DataFrame, attribution: DataFrame, wins: DataFrame, pattern: str) -> DataFrame:
    """(archetype, tags, pages, win_pages, leads): tags by the named part of their name; a share counts for each of its
    tags in equal parts. Equal parts are counted before they are added, and added as decimals, so that the whole number of a sum
    doesn't depend on the order of millions of fractions."""
    kind = archetype_of(F.col("tag"), pattern)
    rows = carriers.withColumn("archetype", kind).filter("archetype is not null").select("archetype", "tag", "src", F.explode_outer("targets").alias("url"))
    win = rows.join(wins.select("url", F.lit(True).alias("is_win")), "url", "left")
    counts = win.groupBy("archetype").agg(F.countDistinct("tag").alias("tags"), F.countDistinct("src").alias("pages"), F.countDistinct(F.when(F.col("is_win"), F.col("src"))).alias("win_pages"))
    whole = (F.col("tag_leads_total").alias("of"), (F.col("tag_source_pages") * F.size("tags")).alias("among"))
    parts = attribution.select("lead_tag", *whole, F.explode("tags").alias("tag")).withColumn("archetype", kind)
    equal = parts.groupBy("archetype", "lead_tag", "of", "among").agg(F.count("*").alias("n"))
    part = (F.col("of") * F.col("n") / F.col("among")).cast("decimal(28,9)")
    sums = equal.groupBy("archetype").agg(F.floor(F.round(F.sum(part), 6)).cast("long").alias("leads"))
    return counts.join(sums, "archetype", "left").fillna(0, ["leads"])


def totals(leads: DataFrame, attribution: DataFrame, matches: DataFrame) -> DataFrame:
    n = lambda kind: F.count_if(F.col("join_type") == kind)
    row = matches.agg(
        F.count("*").alias("tags"), F.sum("leads").alias("leads_total"), n("exact").alias("matched_exact"), n("fallback").alias("matched_fallback"),
        F.sum(F.when(F.col("join_type").isNotNull(), F.col("leads")).otherwise(0.0)).alias("leads_matched"),
        F.count_if(F.col("lands_on_target") == F.lit(False)).alias("landed_elsewhere"),
    )
    pages = attribution.agg(F.countDistinct("src").alias("origin_pages"), F.count_if(F.col("attribution") == "exact").alias("exact_rows"), F.sum("leads_whole").alias("whole_leads"))
    return row.crossJoin(pages)


def main_conversion_pages(rows: DataFrame) -> DataFrame:
    """(lead_tag, main_conversion_page): the page with most leads of each tag, of equal ones the least URL."""
    sums = rows.filter("page is not null").groupBy("lead_tag", "page").agg(F.sum("leads").alias("n"))
    order = F.row_number().over(Window.partitionBy("lead_tag").orderBy(F.desc("n"), "page"))
    return sums.withColumn("__n", order).filter("__n = 1").select("lead_tag", F.col("page").alias("main_conversion_page"))


