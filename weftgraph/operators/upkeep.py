"""Counts, listings and repairs over a stored crawl."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftgraph.functions import predicates as p, urls
from weftgraph.operators.frontier import resolve
from weftgraph.operators.graph import CHROME


def status_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("status").agg(F.count("*").alias("pages"))


def link_counts(links: DataFrame) -> DataFrame:
    """(links, tags, tag_pages): all links, different campaign tags, and pages that carry one."""
    tagged = F.col("mc_id").isNotNull()
    return links.agg(F.count("*").alias("links"), F.count_distinct("mc_id").alias("tags"), F.count_distinct(F.when(tagged, F.col("src"))).alias("tag_pages"))


def site_bases(pages: DataFrame, domains: list[str]) -> DataFrame:
    """(base): scheme and host of the pages on allowed hosts."""
    base = F.regexp_extract("url", r"(?i)^([a-z][a-z0-9+.-]*://[^/?#]*)", 1)
    return pages.filter(urls.host_allowed(F.col("url"), domains)).select(base.alias("base")).distinct()


def short_labels(pages: DataFrame) -> DataFrame:
    """(url, label): the path and query on the host that most pages have, of equal ones the least, else the host before it.

    The most common host is one row, joined by a broadcast."""
    rows = pages.select("url", urls.host_of(F.col("url")).alias("host"))
    main = rows.groupBy("host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(1).select(F.col("host").alias("main"))
    rest = F.regexp_extract("url", r"^[^:]+://[^/?#]*([^#]*)", 1)
    rest = F.when(rest == "", "/").otherwise(rest)
    return rows.join(F.broadcast(main), F.col("host") == F.col("main"), "left").select("url", F.when(F.col("main").isNotNull(), rest).otherwise(F.concat("host", rest)).alias("label"))


def conversion_matches(conversions: DataFrame, nodes: DataFrame) -> DataFrame:
    """conversions(page, ...) with the node that is the page in any case; of several such nodes the greatest URL."""
    held = nodes.groupBy(F.lower("url").alias("__key")).agg(F.max("url").alias("node"))
    return conversions.withColumn("__key", F.lower("page")).join(held, "__key", "left").drop("__key")


def win_checks(links: DataFrame, aliases: DataFrame, destination: Column, most: int | None = 100) -> DataFrame:
    """(url, links): link targets that are a destination, with the number of different links to each, most linked first.

    `most` is how many of them are visited."""
    once = resolve(links.select("src", "url").distinct(), aliases)
    counted = once.filter(F.coalesce(destination, F.lit(False))).groupBy("url").agg(F.count("*").alias("links")).orderBy(F.desc("links"), "url")
    return counted if most is None else counted.limit(most)


def missing_page_tags(pages: DataFrame, tags: DataFrame, links: DataFrame) -> DataFrame:
    """(url, nav_labels): for loaded pages without tags the texts of the links in their own frames, each once."""
    lacking = pages.filter(F.col("status").isin("ok", "http_error")).join(tags.select("url"), "url", "left_anti").select("url")
    own = links.filter(F.col("region").isin(*CHROME) & (F.col("text") != "")).groupBy(F.col("src").alias("url"))
    labels = own.agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("x"))
    return lacking.join(labels, "url", "left").select("url", F.coalesce(F.array_distinct(F.transform("x", lambda x: x["text"])), F.array().cast("array<string>")).alias("nav_labels"))


def win_pages(nodes: DataFrame, inbound: DataFrame, checks: DataFrame) -> DataFrame:
    """(url, win_type, linked_from, reason) of wins: marked by the operator, form found, a known page, a fitting URL."""
    reason = (
        F.when(F.col("win_source") == "operator", "marked by the operator")
        .when(F.col("gone"), "gone")
        .when(F.col("win_source") == "form", "form found")
        .when(F.col("win_source") == "known", "known page")
        .otherwise("URL fits")
    )
    rows = nodes.filter("win").join(inbound, "url", "left").join(checks.select("url", "gone"), "url", "left")
    return rows.select("url", "win_type", F.coalesce("in_degree", F.lit(0)).alias("linked_from"), reason.alias("reason"))


def near_misses(nodes: DataFrame, inbound: DataFrame, win: p.Win) -> DataFrame:
    """(url, linked_from): pages that are no win but whose path holds a word of one."""
    rows = nodes.filter(~F.col("win") & win.near_miss(F.col("url"))).join(inbound, "url", "left")
    return rows.select("url", F.coalesce("in_degree", F.lit(0)).alias("linked_from"))


def screenshot_name(url: Column) -> Column:
    return F.concat(F.substring(F.sha1(url.cast("binary")), 1, 16), F.lit(".png"))


def plain_median(column: str) -> Column:
    """The median as text, without decimals where it is whole."""
    m = F.median(column)
    return F.when(m == F.floor(m), F.floor(m).cast("string")).otherwise(m.cast("string"))


# ---- proposals for a taxonomy


def parse_reply(reply: str | None) -> list[dict]:
    """The entities of the outermost braces of a model's reply; none where that is no JSON of the wanted shape."""
    held = re.search(r"\{.*\}", reply or "", re.DOTALL)
    try:
        found = json.loads(held[0]).get("entities") if held else None
    except ValueError:
        return []
    return [e for e in found if isinstance(e, dict)] if isinstance(found, list) else []


def merge_proposals(proposals: DataFrame) -> DataFrame:
    """(entity_type, name, terms, urls, pages) of proposals(url, entity_type, name, terms): one row for each type and name
    in any case, under its least spelling, with all terms in any case once; those on most pages first."""
    key = F.lower(urls.collapse(F.col("name")))
    named = proposals.withColumn("__key", key).filter("__key <> ''")
    heads = named.groupBy("entity_type", "__key").agg(F.min("name").alias("name"), F.array_sort(F.collect_set("url")).alias("urls"))
    term = named.select("entity_type", "__key", F.explode("terms").alias("t")).withColumn("low", F.lower(urls.collapse(F.col("t")))).filter("low <> ''")
    terms = term.groupBy("entity_type", "__key").agg(F.array_sort(F.collect_set("low")).alias("terms"))
    joined = heads.join(terms, ["entity_type", "__key"], "left").withColumn("pages", F.size("urls"))
    return joined.select("entity_type", "name", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), "urls", "pages").orderBy(F.desc("pages"), "entity_type", "name")


def accept_proposals(proposals: DataFrame, least_pages: int, taken: DataFrame) -> DataFrame:
    """Merged proposals with `verdict`: too few pages, in the taxonomy already (taken: entity_type, name), else accepted."""
    known = taken.select("entity_type", F.lower("name").alias("__key"), F.lit(True).alias("__known")).distinct()
    rows = proposals.withColumn("__key", F.lower("name")).join(known, ["entity_type", "__key"], "left")
    verdict = F.when(F.col("__known"), "known").when(F.col("pages") < least_pages, "too few pages").otherwise("accepted")
    return rows.withColumn("verdict", verdict).drop("__key", "__known")


def first_in_group(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each group in the given order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", place).filter("__n = 1").drop("__n")
