"""What is said about each page: categories, health, gone pages and the links to them, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftgraph.functions import urls
from weftgraph.operators.frontier import resolve

LOADED = ("ok", "http_error")


def loaded() -> Column:
    return F.col("status").isin(*LOADED)


def reach_label(state: Column, in_loop: Column) -> Column:
    """From the state of operators.graph.dead_zones and whether the node is in a trap loop; null state: not reached."""
    return (
        F.when(state.isNull(), "not reached")
        .when(state == "win", "win")
        .when(in_loop, "trap loop")
        .when(state.isin("dead end", "reaches win"), state)
        .otherwise("unknown")
    )


def categorize(pages: DataFrame, wins: DataFrame, reach: DataFrame, locales: tuple[str, ...] = ()) -> DataFrame:
    """One row for each stored page that is in the graph. reach(url, reach_all_links, clicks_all, reach_content_only,
    clicks_content); wins(url, win_source)."""
    rows = pages.filter("status <> 'external'").join(wins.withColumn("is_win", F.lit(True)), "url", "left")
    rows = rows.withColumn("is_win", F.coalesce("is_win", F.lit(False))).withColumn("section", urls.section_of(F.col("url"), locales))
    h1 = F.size(F.filter(F.coalesce("headings", F.array()), lambda h: (h["level"] == 1) & (urls.strip(h["text"]) != "")))
    types = F.coalesce("jsonld_types", F.array())
    no_description = F.coalesce(F.col("meta_description"), F.lit("")) == ""
    return rows.join(reach, "url", "left").select(
        "url", urls.host_of(F.col("url")).alias("host"), "section",
        urls.page_type_of(F.col("url"), types, F.col("is_win"), F.col("section")).alias("page_type"),
        "title", "status", "depth", "http_status", "load_ms",
        F.when(F.col("is_win"), "win").otherwise(F.coalesce("reach_all_links", F.lit("not reached"))).alias("reach_all_links"),
        F.col("clicks_all").alias("clicks_to_win_all_links"),
        F.when(F.col("is_win"), "win").otherwise(F.coalesce("reach_content_only", F.lit("not reached"))).alias("reach_content_only"),
        F.col("clicks_content").alias("clicks_to_win_content_only"),
        "js_dependent", F.array_join(types, ", ").alias("structured_data"), F.coalesce(h1, F.lit(0)).alias("h1_count"),
        (loaded() & no_description).alias("missing_meta_description"),
        (F.col("is_win") & F.coalesce(~F.col("form_present"), F.lit(False))).alias("win_form_missing"),
        F.coalesce(F.col("win_source") == "operator", F.lit(False)).alias("operator_marked_win"),
    )


def summarize(categories: DataFrame, key: str) -> DataFrame:
    """Loaded pages by `key` (section or page_type), largest group first."""
    good, stuck = ("win", "reaches win"), ("dead end", "trap loop")
    grouped = categories.filter(loaded()).groupBy(key).agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("reach_all_links").isin(*good)).alias("reach_win_all_links"),
        F.count_if(F.col("reach_content_only").isin(*good)).alias("reach_win_content_only"),
        F.median("clicks_to_win_content_only").alias("median_clicks_content_only"),
        F.count_if(F.col("reach_content_only").isin(*stuck)).alias("dead_or_trap_content_only"),
        F.count_if("js_dependent").alias("js_dependent"),
    )
    return grouped.orderBy(F.desc("pages"), key)


def signals(categories: DataFrame) -> DataFrame:
    return categories.filter(loaded()).agg(
        F.count_if("js_dependent").alias("js_dependent"),
        F.count_if(F.col("structured_data") == "").alias("no_structured_data"),
        F.count_if(F.col("h1_count") == 0).alias("missing_h1"),
        F.count_if(F.col("h1_count") > 1).alias("multiple_h1"),
        F.count_if("missing_meta_description").alias("missing_meta_description"),
        F.count_if(F.col("load_ms") > 3000).alias("slow_over_3s"),
        F.count_if("win_form_missing").alias("win_form_missing"),
    )


def duplicated(pages: DataFrame, column: str) -> DataFrame:
    """pages with `<column>_duplicated`: another row has the same text, but for case and outer white space.

    Counted first and joined, so that a text that many pages share needs no task of its own.
    """
    key = urls.strip(F.lower(column))
    counts = pages.filter(F.col(column) != "").groupBy(key.alias("__key")).agg((F.count("*") > 1).alias("__many"))
    keyed = pages.withColumn("__key", F.when(F.col(column) != "", key)).join(counts, "__key", "left")
    return keyed.withColumn(f"{column}_duplicated", F.coalesce("__many", F.lit(False))).drop("__key", "__many")


def dead_links(links: DataFrame, aliases: DataFrame, dead: DataFrame) -> DataFrame:
    """Links, resolved through aliases, to dead(url, ...) pages from live ones; self-links do not count."""
    gone = dead.select(F.col("url").alias("dead_url")).distinct()
    to = resolve(links.filter("url is not null"), aliases).withColumnRenamed("url", "dead_url")
    return to.join(gone, "dead_url").filter("src <> dead_url").join(gone.withColumnRenamed("dead_url", "src"), "src", "left_anti")


def dead_annotations(dead: DataFrame, found: DataFrame) -> DataFrame:
    counts = found.groupBy(F.col("dead_url").alias("url")).agg(
        F.count("*").alias("links"), F.countDistinct("src").alias("pages"), F.count_if(F.col("region") == "body").alias("body_links")
    )
    return dead.select("url", "dead_reason").join(counts, "url", "left").fillna(0, ["links", "pages", "body_links"])


def page_health(pages: DataFrame, depths: DataFrame, inbound: DataFrame, dead_sources: DataFrame, tagged: DataFrame, shares: DataFrame) -> DataFrame:
    """One row for each loaded page. depths(url, all_links, body_links), inbound(url, in_degree), dead_sources(url,
    pages), tagged(url), shares(url, leads)."""
    rows = duplicated(duplicated(pages.filter(loaded()), "title"), "meta_description")
    rows = rows.join(depths, "url", "left").join(inbound, "url", "left").join(dead_sources.withColumnRenamed("pages", "__dead_pages"), "url", "left")
    rows = rows.join(tagged.select("url").distinct().withColumn("__tagged", F.lit(True)), "url", "left").join(shares, "url", "left")
    none = F.array().cast("array<string>")
    types = [F.coalesce(c, none) for c in ("jsonld_types", "microdata_types", "rdfa_types")]
    rendered = F.when(F.col("rendered_text_len") > 0, F.col("rendered_text_len"))
    return rows.select(
        "url", urls.host_of(F.col("url")).alias("host"), "status",
        F.col("all_links").alias("clicks_from_home_all_links"), F.col("body_links").alias("clicks_from_home_body_links"),
        F.coalesce("in_degree", F.lit(0)).alias("inbound_links"), F.coalesce("is_dead", F.lit(False)).alias("is_dead"),
        F.coalesce("__dead_pages", F.lit(0)).alias("dead_inbound_pages"),
        F.coalesce(F.col("title") != "", F.lit(False)).alias("has_title"), "title_duplicated",
        F.coalesce(F.col("meta_description") != "", F.lit(False)).alias("has_meta_description"), F.col("meta_description_duplicated").alias("meta_duplicated"),
        "h1_count", "h1_empty_count", F.when(F.col("canonical") != "", F.col("canonical") == F.col("url")).alias("canonical_self"),
        (F.size(F.concat(*types)) > 0).alias("has_structured_data"),
        *(F.array_join(F.coalesce(c, none), ", ").alias(c) for c in ("jsonld_types", "microdata_types", "rdfa_types", "og_properties", "hreflang")),
        F.coalesce("robots_meta", F.lit("")).alias("robots_meta"),
        (F.col("raw_text_len") < rendered / 2).alias("js_dependent"), F.bround(F.col("raw_text_len") / rendered, 3).alias("raw_text_share"),
        F.greatest(F.lit(0), F.size(F.coalesce("redirect_chain", none)) - 1).alias("redirect_hops"),
        F.coalesce("__tagged", F.lit(False)).alias("carries_lead_tags"),
        F.floor(F.coalesce("leads", F.lit(0.0)) + 1e-9).alias("leads_allocated"), F.col("leads").isNotNull().alias("carries_leads"),
    )


def health_summary(health: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(c)
    return health.agg(
        F.count("*").alias("pages"), n("is_dead").alias("dead"), n(~F.col("has_structured_data")).alias("no_structured_data"), n("js_dependent").alias("js_dependent"),
        n(~F.col("has_title")).alias("missing_title"), n("title_duplicated").alias("title_duplicated"), n(~F.col("has_meta_description")).alias("missing_meta_description"),
        n("meta_duplicated").alias("meta_duplicated"), n(F.col("h1_count") == 1).alias("h1_one"), n(F.col("h1_count") == 0).alias("h1_missing"),
        n(F.col("h1_count") > 1).alias("h1_multiple"), n(F.col("h1_empty_count") > 0).alias("h1_empty"), n(F.col("canonical_self").isNull()).alias("canonical_missing"),
        n(~F.col("canonical_self")).alias("canonical_elsewhere"), n(F.col("redirect_hops") > 0).alias("redirected"), n(F.col("microdata_types") != "").alias("with_microdata"),
        n(F.col("rdfa_types") != "").alias("with_rdfa"), n(F.col("og_properties") != "").alias("with_open_graph"), n(F.col("hreflang") != "").alias("with_hreflang"),
        n(F.col("robots_meta").contains("noindex")).alias("noindex"), n(F.col("clicks_from_home_all_links").isNull()).alias("unreachable_from_home_all"),
        n(F.col("clicks_from_home_body_links").isNull()).alias("unreachable_from_home_body"),
        F.median("clicks_from_home_all_links").alias("median_clicks_from_home_all"), F.median("clicks_from_home_body_links").alias("median_clicks_from_home_body"),
    )


def health_groups(health: DataFrame, key: str, n: int = 20) -> DataFrame:
    """(group, pages, dead, title_duplicated, missing_meta_description, h1_missing) by `key`, the largest n, and of pages that carry leads."""
    both = F.explode(F.array_compact(F.array(F.struct(F.lit(0).alias("kind"), F.col(key).alias("group")), F.when(F.col("carries_leads"), F.struct(F.lit(1).alias("kind"), F.lit("pages carrying leads").alias("group"))))))
    counted = health.withColumn("g", both).groupBy("g.kind", "g.group").agg(
        F.count("*").alias("pages"), F.count_if("is_dead").alias("dead"), F.count_if("title_duplicated").alias("title_duplicated"),
        F.count_if(~F.col("has_meta_description")).alias("missing_meta_description"), F.count_if(F.col("h1_count") == 0).alias("h1_missing"),
    )
    return top_by(counted, "kind", n, F.desc("pages"), "group").drop("kind", "rank")


def first_link_text(links: DataFrame) -> DataFrame:
    """(src, url, text): the text of the first link between each two pages, by id."""
    return links.groupBy("src", "url").agg(F.min_by("text", "id").alias("text"))


def top_by(df: DataFrame, partition: str, n: int, *order) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(partition).orderBy(*order))
    return df.withColumn("rank", place).filter(F.col("rank") <= n)
