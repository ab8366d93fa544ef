"""Repairs of a stored crawl from what it holds, written back as change sets: only rows that differ, only the files that hold them.

Nothing is fetched. URLs are normalized once for each spelling, whatever table they stand in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftgraph.functions import predicates as p, urls
from weftgraph.operators.crawl_store import heading_counts
from weftgraph.operators.frontier import survivors
from weftgraph.operators.upkeep import missing_page_tags
from weftgraph.sources.store import Change
from weftgraph.storage import durable

MOST_LABELS = 300  # of one page; fixed value of the stored format


def spellings(change: Change, normalize: Callable[[Column], Column]) -> DataFrame:
    """(url, key): the normalized spelling of every URL of pages, links and aliases that isn't normal."""
    named = change.table("pages").select("url")
    for table, column in (("links", "url"), ("aliases", "final_url"), ("pages", "canonical")):
        named = named.unionByName(change.table(table).select(F.col(column).alias("url")))
    named = named.filter("url is not null").distinct()
    # Python runs behind the shuffle, once for each spelling
    return durable(named.withColumn("key", normalize(F.col("url"))).filter("key is not null and key <> url"), "spellings")


def _respelled(rows: DataFrame, to: DataFrame, column: str) -> DataFrame:
    """rows whose column has another spelling in to(url, key), with that one."""
    return rows.join(to.select(F.col("url").alias(column), F.col("key").alias("__key")), column).withColumn(column, F.col("__key")).drop("__key")


def duplicate_groups(pages: DataFrame, links: DataFrame, spelled: DataFrame) -> DataFrame:
    """(url, key, keep): the pages of each group that is one page under `key`, and those stored under a spelling that isn't normal."""
    key = F.coalesce("__key", "url")
    known = pages.join(spelled.select("url", F.col("key").alias("__key")), "url", "left").withColumn("__key", key)
    several = known.groupBy("__key").agg(F.count("*").alias("__n"), F.max(F.col("url") != F.col("__key")).alias("__odd")).filter("__n > 1 or __odd").select("__key")
    members = durable(known.join(several, "__key"), "duplicate-pages")
    own = links.join(members.select(F.col("url").alias("src")), "src", "left_semi")
    return durable(survivors(members, own, F.col("__key")).select("url", "key", "keep"), "duplicate-groups")


def merge_pages(change: Change, normalize: Callable[[Column], Column]) -> dict[str, int]:
    """Merge pages that the normalization makes one, and renormalize link targets; how many pages went and links were renormalized.

    The page that loaded best stays (ok, http_error, others; then most links), under the normalized URL. The others' links move to
    it, equal ones once, and their URLs become its aliases, in every table that names them.
    """
    spelled = spellings(change, normalize)
    links = change.table("links")
    groups = duplicate_groups(change.table("pages"), links, spelled)
    renamed = durable(_respelled(links, spelled, "url"), "renormalized-links")
    n = renamed.count()
    change.upsert("links", renamed, ["id"])
    if not groups.isEmpty():
        moved = groups.filter("url <> key").select("url", "key")
        _move_links(change, groups)
        kept = change.table("pages").join(groups.filter("url = keep").select("url", "key"), "url").withColumn("url", F.col("key")).drop("key")
        change.exchange("pages", groups.select("url"), ["url"], durable(kept, "merged-pages"))
        names = moved.select("url", F.col("key").alias("final_url"))
        change.merge("aliases", names.unionByName(_respelled(change.table("aliases"), moved, "final_url").join(names.select("url"), "url", "left_anti").select("url", "final_url")), ["url"])
        change.merge("entries", _respelled(change.table("entries"), moved, "node_url"), ["idx"])
        change.delete("queue", moved, ["url"])
        change.delete("page_entities", moved, ["url"])
        _move_rows(change, "lead_attribution", "src", moved)
    # an alias of a page that is stored under another spelling
    late = _respelled(change.table("aliases"), spelled, "final_url").join(change.table("pages").select(F.col("url").alias("final_url")), "final_url", "left_semi")
    change.merge("aliases", late.select("url", "final_url"), ["url"])
    return {"pages_merged": groups.filter("url <> keep").count(), "links_renormalized": n}


def _move_links(change: Change, groups: DataFrame) -> None:
    """Links of the groups' pages, under the group's key and equal ones once, the first by id."""
    to = groups.select(F.col("url").alias("src"), "key")
    own = change.table("links").join(to, "src").withColumn("src", F.col("key")).drop("key")
    same = ["src", "href", "url", "text", "region", "operator", F.coalesce("mc_id", F.lit(""))]
    once = own.withColumn("__n", F.row_number().over(Window.partitionBy(*same).orderBy("id"))).filter("__n = 1").drop("__n")
    change.exchange("links", groups.select(F.col("url").alias("src")), ["src"], durable(once, "moved-links"))


def _move_rows(change: Change, table: str, column: str, moved: DataFrame) -> None:
    rows = durable(_respelled(change.table(table), moved, column), "moved-rows")
    change.exchange(table, moved.select(F.col("url").alias(column)), [column], rows)


def fill_links(change: Change, capture: tuple[str, ...]) -> None:
    """mc_id and params of all links, from their hrefs."""
    links = change.table("links")
    found = links.select("href").filter("href is not null").distinct().withColumn("__found", urls.captured_params(F.col("href"), capture))
    found = durable(found.filter(F.size("__found") > 0), "captured")
    rows = links.join(found, "href", "left").withColumns({"params": F.col("__found"), "mc_id": F.col("__found")[capture[0]] if capture else F.lit(None).cast("string")})
    change.merge("links", rows.drop("__found"), ["id"])


def fill_pages(change: Change, spelled: DataFrame) -> None:
    """Counts of headings, normalized canonical URLs, and which pages are gone, from what the pages hold."""
    pages = change.table("pages")
    counted, empty = heading_counts()
    known = F.col("headings").isNotNull()
    canonical = spelled.select(F.col("url").alias("canonical"), F.col("key").alias("__canonical"))
    reason = p.detect_dead(F.col("http_status"), F.col("title"), F.col("body_text"))
    loaded = F.col("status").isin("ok", "http_error")
    rows = pages.join(canonical, "canonical", "left").withColumns({
        "canonical": F.coalesce("__canonical", "canonical"),
        "h1_count": F.when(known, counted).otherwise(F.col("h1_count")),
        "h1_empty_count": F.when(known, empty).otherwise(F.col("h1_empty_count")),
        "is_dead": F.when(loaded, reason.isNotNull()).otherwise(F.col("is_dead")),
        "dead_reason": F.when(loaded, reason).otherwise(F.col("dead_reason")),
    })
    change.merge("pages", rows.drop("__canonical"), ["url"])


def fill_page_tags(change: Change) -> int:
    """Tags of loaded pages that have none, rebuilt from title, description, headings, path, types and the labels of menus; how many."""
    pages, links = change.table("pages"), change.table("links")
    labels = missing_page_tags(pages, change.table("page_tags"), links)
    first = F.get(F.filter("headings", lambda h: (h["level"] == 1) & (urls.strip(F.coalesce(h["text"], F.lit(""))) != "")), F.lit(0))["text"]
    none = F.array().cast("array<string>")
    types = F.concat(*(F.coalesce(c, none) for c in ("jsonld_types", "microdata_types", "rdfa_types")))
    label = lambda text: F.struct(F.lit("").alias("parent"), text.alias("label"))
    rows = pages.join(labels, "url").select(
        "url", F.lit("backfill").alias("source"), "title", "meta_description", F.coalesce(first, F.lit("")).alias("h1"),
        F.filter(F.split(urls.path_of(F.col("url")), "/"), lambda part: part != "").alias("url_path_segments"),
        F.array_sort(F.array_distinct(types)).alias("schema_types"), *(none.alias(c) for c in ("breadcrumb", "article_tags", "meta_keywords", "service_entities")),
        F.transform(F.slice("nav_labels", 1, MOST_LABELS), label).alias("nav_labels"),
    )
    rows = durable(rows, "page-tags")
    change.append("page_tags", rows)
    return rows.count()


def repair(change: Change, normalize: Callable[[Column], Column], capture: tuple[str, ...] = ()) -> dict[str, int]:
    """All repairs of a stored crawl as one change, which the caller publishes; numbers of what was repaired."""
    done = merge_pages(change, normalize)
    fill_links(change, capture)
    fill_pages(change, spellings(change, normalize))
    done["page_tags"] = fill_page_tags(change)
    links = change.table("links").filter("mc_id is not null").agg(F.count("*"), F.count_distinct("mc_id"), F.count_distinct("src")).first()
    dead = change.table("pages").filter("is_dead").count()
    return done | {"links_tagged": links[0], "distinct_tags": links[1], "source_pages": links[2], "dead_pages": dead}
