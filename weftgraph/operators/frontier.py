"""The crawl frontier over pages that are already fetched, and the upkeep of what was crawled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftgraph.operators.graph import Graph, wins
from weftgraph.storage import durable


def ranked(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with `name` ascending in the given order. Numbers have gaps: each range of rows numbers its own."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.withColumn(name, F.monotonically_increasing_id())


def enqueue(queue: DataFrame, pages: DataFrame, aliases: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of found(url, depth, parent, rank) that are new: no page, no alias of another URL, not queued."""
    elsewhere = aliases.filter("final_url <> url").select("url")
    fresh = found.join(elsewhere, "url", "left_anti").join(pages.select("url"), "url", "left_anti").join(queue.select("url"), "url", "left_anti")
    return fresh.groupBy("url").agg(F.min(F.struct("depth", "rank", "parent")).alias("f")).select("url", "f.depth", "f.parent", "f.rank")


def next_pending(queue: DataFrame, n: int = 1) -> DataFrame:
    return queue.filter("state = 'pending'").orderBy("depth", "seq").limit(n)


def crawl_levels(links: DataFrame, entries: DataFrame, graph: Graph, max_depth: int) -> DataFrame:
    """(url, depth, parent, seq, state): the queue after a breadth-first crawl in the order of entries(url).

    One level is one batch. A page's targets are queued in their order, once each, up to max_depth; wins are not
    expanded. state is done for explored pages, else pending.
    """
    links = durable(links.join(wins(graph).withColumnRenamed("url", "src"), "src", "left_anti").select("src", "dst").distinct(), "crawl-links")
    first = entries.select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("rank"))
    done = [durable(ranked(first.dropDuplicates(["url"]), "seq", "url").drop("rank"), "crawl-level")]
    for depth in range(1, max_depth + 1):
        queue = reduce(DataFrame.unionByName, done)
        found = done[-1].select(F.col("url").alias("src"), F.col("seq").alias("rank")).join(links, "src")
        found = found.select(F.col("dst").alias("url"), F.lit(depth).alias("depth"), F.col("src").alias("parent"), "rank")
        fresh = found.join(queue.select("url"), "url", "left_anti").groupBy("url").agg(F.min(F.struct("rank", "parent", "depth")).alias("f"))
        level = durable(ranked(fresh.select("url", "f.depth", "f.parent", "f.rank"), "seq", "rank", "url").drop("rank"), "crawl-level")
        if level.isEmpty():
            break
        done.append(level)
    explored = graph.nodes.select("url", "explored")
    queue = reduce(DataFrame.unionByName, done).join(explored, "url", "left")
    return queue.select("url", "depth", "parent", "seq", F.when(F.col("explored"), "done").otherwise("pending").alias("state"))


def resolve(links: DataFrame, aliases: DataFrame, column: str = "url") -> DataFrame:
    """`column` replaced by the final URL of its alias. One hop only."""
    to = aliases.select(F.col("url").alias(column), F.col("final_url").alias("__to")).dropDuplicates([column])
    return links.join(to, column, "left").withColumn(column, F.coalesce("__to", column)).drop("__to")


def survivors(pages: DataFrame, links: DataFrame, key: Column) -> DataFrame:
    """(url, key, keep, is_kept): pages that are one page under the normalized key, and which of each group stays.

    The order is: status ok, http_error, others; most links; the URL that is its own key; the least URL.
    """
    counts = links.groupBy(F.col("src").alias("url")).agg(F.count("*").alias("n_links"))
    rank = F.when(F.col("status") == "ok", 0).when(F.col("status") == "http_error", 1).otherwise(2)
    rows = pages.select("url", key.alias("key"), rank.alias("rank")).join(counts, "url", "left").fillna({"n_links": 0})
    order = Window.partitionBy("key").orderBy("rank", F.desc("n_links"), (F.col("url") != F.col("key")), "url")
    ordered = rows.withColumn("place", F.row_number().over(order)).withColumn("keep", F.first("url").over(order))
    return ordered.select("url", "key", "keep", (F.col("place") == 1).alias("is_kept"))


def merge_links(links: DataFrame, moves: DataFrame) -> DataFrame:
    """Links with merged pages replaced in src and url by moves(url, keep), and equal ones kept once, the first by id."""
    to = moves.select("url", "keep")
    moved = links.join(to.withColumnsRenamed({"url": "src", "keep": "__src"}), "src", "left").withColumn("src", F.coalesce("__src", "src"))
    moved = moved.drop("__src").join(to.withColumnRenamed("keep", "__url"), "url", "left").withColumn("url", F.coalesce("__url", "url")).drop("__url")
    same = ["src", "href", "url", "text", "region", "operator", F.coalesce("mc_id", F.lit(""))]
    return moved.withColumn("__n", F.row_number().over(Window.partitionBy(*same).orderBy("id"))).filter("__n = 1").drop("__n")


def process_status(row: dict[str, Column]) -> Column:
    """The status that one visit gives a page: the first decision of the chain that applies.

    row: blocked, robots, url_win, offsite, in_scope, refused (Booleans) and http_status.
    """
    return (
        F.when(row["blocked"], "host_blocked")
        .when(row["robots"], "robots")
        .when(row["url_win"], "not_fetched")
        .when(row["offsite"] & ~row["in_scope"], "offsite")
        .when(row["refused"], "skipped")
        .when(F.coalesce(row["http_status"], F.lit(200)) < 400, "ok")
        .otherwise("http_error")
    )


def js_dependent(raw: Column, rendered: Column) -> Column:
    """Whether the crawl takes a page to need scripts; null where the raw text was not read."""
    return F.when(raw.isNotNull(), (rendered >= 200) & (raw < rendered / 2))


def offsite_reason(host: Column, domains: list[str], shorteners: list[str], locale_ok: Column) -> Column:
    return (
        F.when(host.isin(shorteners), "shortener")
        .when(~host.isin(domains), "host")
        .when(~locale_ok, "locale")
        .otherwise("other")
    )


def plan_seeds(rows: DataFrame, known_entries: DataFrame, dead: DataFrame, win: Column) -> tuple[DataFrame, DataFrame]:
    """(links, entries) of collected posts: rows(id, seed, landing, anchor, kind) with kind page, seed, offsite or none.

    A (seed, landing) pair counts once, the first by id. Landing pages that are neither dead nor wins nor known become
    entries; the others carry the reason why not.
    """
    once = F.row_number().over(Window.partitionBy("seed", "landing").orderBy("id"))
    links = rows.filter("landing is not null").withColumn("__n", once).filter("__n = 1").drop("__n")
    pages = links.filter("kind = 'page'").select(F.col("landing").alias("url")).distinct()
    flagged = (
        pages.join(known_entries.select("url").distinct().withColumn("known", F.lit(True)), "url", "left")
        .join(dead.select("url").distinct().withColumn("gone", F.lit(True)), "url", "left")
        .withColumn("win", win)
    )
    reason = F.when(F.col("gone"), "dead").when(F.col("win"), "win").when(F.col("known"), "existing entry").otherwise("new entry")
    return links, flagged.select("url", reason.alias("reason"))


def site_signals(files: DataFrame) -> DataFrame:
    """(base, name, state) of site files(base, name, status, body, error): read, absent after a clean 404 or 410 or where
    HTML stands in for llms.txt, else unreadable."""
    html = (F.col("name") == "llms.txt") & F.col("body").rlike(r"(?is)^\s*<(!doctype|html)")
    state = (
        F.when(F.col("error").isNotNull(), "unreadable")
        .when(F.col("status").isin(404, 410) | html, "absent")
        .when(F.col("status") < 400, "read")
        .otherwise("unreadable")
    )
    return files.select("base", "name", state.alias("state"))


def sitemap_coverage(sitemap: DataFrame, crawled: DataFrame, in_scope: Column, sample: int = 20) -> tuple[DataFrame, DataFrame]:
    """(in_sitemap, missed) counts and the first missed URLs: in scope, in the sitemap, not crawled."""
    urls = sitemap.select("url").distinct()
    missed = urls.filter(in_scope).join(crawled.select("url"), "url", "left_anti")
    counts = crawled.select("url").distinct().join(urls, "url", "left_semi").agg(F.count("*").alias("in_sitemap"))
    return counts.crossJoin(missed.agg(F.count("*").alias("missed"))), missed.orderBy("url").limit(sample)
