"""What a crawl writes to its store: pages with all that belongs to them, the queue, entries, facts, the operator's actions."""

from __future__ import annotations

import json
from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.functions import urls
from weftgraph.operators.frontier import enqueue
from weftgraph.operators.numbering import numbered
from weftgraph.sources.store import Change, Snapshot
from weftgraph.sources.tables import completed
from weftgraph.storage import drop, durable

# ---- facts


def set_meta(change: Change, **facts: object) -> None:
    """Keep facts about the run, as JSON; a fact of the same key is replaced."""
    rows = [(key, json.dumps(value)) for key, value in facts.items()]
    change.upsert("meta", change.folder.spark.createDataFrame(rows, "key string, value string"), ["key"])


def meta(snapshot: Snapshot, key: str, default: object = None) -> object:
    row = snapshot.table("meta").filter(F.col("key") == key).first()
    return default if row is None else json.loads(row["value"])


def next_number(rows: DataFrame, column: str, first: int = 1) -> int:
    highest = rows.agg(F.max(column)).first()[0]
    return first if highest is None else int(highest) + 1


# ---- pages


def heading_counts(headings: str = "headings") -> tuple[Column, Column]:
    """(with text, without) of the headings of the first level; null where headings weren't recorded."""
    top = F.filter(headings, lambda h: h["level"] == 1)
    text = F.size(F.filter(top, lambda h: urls.strip(F.coalesce(h["text"], F.lit(""))) != ""))
    seen = F.col(headings).isNotNull()
    return F.when(seen, text).alias("h1_count"), F.when(seen, F.size(top) - text).alias("h1_empty_count")


def save_crawled(change: Change, pages: DataFrame, links: DataFrame, *order: str, tags: DataFrame | None = None, visited: DataFrame | None = None) -> None:
    """Save crawled pages with their links, aliases and tags, and close their queue items, in one change.

    pages holds each url once; a page replaces the one of its url, and its links replace those that no operator added. links
    (src and the columns of a link without id) are numbered on in the order of src and `order`. All names that a page was asked by become its
    aliases. visited(url): queue items that these pages answer.
    """
    count, empty = heading_counts()
    pages = completed(pages, "pages").withColumns({"h1_count": count, "h1_empty_count": empty, "win": F.coalesce("win", F.lit(False))})
    pages = durable(pages.withColumn("crawled_at", F.coalesce("crawled_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))), "saved-pages")
    own = pages.select(F.col("url").alias("src"))
    first = next_number(change.table("links"), "id")
    fresh = links.join(own, "src", "left_semi").withColumn("operator", F.coalesce("operator", F.lit(False)))
    change.exchange("links", own, ["src"], numbered(fresh, "id", "src", *order, start=first), ~F.coalesce("operator", F.lit(False)))
    change.exchange("pages", own.select(F.col("src").alias("url")), ["url"], pages)
    names = F.array_compact(F.concat(F.array("url", "requested_url"), F.coalesce("redirect_chain", F.array().cast("array<string>"))))
    spelled = pages.select(F.explode(names).alias("name"), "url")
    change.merge("aliases", spelled.groupBy(F.col("name").alias("url")).agg(F.max("url").alias("final_url")), ["url"])
    if tags is not None:
        change.upsert("page_tags", tags.join(pages.select("url"), "url", "left_semi"), ["url"])
    asked = pages.select("url") if visited is None else pages.select("url").unionByName(visited.select("url"))
    mark_queue(change, asked, "done")
    drop(pages)


def mark_queue(change: Change, items: DataFrame, state: str) -> None:
    """Set the state of these queue items(url)."""
    queue = change.table("queue")
    rows = queue.filter(F.col("state") != state).join(items.select("url").distinct(), "url", "left_semi")
    change.upsert("queue", rows.withColumn("state", F.lit(state)), ["url"])


def add_to_queue(change: Change, found: DataFrame) -> None:
    """Queue the URLs of found(url, depth, parent, rank) that are new, numbered on without gaps in the order of rank and url."""
    queue = change.table("queue")
    fresh = enqueue(queue, change.table("pages"), change.table("aliases"), found)
    rows = numbered(fresh, "seq", "rank", "url", start=next_number(queue, "seq"))
    change.append("queue", rows.withColumn("state", F.lit("pending")))


def mark_wins(change: Change, wins: DataFrame) -> None:
    """Mark the pages of wins(url, win_source)."""
    new = wins.select("url", F.col("win_source").alias("__source")).dropDuplicates(["url"])
    rows = change.table("pages").join(new, "url").withColumns({"win": F.lit(True), "win_source": F.col("__source")})
    change.upsert("pages", rows.drop("__source"), ["url"])


def set_categories(change: Change, rows: DataFrame) -> None:
    """Set section and page_type of the pages in rows(url, section, page_type); pages that have them so touch no file."""
    new = rows.select("url", F.col("section").alias("__s"), F.col("page_type").alias("__t"))
    pages = change.table("pages").join(new, "url").withColumns({"section": F.col("__s"), "page_type": F.col("__t")})
    change.merge("pages", pages.drop("__s", "__t"), ["url"])


# ---- entries


def add_entries(change: Change, rows: DataFrame, *order: str) -> DataFrame:
    """Add rows(label, url) as entries, numbered on from the last one in the given order, and queue their pages; the new entries."""
    first = next_number(change.table("entries"), "idx", 0)
    new = numbered(rows, "idx", *order, start=first).select(
        F.col("idx").cast("int").alias("idx"), "label", F.col("url").alias("requested_url"), F.col("url").alias("node_url"), F.lit("pending").alias("status")
    )
    new = durable(new, "new-entries")
    change.append("entries", new)
    add_to_queue(change, new.select(F.col("node_url").alias("url"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.col("idx").alias("rank")))
    return new


def land_entries(change: Change, landed: DataFrame) -> None:
    """Entries after a crawl: landed(node_url, new_url, status) tells where each one's page was found, and how."""
    new = landed.select("node_url", F.col("new_url").alias("__to"), F.col("status").alias("__status"))
    rows = change.table("entries").join(new, "node_url").withColumns({"node_url": F.coalesce("__to", "node_url"), "status": F.coalesce("__status", "status")})
    change.upsert("entries", rows.drop("__to", "__status"), ["idx"])


# ---- the operator


def log_actions(change: Change, actions: DataFrame, *order: str) -> None:
    """Add actions(ts, url, problem, action, detail) to the operator's log, numbered on in the given order; nothing there is changed."""
    first = next_number(change.table("operator_actions"), "id")
    change.append("operator_actions", numbered(actions, "id", *order, start=first))


def add_operator_links(change: Change, pairs: DataFrame) -> None:
    """Links that an operator adds, pairs(src, url)."""
    first = next_number(change.table("links"), "id")
    rows = pairs.select("src", F.col("url").alias("href"), "url", F.lit("(operator)").alias("text"), F.lit("operator").alias("region"), F.lit(True).alias("in_scope"), F.lit(True).alias("operator"))
    change.append("links", numbered(rows, "id", "src", "url", start=first))


# ---- what a crawl takes next


def next_batch(queue: DataFrame, explored: int, max_pages: int, max_depth: int) -> tuple[DataFrame, str | None]:
    """The pending items that a crawl may still take, with `place` 1, 2, ... by depth and seq, and why it stops after them.

    The budget counts explored pages and cuts a level at an exact place. Reasons: max_pages where it cuts, max_depth where pending
    items lie deeper than that, None where the queue is taken whole.
    """
    pending = queue.filter("state = 'pending'")
    near = pending.filter(F.col("depth") <= max_depth)
    left = max(0, max_pages - explored)
    placed = numbered(near, "place", "depth", "seq")
    taken = placed.filter(F.col("place") <= left)
    if near.count() > left:
        return taken, "max_pages"
    return taken, None if pending.filter(F.col("depth") > max_depth).isEmpty() else "max_depth"
