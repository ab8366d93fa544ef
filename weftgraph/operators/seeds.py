"""Posts that were collected by hand, and the pages they lead to, taken into a stored crawl.

A row of a seed file is a post and one link in it. A post becomes a page with status `external`, its links become links like any
other, and landing pages within scope become entries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftgraph.functions import predicates as p, urls
from weftgraph.operators import crawl_store
from weftgraph.operators.frontier import offsite_reason
from weftgraph.sources.store import Change
from weftgraph.sources.tables import SEED_COLUMNS, SHORTENERS
from weftgraph.storage import durable

EXTERNAL = "external"


@dataclass
class SeedPlan:
    """posts(url, title, post_date, place); links(id, seed, raw, resolved, target, kind, in_scope, mc_id, params, anchor_text);
    outcomes(target, reason) of all links; landing(url, state) with state new entry, existing entry, dead page or win page."""

    posts: DataFrame
    links: DataFrame
    outcomes: DataFrame
    landing: DataFrame


def _text(name: str) -> Column:
    return urls.once(urls.strip(F.coalesce(F.col(name), F.lit(""))), lambda given: F.when(given != "", given))


def _normal(rows: DataFrame, column: str, scope: p.Scope) -> DataFrame:
    """rows with `target`, the normalized spelling of the column; Python runs once for each spelling."""
    spelled = rows.select(column).filter(F.col(column).isNotNull()).distinct()
    return rows.join(spelled.withColumn("target", urls.normalize_url(F.col(column), stripped=scope.strip_query_params)), column, "left")


def _tagged(rows: DataFrame, column: str, name: str, scope: p.Scope) -> DataFrame:
    """rows with `name`, the captured parameters of the column; Python runs once for each spelling with a query."""
    spelled = rows.select(column).filter(F.col(column).contains("?")).distinct()
    spelled = durable(spelled.withColumn(name, urls.captured_params(F.col(column), scope.capture_params)), "seed-params")
    return rows.join(spelled, column, "left").withColumn(name, F.coalesce(name, F.create_map().cast("map<string,string>")))


def plan(rows: DataFrame, scope: p.Scope, known: DataFrame, entries: DataFrame, dead: DataFrame, win: p.Win | None = None) -> SeedPlan:
    """What becomes of rows(id, and the columns of a seed file), id being the row's place in the file.

    known(url): pages and advertisements that are no posts to take in; entries(url) and dead(url): normalized pages. Of the rows
    with one post and one landing page the first counts; a post's title is the first that a row of it has.
    """
    rows = rows.select("id", *(_text(c).alias(c) for c in SEED_COLUMNS)).withColumn("seed", urls.seed_url(F.col("seed_url"))).filter("seed is not null")
    taken = known.select(urls.seed_url(F.col("url")).alias("seed")).filter("seed is not null").distinct()
    rows = durable(rows.join(taken, "seed", "left_anti"), "seed-rows")
    posts = rows.groupBy(F.col("seed").alias("url")).agg(
        F.min_by("post_title", F.when(F.col("post_title").isNotNull(), F.col("id"))).alias("title"), urls.post_date(F.min_by("seed_url", "id")).alias("post_date"), F.min("id").alias("place")
    )
    goes = F.coalesce("outbound_resolved_url", "outbound_url_raw")
    order = Window.partitionBy("seed", urls.seed_url(goes)).orderBy("id")
    once = rows.withColumn("goes", goes).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
    once = _normal(once, "goes", scope)
    post = urls.is_post(F.col("goes"))
    inside = F.coalesce(scope.holds(F.col("target")), F.lit(False))
    kind = F.when(F.col("goes").isNull(), "none").when(post, "seed").when(inside, "page").otherwise("offsite")
    raw, resolved = F.col("outbound_url_raw"), F.col("outbound_resolved_url")
    once = _tagged(_tagged(durable(once, "seed-once"), "outbound_url_raw", "of_raw", scope), "outbound_resolved_url", "of_resolved", scope)
    links = once.withColumn("kind", kind).withColumns({
        "target": F.when(F.col("kind") == "seed", urls.seed_url(F.col("goes"))).otherwise(F.col("target")),
        "in_scope": F.col("kind") == "page",
    })
    params = F.map_concat(F.map_filter("of_raw", lambda k, _: ~F.array_contains(F.map_keys("of_resolved"), k)), F.col("of_resolved"))
    first = scope.capture_params[:1]
    tag = F.coalesce(F.col("of_resolved")[first[0]], F.col("of_raw")[first[0]]) if first else F.lit(None).cast("string")
    links = links.select("id", "seed", raw.alias("raw"), resolved.alias("resolved"), "target", "kind", "in_scope", tag.alias("mc_id"), F.when(F.size(params) > 0, params).alias("params"), F.coalesce("anchor_text", F.lit("")).alias("anchor_text"))
    links = durable(links, "seed-links")
    own = posts.select(F.col("url").alias("seed")).unionByName(taken)
    found = links.filter("kind = 'seed'").select(F.col("target").alias("seed"), urls.post_date(F.coalesce("resolved", "raw")).alias("post_date"), "id").join(own, "seed", "left_anti")
    more = found.groupBy(F.col("seed").alias("url")).agg(F.lit(None).cast("string").alias("title"), F.min_by("post_date", "id").alias("post_date"), F.min("id").alias("place"))
    posts = durable(posts.unionByName(more), "seed-posts")
    mark = lambda t, name: t.select("url", F.lit(True).alias(name)).distinct()
    pages = links.filter("kind = 'page'").select(F.col("target").alias("url")).distinct()
    pages = pages.join(mark(dead, "gone"), "url", "left").join(mark(entries, "old"), "url", "left")
    won = F.lit(False) if win is None else win.matches(F.col("url"))
    state = F.when(F.col("gone"), "dead page").when(won, "win page").when(F.col("old"), "existing entry").otherwise("new entry")
    landing = durable(pages.select("url", state.alias("state")), "seed-landing")
    locale = urls.locale_allowed(F.col("at"), list(scope.locale_include), list(scope.locale_exclude))
    short = tuple(SHORTENERS)
    at = F.coalesce("target", "raw", "resolved", F.lit(""))
    why = offsite_reason(urls.host_of(F.col("at")), [d.lower() for d in scope.allowed_domains], list(short), locale)
    why = F.when(F.col("resolved").isNotNull() & (why == "shortener"), "host").otherwise(why)
    told = links.withColumn("at", at).join(landing.withColumnRenamed("url", "at"), "at", "left")
    reason = F.when(F.col("kind") == "none", "no landing page").when(F.col("kind") == "seed", "another post").when(F.col("kind") == "offsite", why).otherwise(F.col("state"))
    target = F.when(F.col("kind") == "none", F.col("seed")).otherwise(F.col("at"))
    return SeedPlan(posts, links, told.select(target.alias("target"), reason.alias("reason")).distinct(), landing)


def ingest(change: Change, rows: DataFrame, scope: p.Scope, channel: str, ads: DataFrame, win: p.Win | None = None) -> SeedPlan:
    """Take the rows of a seed file into the store: posts, their links, and new entries with the numbers after the last one's.

    ads(url): advertisements of the campaign. The caller publishes the change; a second time the same file adds nothing."""
    had = change.table("entries").select(F.col("requested_url").alias("url"))
    normal = _normal(had, "url", scope).select(F.coalesce("target", "url").alias("url"))
    dead = change.table("pages").filter("is_dead").select("url")
    found = plan(rows, scope, had.unionByName(ads.select("url")), durable(normal, "entry-urls"), dead, win)
    pages = found.posts.select("url", F.lit(EXTERNAL).alias("status"), "title", F.lit(channel).alias("channel"), F.col("post_date").cast("string").alias("post_date_derived"))
    own = F.coalesce("raw", "resolved").alias("href")
    links = found.links.filter("kind <> 'none'").select(F.col("seed").alias("src"), own, F.col("target").alias("url"), F.col("anchor_text").alias("text"), F.lit(EXTERNAL).alias("region"), "in_scope", "mc_id", "params", F.lit(False).alias("operator"), F.col("id").alias("place"))
    crawl_store.save_crawled(change, pages, links, "place")
    titled = found.links.filter("kind = 'page'").join(found.posts.select(F.col("url").alias("seed"), "title", "place"), "seed")
    titles = titled.groupBy(F.col("target").alias("url")).agg(F.max_by(F.struct("title"), F.struct("place", "id"))["title"].alias("title"))
    fresh = found.landing.filter("state = 'new entry'").join(titles, "url")
    crawl_store.add_entries(change, fresh.select(F.concat(F.lit(f"{channel}: "), F.coalesce("title", "url")).alias("label"), "url"), "url")
    states = {r["state"]: r["count"] for r in found.landing.groupBy("state").count().collect()}
    crawl_store.set_meta(change, external_seeds={"posts": found.posts.count(), "new_entries": states.get("new entry", 0), "existing_entries": states.get("existing entry", 0)})
    return found
