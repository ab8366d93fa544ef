"""The same measures over several sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: menu groups that name what a site offers.
SERVICE_GROUP = r"(?i)servic|solution|product|shipping|logistic|freight|industr|capabilit"
PRODUCT_TYPES = ("product/service", "solutions", "service", "product")


def nearest_rank(q: float, column: str) -> Column:
    """The value at place ceil(q n) in order; null where there is none."""
    return F.expr(f"percentile_disc({q}) within group (order by {column})").cast("int")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.bround(100 * part / whole, 1))


def distance_summary(pages: DataFrame, column: str, *by: str) -> DataFrame:
    """pages, reached, no_route and its share, p50, p90, deepest of the clicks in `column`."""
    n, lost = F.count("*"), F.count_if(F.col(column).isNull())
    return pages.groupBy(*by).agg(
        n.alias("pages"), F.count(column).alias("reached"), lost.alias("no_route"), percent(lost, n).alias("no_route_share"),
        nearest_rank(0.5, column).alias("p50"), nearest_rank(0.9, column).alias("p90"), F.max(column).alias("deepest"),
    )


def distance_histogram(pages: DataFrame, columns: dict[str, str], site: str = "site") -> DataFrame:
    """(site, mode, clicks, pages) in long form; pages without a route have null clicks."""
    modes = F.array(*(F.struct(F.lit(m).alias("mode"), F.col(c).cast("int").alias("clicks")) for m, c in columns.items()))
    return pages.select(site, F.explode(modes).alias("m")).groupBy(site, "m.mode", "m.clicks").agg(F.count("*").alias("pages"))


def counted(slices: tuple[str, ...] = ()) -> Column:
    """Loaded pages that are not known to be gone, in one of the slices if there are any."""
    live = F.col("status").isin("ok", "http_error") & ~F.coalesce("is_dead", F.lit(False))
    if not slices:
        return live
    inside = F.lit(False)
    for p in slices:
        inside |= F.col("url").rlike(f"^(?:{p})")
    return live & inside


def share(column: str, test: Column | None = None) -> Column:
    """Per cent of the known values that pass; null where none is known."""
    passed = F.col(column) if test is None else test
    return percent(F.count_if(passed), F.count(column))


def menu_reliant(all_links: str, body_links: str) -> Column:
    """Whether a page is near a win only through the page frame."""
    gap = F.coalesce(F.col(body_links) - F.col(all_links) >= 2, F.lit(True))
    return F.col(all_links).isNotNull() & gap


def site_scalars(pages: DataFrame, *by: str) -> DataFrame:
    """pages: win_all, win_body, home_all, inbound_live, page_type and the health flags of each counted page."""
    n = F.count("*")
    deep = lambda d: percent(F.count_if(F.col("home_all") >= d), n)

    def deep_of(kinds: tuple[str, ...]) -> Column:
        known = F.col("page_type").isin(*kinds) & F.col("home_all").isNotNull()
        return percent(F.count_if(known & (F.col("home_all") >= 4)), F.count_if(known))

    rows = pages.withColumn("menu_reliant", menu_reliant("win_all", "win_body"))
    flags = [c for c in ("structured_data", "readable_without_js", "unique_title", "unique_meta", "one_h1", "self_canonical") if c in pages.columns]
    return rows.groupBy(*by).agg(
        n.alias("pages"), share("menu_reliant").alias("menu_reliance_share"), deep(4).alias("share_4plus_from_home"), deep(5).alias("share_5plus_from_home"),
        percent(F.count_if(F.col("inbound_live") == 1), n).alias("single_inbound_share"),
        deep_of(("content",)).alias("deep_share_content"), deep_of(PRODUCT_TYPES).alias("deep_share_product_service"),
        *(share(c).alias(c) for c in flags),
    )


def topic_matrix(topics: DataFrame, pages: DataFrame, names: list[str]) -> DataFrame:
    """(site, topic, pages, share_pct, medians) for every site and topic, zeros included.

    topics(site, url, topic); pages(site, url, home_all, win_all).
    """
    totals = pages.groupBy("site").agg(F.count("*").alias("total"))
    dense = totals.withColumn("topic", F.explode(F.array(*map(F.lit, names))))
    held = topics.join(pages, ["site", "url"]).groupBy("site", "topic").agg(
        F.countDistinct("url").alias("pages"), F.median("home_all").alias("median_clicks_from_home"), F.median("win_all").alias("median_clicks_to_win")
    )
    joined = dense.join(held, ["site", "topic"], "left").fillna(0, ["pages"])
    return joined.select("site", "topic", "pages", F.coalesce(percent(F.col("pages"), F.col("total")), F.lit(0.0)).alias("share_pct"), "median_clicks_from_home", "median_clicks_to_win")


def topic_questions(matrix: DataFrame, base: str, n: int = 25) -> DataFrame:
    """(kind, site, topic): topics that a peer gives far more of its pages than the base does, and those only it has."""
    own = matrix.filter(F.col("site") == base).select("topic", F.col("share_pct").alias("base_share"), F.col("pages").alias("base_pages"))
    peers = matrix.filter(F.col("site") != base).join(own, "topic", "left").fillna(0, ["base_share", "base_pages"])
    more = peers.filter((F.col("pages") >= 5) & (F.col("share_pct") >= 2 * F.greatest(F.col("base_share"), F.lit(0.5))))
    only = peers.groupBy("topic").agg(F.max("pages").alias("most"), F.first("base_pages").alias("own")).filter("most = 0 and own >= 5")
    rows = more.select(F.lit("gap").alias("kind"), "site", "topic").unionByName(only.select(F.lit("only base").alias("kind"), F.lit(base).alias("site"), "topic"))
    return rows.orderBy("kind", "site", "topic").limit(n)


def win_classes(nodes: DataFrame, inbound: DataFrame) -> DataFrame:
    """(class, pages, linked, counts_as_win) of nodes(url, conversion_class, win)."""
    rows = nodes.filter("conversion_class is not null").join(inbound, "url", "left")
    return rows.groupBy("conversion_class").agg(
        F.count("*").alias("pages"), F.count("in_degree").alias("linked"), F.min_by("win", "url").alias("counts_as_win")
    )


def services(tags: DataFrame, pages: DataFrame) -> DataFrame:
    """(source, group, label): menu entries under groups that name an offer, and named services of counted pages."""
    menu = tags.select(F.explode("nav_labels").alias("l")).select(F.lit("menu").alias("source"), F.col("l.parent").alias("group"), F.col("l.label").alias("label"))
    menu = menu.filter(F.col("group").rlike(SERVICE_GROUP))
    named = tags.join(pages.select("url"), "url", "left_semi").select(F.lit("structured data").alias("source"), F.lit("").alias("group"), F.explode("service_entities").alias("label"))
    rows = menu.unionByName(named.filter(~F.col("label").endswith("?"))).distinct()
    return rows.orderBy("source", F.lower("group"), F.lower("label"))


def first_steps(edges: DataFrame, dist: DataFrame, texts: DataFrame) -> DataFrame:
    """(url, text): of pages two clicks or more from a win, the text of the link to the least URL one click nearer."""
    far = dist.filter("d >= 2").select(F.col("url").alias("src"), "d")
    near = dist.select(F.col("url").alias("dst"), (F.col("d") + 1).alias("d"))
    step = edges.select("src", "dst").join(far, "src").join(near, ["dst", "d"]).groupBy("src").agg(F.min("dst").alias("url"))
    return step.join(texts, ["src", "url"], "left").select(F.col("src").alias("url"), F.coalesce("text", F.lit("")).alias("text"))


def type_histogram(pages: DataFrame) -> DataFrame:
    """(type, pages) of JSON-LD types, most frequent first."""
    rows = pages.select("url", F.explode("jsonld_types").alias("type")).distinct()
    return rows.groupBy("type").agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "type")


def crawl_coverage(pages: DataFrame, queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(complete, queued_unvisited), and the pages that robots.txt kept out by host, with and without a query."""
    left = queue.agg(F.count_if(F.col("state") == "pending").alias("queued_unvisited"))
    kept = pages.filter("status = 'robots'").groupBy(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"))
    return left.select((F.col("queued_unvisited") == 0).alias("complete"), "queued_unvisited"), kept.agg(F.count("*").alias("pages"), F.count_if(F.col("url").contains("?")).alias("with_query"))
