"""Several crawled sites compared: their tables stand side by side with a column `site`, and one search serves them all.

What differs between sites is rows of parameter tables that are joined, but for the predicates of their wins, which mark each site's own
nodes before these are put together. URLs of two sites may be the same: searches carry the site in their label.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from weftgraph.functions import predicates as p, urls
from weftgraph.operators import compare, graph as g
from weftgraph.operators.store_graph import graph_from_store
from weftgraph.sources.sinks import write_csv
from weftgraph.sources.tables import completed
from weftgraph.storage import durable

MODES = {g.ALL_LINKS: "win_all", g.CONTENT_ONLY: "win_body"}
_CUT = "\x1f"


@dataclass(frozen=True)
class Site:
    """A site's stored tables, by name, and how they are read. slices: expressions from the URL's start; only pages that one fits are
    compared, all where there are none."""

    tables: Mapping[str, DataFrame]
    home: str
    win: p.Win = p.Win()
    require_form: bool = False
    slices: tuple[str, ...] = ()
    locales: tuple[str, ...] = field(default=())


def side_by_side(sites: dict[str, Site], table: str) -> DataFrame:
    """One table of all sites, with exactly the columns of the stored table and `site`."""
    return reduce(DataFrame.unionByName, (completed(s.tables[table], table).withColumn("site", F.lit(name)) for name, s in sites.items()))


def _parameters(sites: dict[str, Site]) -> DataFrame:
    """(site, home, slices): a row for each site."""
    spark = next(iter(sites.values())).tables["pages"].sparkSession
    return spark.createDataFrame([(name, s.home, list(s.slices)) for name, s in sites.items()], "site string, home string, slices array<string>")


def counted_pages(sites: dict[str, Site]) -> DataFrame:
    """Loaded pages of all sites that are not gone and in a slice of their site, if it has any."""
    known = side_by_side(sites, "pages").join(F.broadcast(_parameters(sites)), "site")  # a row for each site
    inside = (F.size("slices") == 0) | F.exists("slices", lambda s: F.regexp_like(F.col("url"), F.concat(F.lit("^(?:"), s, F.lit(")"))))
    return known.filter(compare.counted() & inside).drop("home", "slices")


def site_graphs(sites: dict[str, Site]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all sites' graphs, with `site`; wins by each site's own predicates."""
    nodes, edges = [], []
    for name, s in sites.items():
        made = graph_from_store(*(completed(s.tables[t], t) for t in ("pages", "links", "aliases")), s.win, s.require_form)
        nodes.append(made.nodes.withColumn("site", F.lit(name)))
        edges.append(made.edges.withColumn("site", F.lit(name)))
    together = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return durable(together(nodes), "site-nodes"), durable(together(edges), "site-edges")


def _of_site(rows: DataFrame) -> DataFrame:
    """rows with the label `site, what` as two columns."""
    parts = F.split("label", _CUT)
    return rows.withColumns({"site": parts[0], "what": parts[1]}).drop("label")


def measured_pages(sites: dict[str, Site]) -> DataFrame:
    """A row for each counted page: site, url, section, page_type, win_all, win_body (clicks to a win), home_all, home_body (from the
    home page), inbound_live, structured_data, one_h1. Two searches in all, whatever the number of sites."""
    nodes, edges = site_graphs(sites)
    wins = nodes.filter("win").select("site", "url", "win_type")
    label = lambda what: F.concat_ws(_CUT, F.col("site"), what if not isinstance(what, str) else F.lit(what)).alias("label")
    modes = F.explode(F.array(*map(F.lit, MODES))).alias("mode")
    leaving = edges.join(wins.withColumnRenamed("url", "src"), ["site", "src"], "left_anti")
    hit = F.explode(F.array_compact(F.array(*(F.when(g.in_mode(m), F.lit(m)) for m in MODES)))).alias("mode")
    views = leaving.select("site", "src", "dst", hit).select(label(F.col("mode")), "src", "dst")
    to_win = _of_site(g.levels(g.reverse(views), wins.select("site", F.col("url").alias("node"), modes).select(label(F.col("mode")), "node")))
    kinds = F.explode(F.array_compact(F.array(F.when(F.size("regions") > 0, F.lit("all")), F.when(g.in_body(), F.lit("body"))))).alias("kind")
    walks = edges.select("site", "src", "dst", kinds).select(label(F.col("kind")), "src", "dst")
    homes = _parameters(sites).select(F.explode(F.array(label("all"), label("body"))).alias("label"), F.col("home").alias("node"))
    from_home = _of_site(g.levels(walks, homes))
    names = {**{m: c for m, c in MODES.items()}, "all": "home_all", "body": "home_body"}
    found = to_win.unionByName(from_home).select("site", F.col("node").alias("url"), "d", F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.col("what")].alias("name"))
    wide = found.groupBy("site", "url").pivot("name", sorted(names.values())).agg(F.first("d"))
    pages = counted_pages(sites)
    live = pages.select("site", F.col("url").alias("src"))
    inbound = edges.join(live, ["site", "src"], "left_semi").groupBy("site", F.col("dst").alias("url")).agg(F.count("*").alias("inbound_live"))
    locales = sorted({x for s in sites.values() for x in s.locales})
    section = urls.section_of(F.col("url"), tuple(locales))
    rows = pages.select("site", "url", "jsonld_types", "h1_count").join(wide, ["site", "url"], "left").join(inbound, ["site", "url"], "left").join(wins.withColumn("won", F.lit(True)), ["site", "url"], "left")
    types = F.coalesce("jsonld_types", F.array().cast("array<string>"))
    return durable(rows.select(
        "site", "url", section.alias("section"), urls.page_type_of(F.col("url"), types, F.coalesce("won", F.lit(False)), section).alias("page_type"),
        *sorted(names.values()), F.coalesce("inbound_live", F.lit(0)).alias("inbound_live"), (F.size(types) > 0).alias("structured_data"), (F.col("h1_count") == 1).alias("one_h1"),
    ), "measured-pages")


def comparison(sites: dict[str, Site]) -> dict[str, DataFrame]:
    """The tables of a comparison: distances by site and way, their histogram, figures of each site, sections, and each site's differences
    from the first one."""
    pages = measured_pages(sites)
    ways = {m: c for m, c in MODES.items()} | {"from_home": "home_all"}
    long = pages.select("site", F.explode(F.array(*(F.struct(F.lit(m).alias("way"), F.col(c).alias("d")) for m, c in ways.items()))).alias("x")).select("site", "x.*")
    scalars = compare.site_scalars(pages, "site")
    base = scalars.filter(F.col("site") == next(iter(sites)))
    shares = [c for c in scalars.columns if c not in ("site", "pages")]
    melt = lambda df: df.select("site", F.explode(F.array(*(F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("value")) for c in shares))).alias("x")).select("site", "x.*")
    own = melt(base).select("figure", F.col("value").alias("base"))
    return {
        "distances": compare.distance_summary(long, "d", "site", "way"),
        "histogram": compare.distance_histogram(pages, ways),
        "scalars": scalars,
        "sections": pages.groupBy("site", "section").agg(F.count("*").alias("pages"), F.median("win_body").alias("median_clicks_body")),
        "differences": melt(scalars).join(F.broadcast(own), "figure").select("site", "figure", "value", "base", F.bround(F.col("value") - F.col("base"), 1).alias("difference")),  # a row for each figure
    }


def write_comparison(found: dict[str, DataFrame], path: str) -> None:
    """Each table as a folder of CSV files."""
    for name, table in found.items():
        write_csv(table, f"{path}/{name}")
