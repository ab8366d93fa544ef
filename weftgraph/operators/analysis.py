"""One analysis of a graph in both modes, and the document that tells it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from weftgraph.operators import graph as g
from weftgraph.operators.compare import distance_summary
from weftgraph.storage import durable

MODES = (g.ALL_LINKS, g.CONTENT_ONLY)


def _starts(entries: DataFrame) -> DataFrame:
    return entries.select(F.explode(F.array(*map(F.lit, MODES))).alias("label"), F.col("url").alias("start"))


def dead_clicks(graph: g.Graph, entries: DataFrame, views: DataFrame | None = None, zones: DataFrame | None = None) -> DataFrame:
    """(label, start, clicks): how near to each entry the next page lies from which no win can be reached."""
    views, starts = durable(g.labelled_views(graph), "analysis-views") if views is None else views, _starts(entries)
    if zones is None:
        zones = g.dead_zones(graph, views, None, starts.withColumnRenamed("start", "node"))
    stops = zones.filter("state = 'dead end'").select("label", "node")
    return g.shortest_paths(views, starts, stops).select("label", "start", (F.size("path") - 1).alias("clicks"))


def analyze(graph: g.Graph, entries: DataFrame) -> dict[str, DataFrame]:
    """All tables of an analysis: distances and zones by mode, paths of the entries, wins and what the operator added."""
    views, starts = durable(g.labelled_views(graph), "analysis-views"), _starts(entries)
    distances = g.distances_to_win(graph, views=views)
    stops = g.wins(graph).select(F.explode(F.array(*map(F.lit, MODES))).alias("label"), F.col("url").alias("node"))
    zones = durable(g.dead_zones(graph, views, distances, starts.withColumnRenamed("start", "node")), "analysis-zones")
    marked = F.col("win_source") == "operator" if "win_source" in graph.nodes.columns else F.lit(False)
    return {
        "distances": distances,
        "zones": zones,
        "paths": g.shortest_paths(views, starts, stops),
        "dead_clicks": dead_clicks(graph, entries, views, zones),
        "wins": g.wins(graph),
        "operator_wins": graph.nodes.filter(F.col("win") & marked).select("url"),
        "operator_edges": graph.edges.filter("operator").select("src", "dst"),
    }


def report(graph: g.Graph, entries: DataFrame, found: dict[str, DataFrame]) -> dict:
    """The figures of an analysis as one document. Every part has a row for each mode, state or entry of a campaign."""
    modes = F.explode(F.array(*map(F.lit, MODES))).alias("label")
    loaded = graph.nodes.filter("explored").select(F.col("url").alias("node"), modes).join(found["distances"], ["label", "node"], "left")
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  as many as modes, states and entries
    states = found["zones"].groupBy("label", "state").agg(F.count("*").alias("pages")).orderBy("label", "state")
    clicks = found["paths"].select("label", "start", (F.size("path") - 1).alias("clicks"))
    by_entry = _starts(entries).join(clicks, ["label", "start"], "left").join(found["dead_clicks"].withColumnRenamed("clicks", "clicks_to_dead_end"), ["label", "start"], "left")
    return {
        "pages": graph.nodes.count(),
        "links": graph.edges.count(),
        "wins": found["wins"].count(),
        "operator_wins": found["operator_wins"].count(),
        "operator_links": found["operator_edges"].count(),
        "distances": rows(distance_summary(loaded, "d", "label").orderBy("label")),
        "states": rows(states),
        "entries": rows(by_entry.orderBy("label", "start")),
    }


def report_json(document: dict) -> str:
    return json.dumps(document, indent=1, ensure_ascii=False, sort_keys=True)


def report_markdown(document: dict, title: str = "Reachability") -> str:
    """The document as Markdown: a line of totals and a table for each part."""
    totals = ", ".join(f"{document[k]} {k.replace('_', ' ')}" for k in ("pages", "links", "wins", "operator_wins", "operator_links"))
    parts = [f"# {title}", "", totals + "."]
    for name in ("distances", "states", "entries"):
        if table := document[name]:
            cells = [list(table[0]), ["---"] * len(table[0]), *([cell(v) for v in row.values()] for row in table)]
            parts += ["", f"## {name.capitalize()}", "", *("| " + " | ".join(c) + " |" for c in cells)]
    return "\n".join(parts) + "\n"


def cell(value: object) -> str:
    """A value in a table: nothing known is a dash, bars are escaped."""
    if value is None:
        return "–"
    text = f"{value:g}" if isinstance(value, float) else str(value)
    return text.replace("|", "\\|").replace("\n", " ")
