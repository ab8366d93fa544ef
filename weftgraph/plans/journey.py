"""A link graph made of the `events` table: users' steps through numbered places.

A node is a user and the remainder of the event's number by PLACES; an edge leads to the user's next event's node, its
region given by the event's type. Wins are large purchases; a node of nothing but errors counts as not explored and has no
edges. Every user's first node is an entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weftgraph.operators.graph import Graph, build_graph
from weftgraph.storage import durable

PLACES = 40
REGIONS = {"click": "body", "view": "external", "error": "footer", "signup": "header", "purchase": "nav"}
WIN_VALUE = 120


def steps(spark: SparkSession, sf_dir: str, groups: int | None = None) -> DataFrame:
    """user_id, ord, node, event_type, value, next_node in the order of ts and event_id. groups: so many groups of users share their nodes."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int") % PLACES
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    node = F.concat_ws(":", "user_id" if groups is None else (F.col("user_id") % groups).cast("string"), k)
    rows = events.select("user_id", "ts", "event_id", "event_type", "value", node.alias("node"))
    return rows.select("user_id", F.row_number().over(order).alias("ord"), "node", "event_type", "value", F.lead("node").over(order).alias("next_node"))


def journey_graph(spark: SparkSession, sf_dir: str, groups: int | None = None) -> tuple[Graph, DataFrame]:
    """The graph and its entries(url)."""
    rows = durable(steps(spark, sf_dir, groups), "journey-steps")
    pages = rows.groupBy(F.col("node").alias("url")).agg(
        F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > WIN_VALUE)).alias("win"),
        F.bool_and(F.col("event_type") == "error").alias("errors"),
    )
    pages = pages.select("url", (F.col("win") | ~F.col("errors")).alias("explored"), "win")
    region = F.create_map(*(F.lit(x) for pair in REGIONS.items() for x in pair))[F.col("event_type")]
    links = rows.select(F.col("node").alias("src"), F.col("next_node").alias("dst"), region.alias("region"), F.lit(False).alias("operator"))
    closed = pages.filter("not explored").select(F.col("url").alias("src"))
    graph = build_graph(pages, links.join(closed, "src", "left_anti"))
    graph = Graph(durable(graph.nodes, "journey-nodes"), graph.edges)
    return graph, rows.filter("ord = 1").select(F.col("node").alias("url")).distinct()


#: The same in DuckDB: nodes(url, win, explored), edges(src, dst, content, body), entries(url), all as CTEs.
GRAPH_SQL = """
  st AS MATERIALIZED (SELECT user_id, event_type, value, user_id || ':' || ((props->>'$.k')::INT % 40) AS node,
      lead(user_id || ':' || ((props->>'$.k')::INT % 40)) OVER w AS next_node, row_number() OVER w AS ord
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  nodes AS MATERIALIZED (SELECT node AS url, bool_or(event_type = 'purchase' AND value > 120) AS win,
      bool_or(event_type = 'purchase' AND value > 120) OR NOT bool_and(event_type = 'error') AS explored FROM st GROUP BY node),
  edges AS MATERIALIZED (SELECT node AS src, next_node AS dst, bool_or(event_type IN ('click', 'view')) AS content,
      bool_or(event_type = 'click') AS body
    FROM st WHERE next_node IS NOT NULL AND next_node <> node
      AND node NOT IN (SELECT url FROM nodes WHERE NOT explored) GROUP BY 1, 2),
  entries AS MATERIALIZED (SELECT DISTINCT node AS url FROM st WHERE ord = 1),
  live AS MATERIALIZED (SELECT e.* FROM edges e WHERE src NOT IN (SELECT url FROM nodes WHERE win))
"""
