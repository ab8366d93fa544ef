"""Queries over the journey graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftgraph.operators import compare, graph as g
from weftgraph.plans.journey import GRAPH_SQL, journey_graph
from weftgraph.storage import durable


def _modes(df: DataFrame, column: str, modes: tuple[str, ...]) -> DataFrame:
    return df.select(F.explode(F.array(*map(F.lit, modes))).alias("label"), F.col("url").alias(column))


def _histogram(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    graph, _ = journey_graph(spark, sf_dir)
    dist = g.distances_to_win(graph, (mode,))
    loaded = graph.nodes.filter("explored").select(F.col("url").alias("node"))
    return dist.join(loaded, "node", "left_semi").groupBy(F.col("d").cast("long").alias("clicks")).agg(F.count("*").alias("pages"))


def clicks_to_win_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(spark, sf_dir, g.ALL_LINKS)


def clicks_to_win_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(spark, sf_dir, g.CONTENT_ONLY)


def _from_home(spark: SparkSession, sf_dir: str, label: str, through_wins: bool) -> DataFrame:
    graph, entries = journey_graph(spark, sf_dir)
    depths = g.click_depths(graph, entries.select(F.col("url").alias("node")), through_wins, (label,))
    return depths.groupBy(F.col("d").cast("long").alias("clicks")).agg(F.count("*").alias("pages"))


def clicks_from_home_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_home(spark, sf_dir, "all", True)


def clicks_from_home_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_home(spark, sf_dir, "body", True)


def depth_from_home_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_home(spark, sf_dir, "all", False)


def reachable_from_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, entries = journey_graph(spark, sf_dir)
    modes = (g.ALL_LINKS, g.CONTENT_ONLY)
    found = g.reachable(g.labelled_views(graph), _modes(entries, "node", modes))
    return found.groupBy(F.col("label").alias("mode")).agg(F.count("*").alias("pages"))


def _zones(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    graph, entries = journey_graph(spark, sf_dir)
    views = durable(g.labelled_views(graph), "views")  # for all searches
    zones = g.dead_zones(graph, views, None, _modes(entries, "node", (g.ALL_LINKS, g.CONTENT_ONLY)))
    return views, durable(zones, "zones")


def dead_unknown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, zones = _zones(spark, sf_dir)
    return zones.groupBy(F.col("label").alias("mode"), "state").agg(F.count("*").alias("pages"))


def trap_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    views, zones = _zones(spark, sf_dir)
    loops = g.trap_loops(views, zones.filter("state = 'dead end'"))
    return loops.groupBy(F.col("label").alias("mode"), "loop").agg(F.count("*").alias("pages"), F.array_join(F.array_sort(F.collect_list("node")), " ").alias("members"))


def _paths(spark: SparkSession, sf_dir: str, modes: tuple[str, ...] = (g.ALL_LINKS, g.CONTENT_ONLY)) -> DataFrame:
    graph, entries = journey_graph(spark, sf_dir)
    return g.shortest_paths(g.labelled_views(graph, modes), _modes(entries, "start", modes), _modes(g.wins(graph), "node", modes))


def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _paths(spark, sf_dir)
    return found.select(F.col("label").alias("mode"), "start", F.array_join("path", " > ").alias("path"), (F.size("path") - 1).cast("long").alias("clicks"))


def longest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, entries = journey_graph(spark, sf_dir)
    mode = (g.CONTENT_ONLY,)
    found = g.longest_paths(g.labelled_views(graph, mode), _modes(entries, "start", mode), g.distances_to_win(graph, mode), 6)
    return found.select("start", F.array_join("path", " > ").alias("path"), (F.size("path") - 1).cast("long").alias("clicks"), "exhaustive")


def path_overlap_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = g.convergence(_paths(spark, sf_dir, (g.ALL_LINKS,)))
    return pairs.select("a", "b", F.size("common").cast("long").alias("n_common"), "jaccard")


def inbound_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, _ = journey_graph(spark, sf_dir)
    return g.in_degrees(graph).select("url", F.col("in_degree").cast("long").alias("in_degree"))


def top_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbound_links(spark, sf_dir).orderBy(F.desc("in_degree"), "url").limit(10)


def distance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, _ = journey_graph(spark, sf_dir)
    dist = g.distances_to_win(graph)
    modes = F.explode(F.array(F.lit(g.ALL_LINKS), F.lit(g.CONTENT_ONLY))).alias("label")
    joined = graph.nodes.filter("explored").select(F.col("url").alias("node"), modes).join(dist, ["label", "node"], "left")
    found = compare.distance_summary(joined.withColumnRenamed("label", "mode"), "d", "mode")
    share = F.bround(100 * F.col("reached") / F.col("pages"), 1).alias("share")
    return found.select("mode", "pages", "reached", "no_route", share, *(F.col(c).cast("long").alias(c) for c in ("p50", "p90", "deepest")))


def frontier_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.operators.frontier import crawl_levels

    graph, entries = journey_graph(spark, sf_dir)
    queue = crawl_levels(graph.edges.select("src", "dst"), entries, graph, max_depth=8)
    return queue.groupBy(F.col("depth").cast("long").alias("depth"), "state").agg(F.count("*").alias("urls"), F.min("url").alias("first_url"))


def _bfs_sql(start: str, edges: str, forward: bool, tail: str) -> str:
    to, on = ("dst", "src = node") if forward else ("src", "dst = node")
    return f"""
WITH RECURSIVE {GRAPH_SQL},
  walk(node, d) AS ({start} UNION SELECT {to}, d + 1 FROM walk JOIN {edges} ON {on} WHERE d < 40),
  dist AS (SELECT node, min(d) AS d FROM walk GROUP BY node)
{tail}"""


_WIN_START = "SELECT url, 0 FROM nodes WHERE win"
_HOME_START = "SELECT url, 0 FROM entries"
_LOADED = "JOIN nodes n ON n.url = node AND n.explored"
_HIST = "SELECT d::BIGINT AS clicks, count(*) AS pages FROM dist {0} GROUP BY d"
_ZONE_SQL = """
WITH RECURSIVE {graph},
  view AS MATERIALIZED (SELECT 'all_links' AS mode, src, dst FROM live UNION ALL SELECT 'content_only', src, dst FROM live WHERE content),
  modes AS (SELECT unnest(['all_links', 'content_only']) AS mode),
  towin(mode, node) AS (SELECT mode, url FROM nodes, modes WHERE win UNION SELECT v.mode, src FROM towin t JOIN view v ON v.mode = t.mode AND dst = node),
  open(mode, node) AS (SELECT mode, url FROM nodes, modes WHERE NOT win AND NOT explored UNION SELECT v.mode, src FROM open t JOIN view v ON v.mode = t.mode AND dst = node),
  reach(mode, node) AS (SELECT mode, url FROM entries, modes UNION SELECT v.mode, dst FROM reach t JOIN view v ON v.mode = t.mode AND src = node),
  zones AS MATERIALIZED (SELECT r.mode, r.node, CASE WHEN n.win THEN 'win' WHEN NOT n.explored THEN 'unexplored' WHEN t.node IS NOT NULL THEN 'reaches win'
      WHEN o.node IS NOT NULL THEN 'unknown' ELSE 'dead end' END AS state
    FROM reach r JOIN nodes n ON n.url = r.node LEFT JOIN towin t ON t.mode = r.mode AND t.node = r.node LEFT JOIN open o ON o.mode = r.mode AND o.node = r.node)
"""
_PATH_SQL = """
WITH RECURSIVE {graph},
  view AS MATERIALIZED (SELECT 'all_links' AS mode, src, dst FROM live UNION ALL SELECT 'content_only', src, dst FROM live WHERE content),
  modes AS (SELECT unnest(['all_links', 'content_only']) AS mode),
  fd(mode, start, node, d) AS (SELECT mode, url, url, 0 FROM entries, modes UNION SELECT f.mode, start, dst, d + 1 FROM fd f JOIN view v ON v.mode = f.mode AND src = node WHERE d < 17),
  near AS MATERIALIZED (SELECT mode, start, node, min(d) AS d FROM fd GROUP BY ALL),
  goal AS MATERIALIZED (SELECT mode, start, min(d) AS d FROM near JOIN nodes ON url = node AND win GROUP BY ALL),
  grow(mode, start, node, d, path) AS (SELECT mode, start, start, 0, [start] FROM goal
    UNION ALL SELECT * FROM (SELECT x.mode, x.start, v.dst, x.d + 1, min(list_append(x.path, v.dst)) FROM grow x JOIN view v ON v.mode = x.mode AND v.src = x.node
      JOIN near n ON n.mode = x.mode AND n.start = x.start AND n.node = v.dst AND n.d = x.d + 1 JOIN goal q ON q.mode = x.mode AND q.start = x.start AND x.d < q.d GROUP BY ALL)),
  best AS (SELECT g.mode, g.start, min(path) AS path FROM grow g JOIN goal q ON q.mode = g.mode AND q.start = g.start AND q.d = g.d JOIN nodes ON url = node AND win GROUP BY ALL)
"""

QUERIES = {
    "clicks_to_win_all": clicks_to_win_all,
    "clicks_to_win_content": clicks_to_win_content,
    "clicks_from_home_all": clicks_from_home_all,
    "clicks_from_home_body": clicks_from_home_body,
    "depth_from_home_terminal": depth_from_home_terminal,
    "reachable_from_entries": reachable_from_entries,
    "dead_unknown_labels": dead_unknown_labels,
    "trap_loops": trap_loops,
    "shortest_paths": shortest_paths,
    "longest_paths": longest_paths,
    "path_overlap_jaccard": path_overlap_jaccard,
    "inbound_links": inbound_links,
    "top_hubs": top_hubs,
    "distance_summary": distance_summary,
    "frontier_levels": frontier_levels,
}

_CONTENT = "(SELECT * FROM live WHERE content) live"
_SUMMARY = """SELECT '{mode}' AS mode, count(*) AS pages, count(d) AS reached, count(*) - count(d) AS no_route,
  round_even(100 * count(d) / count(*), 1) AS share, quantile_disc(d, 0.5)::BIGINT AS p50, quantile_disc(d, 0.9)::BIGINT AS p90, max(d)::BIGINT AS deepest
FROM nodes LEFT JOIN dist ON node = url WHERE explored"""

ORACLES = {
    "clicks_to_win_all": _bfs_sql(_WIN_START, "live", False, _HIST.format(_LOADED)),
    "clicks_to_win_content": _bfs_sql(_WIN_START, _CONTENT, False, _HIST.format(_LOADED)),
    "clicks_from_home_all": _bfs_sql(_HOME_START, "edges", True, _HIST.format("")),
    "clicks_from_home_body": _bfs_sql(_HOME_START, "(SELECT * FROM edges WHERE body) edges", True, _HIST.format("")),
    "depth_from_home_terminal": _bfs_sql(_HOME_START, "live", True, _HIST.format("")),
    "reachable_from_entries": _ZONE_SQL.format(graph=GRAPH_SQL) + "SELECT mode, count(*) AS pages FROM reach GROUP BY mode",
    "dead_unknown_labels": _ZONE_SQL.format(graph=GRAPH_SQL) + "SELECT mode, state, count(*) AS pages FROM zones GROUP BY ALL",
    "trap_loops": _ZONE_SQL.format(graph=GRAPH_SQL).rstrip()
    + """,
  far(mode, a, b) AS (SELECT v.mode, src, dst FROM view v JOIN zones x ON x.mode = v.mode AND x.node = src AND x.state = 'dead end' JOIN zones y ON y.mode = v.mode AND y.node = dst AND y.state = 'dead end'
    UNION SELECT f.mode, a, dst FROM far f JOIN view v ON v.mode = f.mode AND src = b JOIN zones y ON y.mode = v.mode AND y.node = dst AND y.state = 'dead end'),
  groups AS (SELECT f.mode, f.a AS node, least(f.a, min(f.b)) AS loop FROM far f JOIN far r ON r.mode = f.mode AND r.a = f.b AND r.b = f.a WHERE f.a <> f.b GROUP BY f.mode, f.a)
SELECT mode, loop, count(*) AS pages, string_agg(node, ' ' ORDER BY node) AS members FROM groups GROUP BY ALL""",
    "shortest_paths": _PATH_SQL.format(graph=GRAPH_SQL)
    + "SELECT mode, start, array_to_string(path, ' > ') AS path, (len(path) - 1)::BIGINT AS clicks FROM best",
    "path_overlap_jaccard": _PATH_SQL.format(graph=GRAPH_SQL)
    + """SELECT x.start AS a, y.start AS b, len(list_intersect(x.path, y.path))::BIGINT AS n_common,
  round_even(len(list_intersect(x.path, y.path)) / len(list_distinct(list_concat(x.path, y.path))), 3) AS jaccard
FROM best x JOIN best y ON x.mode = 'all_links' AND y.mode = 'all_links' AND x.start < y.start""",
    "longest_paths": f"""
WITH RECURSIVE {GRAPH_SQL},
  grow(start, node, path, n) AS (SELECT url, url, [url], 0 FROM entries UNION ALL
    SELECT start, dst, list_append(path, dst), n + 1 FROM grow JOIN live ON src = node AND content WHERE n < 6 AND NOT list_contains(path, dst)),
  done AS (SELECT start, path, n FROM grow JOIN nodes ON url = node AND win),
  best AS (SELECT start, max(n) AS n FROM done GROUP BY start)
SELECT start, array_to_string(min(path), ' > ') AS path, n::BIGINT AS clicks, true AS exhaustive FROM done JOIN best USING (start, n) GROUP BY start, n""",
    "inbound_links": f"WITH {GRAPH_SQL} SELECT dst AS url, count(*) AS in_degree FROM edges GROUP BY dst",
    "top_hubs": f"WITH {GRAPH_SQL} SELECT dst AS url, count(*) AS in_degree FROM edges GROUP BY dst ORDER BY in_degree DESC, url LIMIT 10",
    "distance_summary": "SELECT * FROM ("
    + _bfs_sql(_WIN_START, "live", False, _SUMMARY.format(mode="all_links"))
    + ") UNION ALL SELECT * FROM ("
    + _bfs_sql(_WIN_START, _CONTENT, False, _SUMMARY.format(mode="content_only"))
    + ")",
    "frontier_levels": _bfs_sql(
        _HOME_START,
        "live",
        True,
        "SELECT d::BIGINT AS depth, CASE WHEN explored THEN 'done' ELSE 'pending' END AS state, count(*) AS urls, min(url) AS first_url FROM dist JOIN nodes ON url = node WHERE d <= 8 GROUP BY ALL",
    ),
}
