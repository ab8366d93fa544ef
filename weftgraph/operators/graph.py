"""The link graph and what can be reached in it.

nodes: url, explored, win, win_source, ...; edges: src, dst, regions array<string>, operator boolean, one row for each
pair. Searches advance level by level; a `label` column lets searches of different modes, targets or starts advance
together. Each level is written to the shared folder, so no lineage grows and lost executors cost one level at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from weftgraph.storage import drop, durable

CHROME = ("nav", "header", "footer")
ALL_LINKS, CONTENT_ONLY = "all_links", "content_only"
#: Levels after which the tables of visited nodes are merged into one and dealt out anew.
MERGE_LEVELS = 8
#: Blocks of starts at least, each two of which are compared by themselves, and how many starts a block has where there are more.
PAIR_BLOCKS, PAIR_STARTS = 16, 3_500
#: Edges of a search that one task is dealt, where the session's number of shuffle partitions allows.
TASK_EDGES = 200_000
#: Nodes of a level, up to which they are sent to the edges instead of being dealt out to them.
FEW_NODES = 20_000


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def build_graph(pages: DataFrame, links: DataFrame) -> Graph:
    """Parallel links become one edge with the set of their regions; operator links add no region; self-links and rows
    without both ends are dropped; ends that are no page become unexplored nodes."""
    ends = links.filter("src is not null and dst is not null and src <> dst")
    edges = ends.groupBy("src", "dst").agg(
        F.array_sort(F.collect_set(F.when(~F.col("operator"), F.col("region")))).alias("regions"),
        F.bool_or("operator").alias("operator"),
    )
    edges = durable(edges, "graph-edges")  # the nodes are made of them too
    # of rows with one URL the first by all other columns stays
    place = F.row_number().over(Window.partitionBy("url").orderBy(*(F.to_json(F.struct(c)) for c in pages.columns if c != "url"), F.lit(0)))
    known = pages.withColumn("__n", place).filter("__n = 1").drop("__n")
    urls = edges.select(F.explode(F.array("src", "dst")).alias("url")).distinct()
    extra = urls.join(known.select("url"), "url", "left_anti")
    nodes = known.unionByName(extra, allowMissingColumns=True)
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("explored", "win") if c in nodes.columns}
    return Graph(nodes.withColumns(flags), edges)


def in_mode(mode: str, include_operator: bool = True) -> Column:
    """Whether an edge counts: by any region, or by a region outside the page frame."""
    regions = F.col("regions") if mode == ALL_LINKS else F.array_except("regions", F.array(*map(F.lit, CHROME)))
    counts = F.size(regions) > 0
    return counts | F.col("operator") if include_operator else counts


def in_body() -> Column:
    return F.array_contains("regions", "body")


def wins(graph: Graph) -> DataFrame:
    return graph.nodes.filter("win").select("url")


def terminal(edges: DataFrame, graph: Graph) -> DataFrame:
    """Edges without those that leave a win."""
    return edges.join(wins(graph).withColumnRenamed("url", "src"), "src", "left_anti")


def mode_view(graph: Graph, mode: str, include_operator: bool = True) -> DataFrame:
    return terminal(graph.edges.filter(in_mode(mode, include_operator)), graph).select("src", "dst")


def labelled_views(graph: Graph, modes: tuple[str, ...] = (ALL_LINKS, CONTENT_ONLY)) -> DataFrame:
    """(label, src, dst) of all modes in one pass over the edges."""
    hit = [F.when(in_mode(m), F.lit(m)) for m in modes]
    return terminal(graph.edges, graph).select(F.explode(F.array_compact(F.array(*hit))).alias("label"), "src", "dst")


def reverse(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(*rest, F.col("dst").alias("src"), F.col("src").alias("dst"))


def _held(df: DataFrame, *key: str) -> DataFrame:
    """df dealt out and sorted by the key, kept on the executors' disks; what is lost there is made again from df.

    Joins on the key see how it lies only if it was planned without adaptive execution, which the session does without meanwhile."""
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.repartition(int(conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key).persist(StorageLevel.DISK_ONLY)
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


@contextmanager
def _dealt(spark: SparkSession, rows: int) -> Iterator[None]:
    """Meanwhile shuffles have a partition for each TASK_EDGES rows, one for each core at least; never more than the session has."""
    conf, name = spark.conf, "spark.sql.shuffle.partitions"
    before = conf.get(name)
    conf.set(name, str(min(int(before), max(spark.sparkContext.defaultParallelism, -(-rows // TASK_EDGES)))))
    try:
        yield
    finally:
        conf.set(name, before)


def levels(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, urls: DataFrame | None = None) -> DataFrame:
    """(label, node, d): clicks from the nearest start of the label. edges(label, src, dst), starts(label, node).

    Edges without a label serve all labels, which ride with the starts, as do further columns of the starts. Edges are
    shuffled once for the whole search: they lie dealt out by the node that a level comes from, so that a level moves its own
    rows only. Of visited nodes those of all but the last MERGE_LEVELS levels lie in the same way. Where labelled edges are more
    than one task is dealt, labels and nodes are known by hashes of 64 bits during the search, and by their names where two
    have the same hash. urls(url): all ends of edges, if at hand.
    """
    key = ["label", "node"] if "label" in edges.columns else ["node"]
    own = [*(c for c in starts.columns if c not in ("label", "node")), "label", "node"]
    table = durable(edges.select(*(k for k in key if k == "label"), F.col("src").alias("node"), "dst"), "bfs-edges")
    starts, size = starts.select(*own).distinct(), table.count()
    with _dealt(table.sparkSession, size):
        names = _names(table, starts, urls) if len(key) == 2 and size > TASK_EDGES else None
        if names is None:
            found = _levels(table, key, own, starts, max_depth)
        else:
            code = lambda *names: [F.xxhash64(c).alias(c) for c in names]
            coded = durable(table.select(*code("label", "node", "dst")), "bfs-edges")
            found = _levels(coded, key, own, starts.select(*own[:-2], *code("label", "node")), max_depth)
            found = found.withColumnsRenamed({k: f"{k}_code" for k in key})
            found = found.join(F.broadcast(names[0]), "label_code").join(names[1], "node_code").select(*own, "d")
            drop(coded)
    drop(table)
    return found


def _names(table: DataFrame, starts: DataFrame, urls: DataFrame | None) -> list[DataFrame] | None:
    """Labels and nodes of a search with their codes; None if two of a kind have one code."""
    ends = table.select(F.explode(F.array("node", "dst")).alias("node")) if urls is None else urls.select(F.col("url").alias("node"))
    all_names = []
    for c, rows in (("label", table.select("label")), ("node", ends)):
        rows = rows.unionByName(starts.select(c)).distinct()
        all_names.append(durable(rows.withColumn(f"{c}_code", F.xxhash64(c)), "bfs-names"))
        if not all_names[-1].groupBy(f"{c}_code").count().filter("count > 1").isEmpty():
            return None
    return all_names


def _levels(table: DataFrame, key: list[str], own: list[str], starts: DataFrame, max_depth: int | None) -> DataFrame:
    """(*own, d). table(*key, dst) are the edges, key being what an edge starts from and own what tells visited nodes apart."""
    held, base = _held(table, *key), None
    seen = [durable(starts.withColumn("d", F.lit(0)), "bfs-level")]
    recent, depth, n = [seen[0]], 0, seen[0].count()
    while (max_depth is None or depth < max_depth) and n:
        depth += 1
        front = F.broadcast(recent[-1]) if n <= FEW_NODES else recent[-1]
        step = front.join(held, key).select(*own[:-1], F.col("dst").alias("node")).distinct()
        if base is not None:
            step = step.join(base, own, "left_anti")
        step = step.join(reduce(DataFrame.unionByName, recent).select(*own), own, "left_anti")
        recent.append(durable(step.withColumn("d", F.lit(depth)), "bfs-level"))
        seen.append(recent[-1])
        n = recent[-1].count()
        if len(recent) > MERGE_LEVELS:
            merged = durable(reduce(DataFrame.unionByName, seen[:-1]), "bfs-visited")
            for gone in seen[:-1]:
                drop(gone)
            if base is not None:
                base.unpersist()
            seen, recent, base = [merged, seen[-1]], [seen[-1]], _held(merged.select(*own), *own)
    held.unpersist()
    if base is not None:
        base.unpersist()
    return reduce(DataFrame.unionByName, seen)


def distances_to_win(graph: Graph, modes: tuple[str, ...] = (ALL_LINKS, CONTENT_ONLY), views: DataFrame | None = None) -> DataFrame:
    """(label, node, d) with the mode as label; nodes without a path are absent. views: labelled_views() of these modes, if at hand."""
    starts = wins(graph).withColumnRenamed("url", "node")
    starts = starts.withColumn("label", F.explode(F.array(*map(F.lit, modes))))
    return levels(reverse(labelled_views(graph, modes) if views is None else views), starts, urls=graph.nodes)


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(label, node) within any number of clicks of the starts, the starts included."""
    return levels(edges, starts).select("label", "node")


def click_depths(graph: Graph, home: DataFrame, through_wins: bool = True, labels: tuple[str, ...] = ("all", "body")) -> DataFrame:
    """(label in all/body, node, d) from home(node). Operator edges have no region and do not count."""
    rows = graph.edges if through_wins else terminal(graph.edges, graph)
    tests = {"all": F.size("regions") > 0, "body": in_body()}
    hit = F.array(*(F.when(tests[label], label) for label in labels))
    edges = rows.select(F.explode(F.array_compact(hit)).alias("label"), "src", "dst")
    return levels(edges, home.withColumn("label", F.explode(F.array(*map(F.lit, labels)))), urls=graph.nodes)


def win_type_distances(graph: Graph) -> DataFrame:
    """(label, node, d): to each win type, each class that is no win, and any win, over all links, in one search."""
    kinds = F.array_compact(F.array(F.when(F.col("win"), F.lit("(any)")), F.when(F.col("win"), F.col("win_type")), F.when(~F.col("win"), F.col("conversion_class"))))
    targets = graph.nodes.select(F.explode(F.array_distinct(kinds)).alias("label"), F.col("url").alias("node"))
    return levels(reverse(mode_view(graph, ALL_LINKS)), targets)


def shortest_paths(edges: DataFrame, starts: DataFrame, stops: DataFrame) -> DataFrame:
    """(label, start, path): for each start the shortest path to a stop, of equal ones the least by its nodes' order.

    edges(label, src, dst), starts(label, start), stops(label, node). A start that is a stop has a path of itself.
    Starts without a path are absent. Distances are counted from the stops backwards; then every node knows its least
    neighbour that is one step nearer, and a start follows these: one row for each start and step.
    """
    edges = durable(edges.select("label", "src", "dst"), "path-edges")
    dist = durable(levels(reverse(edges), stops.select("label", "node").distinct()), "path-distances")
    nearer = dist.select("label", F.col("node").alias("dst"), (F.col("d") + 1).alias("d"))
    leaving = edges.join(dist.select("label", F.col("node").alias("src"), "d"), ["label", "src"]).join(nearer, ["label", "dst", "d"])
    hops = durable(leaving.groupBy("label", F.col("src").alias("node")).agg(F.min("dst").alias("next")), "path-hops")
    first = starts.select("label", "start", F.col("start").alias("node")).distinct().join(dist, ["label", "node"])
    parts = [durable(first.select("label", "start", "node", "d"), "path-step")]
    while True:
        step = parts[-1].filter("d > 0").join(hops, ["label", "node"])
        step = durable(step.select("label", "start", F.col("next").alias("node"), (F.col("d") - 1).alias("d")), "path-step")
        if step.isEmpty():
            break
        parts.append(step)
    told = reduce(DataFrame.unionByName, parts).groupBy("label", "start").agg(F.array_sort(F.collect_list(F.struct((-F.col("d")).alias("back"), "node"))).alias("x"))
    return told.select("label", "start", F.transform("x", lambda x: x["node"]).alias("path"))


def longest_paths(edges: DataFrame, starts: DataFrame, dist: DataFrame, max_depth: int, row_budget: int = 5_000_000) -> DataFrame:
    """(label, start, path, exhaustive): the longest path without repetition that ends at its first win.

    dist(label, node, d) are the distances to a win, 0 for wins; steps that cannot reach one within max_depth clicks are
    not taken. The budget is one for each label and start: where a level holds more than row_budget paths of a start, the
    least of those that are on a shortest route and the first of the others in order go on, and that start's result, a lower
    bound, is marked as not exhaustive. A start that has a path within max_depth has a row in any case.
    """
    dist = durable(dist.select("label", "node", "d"), "long-dist")
    edges = edges.select("label", F.col("src").alias("node"), "dst")
    ahead = dist.select("label", F.col("node").alias("dst"), "d")
    edges = durable(edges.join(ahead, ["label", "dst"]), "long-edges")  # only steps from which a win is in reach
    first = starts.select("label", "start", F.col("start").alias("node")).distinct().join(dist, ["label", "node"])
    front = durable(first.filter(F.col("d") <= max_depth).select("label", "start", "node", F.array("node").alias("path"), "d"), "long-level")
    found, cut = [], []
    own = Window.partitionBy("label", "start")
    for clicks in range(max_depth + 1):
        ended = front.filter("d = 0").select("label", "start", "path")
        found.append(durable(ended.groupBy("label", "start").agg(F.min("path").alias("path")), "long-found"))
        going = front.filter("d > 0").drop("d")
        step = going.join(edges, ["label", "node"]).filter(~F.array_contains("path", F.col("dst")))
        step = step.filter(F.col("d") + clicks + 1 <= max_depth)
        step = step.select("label", "start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), "d")
        front = durable(step, "long-level")
        if front.isEmpty():
            break
        over = front.groupBy("label", "start").count().filter(F.col("count") > row_budget).select("label", "start")
        over = durable(over, "long-over")
        if not over.isEmpty():
            cut.append(over)
            dense = front.join(over, ["label", "start"], "left_semi").withColumn("least", F.min(F.struct("d", "path")).over(own))
            rank = F.row_number().over(own.orderBy(F.col("path") != F.col("least.path"), "path"))
            dense = dense.withColumn("rank", rank).filter(F.col("rank") <= row_budget).select(front.columns)
            front = durable(front.join(over, ["label", "start"], "left_anti").select(front.columns).unionByName(dense), "long-level")
    best = reduce(DataFrame.unionByName, found).groupBy("label", "start")
    best = best.agg(F.min(F.struct((-F.size("path")).alias("n"), "path")).alias("m")).select("label", "start", F.col("m.path").alias("path"))
    if not cut:
        return best.withColumn("exhaustive", F.lit(True))
    marked = reduce(DataFrame.unionByName, cut).distinct().withColumn("cut", F.lit(True))
    return best.join(marked, ["label", "start"], "left").select("label", "start", "path", F.col("cut").isNull().alias("exhaustive"))


def dead_zones(graph: Graph, views: DataFrame, dist: DataFrame | None, entries: DataFrame) -> DataFrame:
    """(label, node, state, d) of every node that entries(label, node) reach, d being the clicks to a win: dist's, if it is at hand.

    state: win, reaches win, dead end, unknown, or unexplored. Dead ends and unknown nodes are explored and have no path
    to a win; the unknown ones can reach a node that is not explored. What entries reach, and what reaches wins and nodes
    that are not explored, is found in one search, over edges of both directions.
    """
    status = graph.nodes.select(F.col("url").alias("node"), "explored", "win")
    labels = views.select("label").distinct().unionByName(entries.select("label").distinct()).distinct()
    ends = status.filter("win or not explored" if dist is None else "not win and not explored").select("node", F.when(F.col("win"), "win").otherwise("open").alias("goal"))
    to = lambda way: F.concat(F.lit(way), "label").alias("label")
    edges = views.select(to(">"), "src", "dst").unionByName(reverse(views).select(to("<"), "src", "dst"))
    starts = entries.select(F.lit("reach").alias("goal"), to(">"), "node").unionByName(ends.crossJoin(F.broadcast(labels)).select("goal", to("<"), "node"))
    found = levels(edges, starts, urls=graph.nodes).withColumn("label", F.substring("label", 2, 1 << 30))
    told = found.groupBy("label", "node").agg(*(F.min(F.when(F.col("goal") == goal, F.col("d"))).alias(name) for goal, name in (("reach", "reached"), ("win", "d"), ("open", "open"))))
    told = told.filter("reached is not null")
    if dist is not None:
        told = told.drop("d").join(dist.select("label", "node", "d"), ["label", "node"], "left")
    state = (
        F.when(F.col("win"), "win")
        .when(~F.col("explored"), "unexplored")
        .when(F.col("d").isNotNull(), "reaches win")
        .when(F.col("open").isNotNull(), "unknown")
        .otherwise("dead end")
    )
    return told.join(status, "node").select("label", "node", state.alias("state"), "d")


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """The written edges(label, src, dst) without those that can be on no cycle, as their ends only lead in or out, and their number."""
    n = edges.count()
    while n:
        into = edges.select("label", F.col("dst").alias("src")).distinct()
        out = edges.select("label", F.col("src").alias("dst")).distinct()
        edges = durable(edges.join(into, ["label", "src"], "left_semi").join(out, ["label", "dst"], "left_semi"), "scc-edges")
        left, n = n, edges.count()
        if left == n:
            break
    return edges, n


def trap_loops(views: DataFrame, dead: DataFrame) -> DataFrame:
    """(label, loop, node): strongly connected groups of two or more among dead(label, node); loop is the least member.

    Nodes without a dead predecessor or successor are trimmed away until none is left. In the rest every node takes the
    greatest node that reaches it as its colour; those of a colour that reach its namesake are one group, which goes, and
    what is left is trimmed and coloured anew. Tables have a row for each edge or node.
    """
    dead = dead.select("label", "node").distinct()
    edges = views.join(dead.withColumnRenamed("node", "src"), ["label", "src"], "left_semi")
    edges = durable(edges.join(dead.withColumnRenamed("node", "dst"), ["label", "dst"], "left_semi").select("label", "src", "dst").distinct(), "scc-edges")
    edges, n = _trimmed(edges)
    loops = []
    while n:
        # every node takes the greatest node that reaches it; the nodes of a colour that reach its namesake are one loop
        colours = edges.select("label", F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node"))
        colours, moved = durable(colours, "scc-colours"), True
        while moved:
            along = edges.join(colours.withColumnRenamed("node", "src"), ["label", "src"]).select("label", F.col("dst").alias("node"), "colour", F.lit(False).alias("own"))
            both = along.unionByName(colours.select("label", "node", "colour", F.lit(True).alias("own")))
            best = both.groupBy("label", "node").agg(F.max("colour").alias("colour"), F.max(F.when(F.col("own"), F.col("colour"))).alias("before"))
            best = durable(best, "scc-colours")
            moved = not best.filter("colour <> before").isEmpty()
            colours = best.select("label", "node", "colour")
        ends = [colours.select("label", F.col("node").alias(c), F.col("colour").alias(f"{c}_colour")) for c in ("src", "dst")]
        inside = edges.join(ends[0], ["label", "src"]).join(ends[1], ["label", "dst"]).filter("src_colour = dst_colour")
        name = F.struct("label", F.col("src_colour").alias("colour"))
        roots = colours.filter("node = colour").select(F.struct("label", "colour").alias("label"), "node")
        found = durable(reachable(reverse(inside.select(name.alias("label"), "src", "dst")), roots).select("label.label", "label.colour", "node"), "scc-found")
        loops.append(found)
        gone = found.select("label", "node")
        for c in ("src", "dst"):
            edges = edges.join(gone.withColumnRenamed("node", c), ["label", c], "left_anti")
        edges, n = _trimmed(durable(edges, "scc-edges"))
    if not loops:
        return dead.select("label", F.col("node").alias("loop"), "node").limit(0)
    found = reduce(DataFrame.unionByName, loops)
    sizes = found.groupBy("label", "colour").agg(F.count("*").alias("n"), F.min("node").alias("loop")).filter("n > 1")
    return found.join(sizes, ["label", "colour"]).select("label", "loop", "node")


def convergence(paths: DataFrame) -> DataFrame:
    """(label, a, b, common, jaccard) of every two starts' paths(label, start, path), of those without a common node too.

    The result grows with the square of the starts; each has one path. They are dealt to blocks of about PAIR_STARTS, and every two
    blocks are joined once and apart, so that no task holds all pairs of a label. A node that lies on one path alone is common to
    none, so nodes are looked at only where two paths have other ones, and among these two of the same of 64 bits.
    """
    paths = durable(paths.filter("start is not null").select("label", "start", F.array_distinct("path").alias("path")), "pair-paths")
    along = paths.select("label", "start", F.explode("path").alias("node"))
    many = along.groupBy("label", "node").count().filter("count > 1")
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(node), 64) as int))")
    met = along.join(many, ["label", "node"], "left_semi").groupBy("label", "start").agg(F.collect_list("node").alias("path"), F.bit_or(bit).alias("bits"))
    told = paths.select("label", "start", F.size("path").alias("n")).join(met, ["label", "start"], "left")
    told = durable(told.withColumn("bits", F.coalesce("bits", F.lit(0).cast("long"))), "pair-paths")
    blocks = max(PAIR_BLOCKS, -(-told.count() // PAIR_STARTS))
    own = F.pmod(F.xxhash64("start"), F.lit(blocks)).cast("int")
    side = lambda k: told.select("label", *(F.col(c).alias(f"{c}_{k}") for c in ("start", "n", "path", "bits")), own.alias(k))
    left = side("i").withColumn("j", F.explode(F.sequence("i", F.lit(blocks - 1))))
    right = side("j").withColumn("i", F.explode(F.sequence(F.lit(0), "j")))
    key, parts = ["label", "i", "j"], int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = left.repartition(parts, *key).join(right.repartition(parts, *key).hint("merge"), key)  # a broadcast would leave all pairs to few tasks
    pairs = pairs.filter("i < j or start_i < start_j")
    common = F.sort_array(F.array_intersect("path_i", "path_j"))
    common = F.when(F.col("bits_i").bitwiseAND(F.col("bits_j")) != 0, common).otherwise(F.array().cast("array<string>"))
    found = pairs.select("label", F.least("start_i", "start_j").alias("a"), F.greatest("start_i", "start_j").alias("b"), common.alias("common"), (F.col("n_i") + F.col("n_j")).alias("n"))
    share = F.bround(F.size("common") / (F.col("n") - F.size("common")), 3)  # rounding takes longer than all else
    return found.select("label", "a", "b", "common", F.when(F.size("common") > 0, share).otherwise(0.0).alias("jaccard"))


def meetings(paths: DataFrame) -> DataFrame:
    """(label, start, meets, jaccard, nearest) of the paths(label, start, path) of shortest_paths(): how many other starts' paths share a
    node with it, the greatest share of nodes that it has in common with one, and that one, of equal ones the least.

    Each node of such paths leads on to one node alone. So two paths that meet go on together to the same end, and paths meet
    just if they end alike: a count for each end. From a node on, a path of n nodes shares the rest of r nodes with all that come
    through, and the share r / (n + m - r) is greatest for the shortest one, of m nodes: so two starts for each node are enough.
    """
    n = F.size("path").alias("n")
    ends = paths.groupBy("label", F.element_at("path", -1).alias("end")).agg((F.count("*") - 1).alias("meets"))
    along = paths.select("label", "start", n, F.posexplode("path").alias("at", "node"))
    two = along.groupBy("label", "node").agg(F.min(F.struct("n", "start")).alias("first"))
    other = along.join(two, ["label", "node"]).filter("start <> first.start").groupBy("label", "node").agg(F.min(F.struct("n", "start")).alias("second"))
    near = along.join(two, ["label", "node"]).join(other, ["label", "node"])
    of = F.when(F.col("first.start") == F.col("start"), F.col("second")).otherwise(F.col("first"))
    rest = F.col("n") - F.col("at")
    met = near.select("label", "start", of.alias("of"), rest.alias("rest"), "n").withColumn("share", F.col("rest") / (F.col("n") + F.col("of.n") - F.col("rest")))
    best = met.groupBy("label", "start").agg(F.min(F.struct((-F.col("share")).alias("share"), F.col("of.start").alias("nearest"))).alias("b"))
    joined = paths.select("label", "start", F.element_at("path", -1).alias("end")).join(ends, ["label", "end"]).join(best, ["label", "start"], "left")
    return joined.select("label", "start", "meets", (-F.col("b.share")).alias("jaccard"), F.col("b.nearest").alias("nearest"))


def in_degrees(graph: Graph) -> DataFrame:
    return graph.edges.groupBy(F.col("dst").alias("url")).agg(F.count("*").alias("in_degree"))


def operator_dependency(graph: Graph, entries: DataFrame, mode: str) -> DataFrame:
    """(start, path, uses_operator, d_without, depends): shortest paths that only an operator's jump makes possible."""
    label = F.lit(mode)
    stops = wins(graph).select(label.alias("label"), F.col("url").alias("node"))
    starts = entries.select(label.alias("label"), F.col("url").alias("start"))
    view = mode_view(graph, mode).withColumn("label", label)
    without = mode_view(graph, mode, include_operator=False).withColumn("label", label)
    paths = shortest_paths(view, starts, stops)
    plain = shortest_paths(without, starts, stops).select("start", (F.size("path") - 1).alias("d_without"))
    jumps = graph.edges.filter(F.col("operator") & ~in_mode(mode, include_operator=False)).select("src", "dst")
    hop = paths.select("start", F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("src"), F.slice("path", 2, F.size("path")).alias("dst"))).alias("h"))
    used = hop.select("start", "h.*").join(jumps, ["src", "dst"], "left_semi").select("start").distinct().withColumn("used", F.lit(True))
    joined = paths.drop("label").join(used, "start", "left").join(plain, "start", "left")
    return joined.select("start", "path", F.coalesce("used", F.lit(False)).alias("uses_operator"), "d_without", F.col("d_without").isNull().alias("depends"))
