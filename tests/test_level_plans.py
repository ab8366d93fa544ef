import random
from collections import deque

import pytest

from weftgraph.operators import graph as g


def slow(edges, starts):
    out = {}
    for label in {x for x, _ in starts}:
        near = {n: 0 for x, n in starts if x == label}
        todo = deque(near)
        while todo:
            at = todo.popleft()
            for x, a, b in edges:
                if a == at and x in (label, None) and b not in near:
                    near[b] = near[at] + 1
                    todo.append(b)
        out |= {(label, n): d for n, d in near.items()}
    return out


@pytest.fixture
def plans(spark, monkeypatch):
    """The plans of all levels of a search, without broadcasts."""
    seen, real = [], g.durable

    def watched(df, name):
        if name == "bfs-level":
            seen.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(g, "durable", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield seen
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_edges_are_shuffled_once_a_search(spark, plans):
    chain = [("x", f"n{k}", f"n{k + 1}") for k in range(21)] + [("x", "n3", "n0"), ("x", "n9", "n2")]
    edges = spark.createDataFrame(chain, "label string, src string, dst string")
    starts = spark.createDataFrame([("x", "n0")], "label string, node string")
    assert {(r["label"], r["node"]): r["d"] for r in g.levels(edges, starts).collect()} == slow(chain, [("x", "n0")])
    assert len(plans) == 23  # the start, 21 levels and an empty one
    for plan in plans[1:]:
        # the level's own rows, their targets, and the last levels' nodes are dealt out; edges and older nodes lie as they are wanted
        assert plan.count("Exchange hashpartitioning") - plan.count("REPARTITION_BY_NUM") <= 3, plan
        assert "InMemoryTableScan" in plan
    assert plans[15].count("InMemoryTableScan") == 2 and plans[3].count("InMemoryTableScan") == 1


@pytest.mark.parametrize("labelled", [True, False])
def test_labels_ride_with_the_starts(spark, labelled):
    rng = random.Random(4)
    edges = [(rng.choice("xy") if labelled else None, f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(70)]
    starts = [("x", "n1"), ("y", "n2"), ("y", "n3"), ("x", "lone")]
    frame = spark.createDataFrame(edges, "label string, src string, dst string")
    frame = frame if labelled else frame.drop("label")
    found = g.levels(frame, spark.createDataFrame(starts, "label string, node string"))
    assert {(r["label"], r["node"]): r["d"] for r in found.collect()} == slow(edges, starts)
    near = g.levels(frame, spark.createDataFrame(starts, "label string, node string"), max_depth=2)
    assert {(r["label"], r["node"]): r["d"] for r in near.collect()} == {k: d for k, d in slow(edges, starts).items() if d <= 2}


def test_no_starts(spark):
    edges = spark.createDataFrame([("x", "a", "b")], "label string, src string, dst string")
    assert g.levels(edges, spark.createDataFrame([], "label string, node string")).count() == 0


def test_meetings_of_shortest_paths(spark):
    paths = [("m", "a", ["a", "c", "w"]), ("m", "b", ["b", "c", "w"]), ("m", "w", ["w"]), ("m", "d", ["d", "e", "f", "c", "w"]), ("m", "v", ["v"]), ("m", "u", ["u", "v"]), ("n", "a", ["a"])]
    found = {(r["label"], r["start"]): (r["meets"], r["jaccard"] and round(r["jaccard"], 3), r["nearest"]) for r in g.meetings(spark.createDataFrame(paths, "label string, start string, path array<string>")).collect()}
    for label, start, path in paths:
        shares = [(len(set(path) & set(p)) / len(set(path) | set(p)), s) for x, s, p in paths if x == label and s != start and set(p) & set(path)]
        best = min(((-j, s) for j, s in shares), default=(None, None))
        assert found[label, start] == (len(shares), best[0] and round(-best[0], 3), best[1])
