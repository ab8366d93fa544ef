import itertools

import pytest

from weftgraph.operators import graph as g

MODE = "all_links"


@pytest.fixture(scope="module")
def dense(spark):
    """Pages a0 to a5 that all link to each other, a5 also to a win, and a line z0, z1, z2 to another."""
    edges = [(MODE, f"a{i}", f"a{j}") for i, j in itertools.permutations(range(6), 2)]
    edges += [(MODE, "a5", "win"), (MODE, "z0", "z1"), (MODE, "z1", "z2"), (MODE, "z2", "won")]
    dist = [(MODE, "win", 0), (MODE, "a5", 1), *((MODE, f"a{k}", 2) for k in range(5)), (MODE, "won", 0), (MODE, "z2", 1), (MODE, "z1", 2), (MODE, "z0", 3)]
    starts = spark.createDataFrame([(MODE, s) for s in ("a0", "a4", "z0")], "label string, start string")
    return spark.createDataFrame(edges, "label string, src string, dst string"), starts, spark.createDataFrame(dist, "label string, node string, d int")


@pytest.mark.parametrize("budget", [1, 3, 20])
def test_budget_is_for_each_start(dense, budget):
    found = {r["start"]: (list(r["path"]), r["exhaustive"]) for r in g.longest_paths(*dense, 6, budget).collect()}
    assert found.keys() == {"a0", "a4", "z0"}
    assert found["z0"] == (["z0", "z1", "z2", "won"], True)
    for start in ("a0", "a4"):
        path, exhaustive = found[start]
        assert not exhaustive and path[0] == start and path[-2:] == ["a5", "win"] and len(set(path)) == len(path)


def test_no_start_is_cut_within_its_budget(dense):
    found = {r["start"]: (list(r["path"]), r["exhaustive"]) for r in g.longest_paths(*dense, 6, 200).collect()}
    assert found["a0"] == (["a0", "a1", "a2", "a3", "a4", "a5", "win"], True)
    assert found["a4"] == (["a4", "a0", "a1", "a2", "a3", "a5", "win"], True)
