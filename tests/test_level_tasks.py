import pytest

from weftgraph.operators import graph as g


@pytest.fixture
def plans(spark, monkeypatch):
    seen, real = [], g.durable

    def watched(df, name):
        if name == "bfs-level":
            seen.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(g, "durable", watched)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    yield seen
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_few_edges_are_dealt_to_few_tasks(spark, plans):
    edges = spark.createDataFrame([("x", f"n{k}", f"n{k + 1}") for k in range(5)], "label string, src string, dst string")
    starts = spark.createDataFrame([("x", "n0")], "label string, node string")
    assert {r["node"]: r["d"] for r in g.levels(edges, starts).collect()} == {f"n{k}": k for k in range(6)}
    assert len(plans) == 7 and all(", 64)" not in plan for plan in plans)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
