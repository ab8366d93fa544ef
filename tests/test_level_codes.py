import random

from test_level_plans import slow

from weftgraph.operators import graph as g


def test_large_searches_run_over_codes(spark, monkeypatch):
    rng = random.Random(1)
    edges = [(rng.choice("xy"), f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(110)]
    edges += [("y", f"m{k}", f"m{k + 1}") for k in range(11)] + [("y", "n2", "m0")]
    starts = [("x", "n1"), ("y", "n2"), ("x", "lone")]
    seen, real = [], g.durable
    monkeypatch.setattr(g, "durable", lambda df, name: seen.append((name, df.schema)) or real(df, name))
    monkeypatch.setattr(g, "TASK_EDGES", 20)
    frame = spark.createDataFrame(edges, "label string, src string, dst string")
    for depth in (None, 6):
        found = g.levels(frame, spark.createDataFrame(starts, "label string, node string"), depth)
        assert {(r["label"], r["node"]): r["d"] for r in found.collect()} == {k: d for k, d in slow(edges, starts).items() if depth is None or d <= depth}
    kinds = {schema["node"].dataType.simpleString() for name, schema in seen if name == "bfs-level"}
    assert kinds == {"bigint"}
