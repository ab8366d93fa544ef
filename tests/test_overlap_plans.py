import json

from weftgraph.operators import graph as g
from weftgraph.plans import graph_queries as q


def test_all_starts_are_compared(spark, tmp_path):
    users, rows = [5, 12, 130, 131], []
    for user in users:
        for k, (kind, value) in enumerate([("click", 1.0), ("purchase", 200.0)]):
            rows.append((len(rows), user, k, kind, value, json.dumps({"k": k})))
    events = spark.createDataFrame(rows, "event_id long, user_id long, t long, event_type string, value double, props string")
    events.selectExpr("event_id", "user_id", "timestamp_seconds(t) AS ts", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    found = q.path_overlap_jaccard(spark, str(tmp_path)).collect()
    names = [f"{u}:0" for u in users]
    assert {(r["a"], r["b"]) for r in found} == {(a, b) for a in names for b in names if a < b}
    assert len(found) == 6 and all(r["n_common"] == 0 and r["jaccard"] == 0.0 for r in found)


def test_convergence_of_shared_nodes(spark):
    paths = [("m", f"s{k}", [f"s{k}", f"n{k % 5}", f"n{k % 3}x", "w"] if k % 4 else [f"s{k}", f"only{k}"]) for k in range(50)]
    found = g.convergence(spark.createDataFrame(paths, "label string, start string, path array<string>")).collect()
    expected = {}
    for _, a, x in paths:
        for _, b, y in paths:
            if a < b:
                expected[a, b] = (sorted(set(x) & set(y)), round(len(set(x) & set(y)) / len(set(x) | set(y)), 3))
    assert len(found) == len(expected) and {(r["a"], r["b"]): (r["common"], r["jaccard"]) for r in found} == expected


def test_pairs_are_dealt_to_tasks_and_made_once(spark, monkeypatch):
    monkeypatch.setattr(g, "PAIR_STARTS", 2)
    names = [f"s{k}" for k in range(60)]
    paths = [("m", s, [s, f"x{k % 7}", "w"] if k % 3 else [s, f"only{k}"]) for k, s in enumerate(names)] + [("other", "s1", ["s1", "x1"])]
    pairs = g.convergence(spark.createDataFrame(paths, "label string, start string, path array<string>"))
    assert pairs.rdd.glom().map(len).filter(lambda n: n > 0).count() > 1  # small as they are, one task doesn't make them all
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    of = {a: set(p) for label, a, p in paths if label == "m"}
    expected = {(a, b): (sorted(of[a] & of[b]), round(len(of[a] & of[b]) / len(of[a] | of[b]), 3)) for a in names for b in names if a < b}
    found = pairs.collect()
    assert len(found) == len(expected) and {(r["a"], r["b"]): (r["common"], r["jaccard"]) for r in found} == expected
