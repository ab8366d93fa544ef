import itertools
import random

from weftgraph.operators import graph as g


def test_loops_and_paths_of_random_graphs(spark):
    rng, rows = random.Random(11), []
    names = {label: [f"{label}{k:02d}" for k in range(14)] for label in "ab"}
    for label, nodes in names.items():
        rows += {(label, *rng.sample(nodes, 2)) for _ in range(22)}
    edges = spark.createDataFrame(rows, "label string, src string, dst string")
    out = {}
    for label, a, b in rows:
        out.setdefault((label, a), set()).add(b)

    def reach(label, start):
        seen, todo = set(), [start]
        while todo:
            for b in out.get((label, todo.pop()), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    loops = set()
    for label, nodes in names.items():
        to = {n: reach(label, n) for n in nodes}
        for n in nodes:
            mates = {m for m in nodes if m != n and m in to[n] and n in to[m]}
            if mates:
                loops.add((label, min(mates | {n}), n))
    every = spark.createDataFrame([(label, n) for label in "ab" for n in names[label]], "label string, node string")
    assert {tuple(r) for r in g.trap_loops(edges, every).collect()} == loops and loops

    stops = {"a": {"a03", "a11"}, "b": {"b00"}}
    expected = {}
    for label, start in itertools.chain.from_iterable(((x, n) for n in names[x]) for x in "ab"):
        paths = [[start]]
        while paths and not any(p[-1] in stops[label] for p in paths):
            paths = [[*p, b] for p in paths for b in out.get((label, p[-1]), ()) if b not in p]
        if done := [p for p in paths if p[-1] in stops[label]]:
            expected[label, start] = min(done)
    ends = spark.createDataFrame([(x, n) for x in "ab" for n in stops[x]], "label string, node string")
    found = g.shortest_paths(edges, every.withColumnRenamed("node", "start"), ends).collect()
    assert {(r["label"], r["start"]): r["path"] for r in found} == expected
