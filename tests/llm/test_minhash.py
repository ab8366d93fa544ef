import re
from collections import Counter

import numpy as np

from weftgraph.llm import minhash


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def components(rows):
    sets = [(d, shingles(t)) for d, t, *_ in rows if d is not None]
    link = {d: d for d, _ in sets}

    def root(x):
        while link[x] != x:
            x = link[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                link[hi] = lo
    return {d: root(d) for d in link}


def test_against_brute_force(docs, doc_rows):
    expected = components(doc_rows)
    found = minhash.near_duplicates(docs).collect()
    assert len(found) == len(doc_rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == expected[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert Counter(r["n_shingles"] for r in found) == Counter(len(shingles(t)) for _, t, *_ in doc_rows)


def test_star_of_copies_that_are_not_alike(spark):
    base = [f"b{k}" for k in range(120)]
    rows = [(500, " ".join(base))]
    for k in range(40):
        body = list(base)
        body[3 * k] = "edit" + str(k)
        body[(3 * k + 60) % 120] = "other" + str(k)
        rows.append((k, " ".join(body)))
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == components(rows)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    sets = np.concatenate([np.sort(a), np.sort(b), a[:1]])
    rows = minhash.sketches(sets, np.array([0, 400, 800, 801]))
    assert (rows != minhash._all).all()
    assert abs((rows[0] == rows[1]).mean() - 300 / 500) < 0.15


def test_empty_table(no_docs):
    assert minhash.near_duplicates(no_docs).collect() == []


def test_chain_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 60)], "a long, b long")
    found = {r["v"]: r["c"] for r in minhash.components(edges).collect()}
    assert found == {**{k: 0 for k in range(31)}, 50: 50, 60: 50}


def test_copy_of_one_text_of_a_repeated_doc_id(spark):
    one, two = [f"a{k}" for k in range(80)], [f"z{k}" for k in range(80)]
    near = [*one[:40], "changed", *one[41:]]
    rows = [(5, " ".join(one)), (5, " ".join(two)), (7, " ".join(near)), (9, " ".join([*two[:70], "x"])), (11, "apart")]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(5, 5), (5, 5), (7, 5), (9, 5), (11, 11)]


def test_large_group_of_copies_against_brute_force(spark):
    """Edits at random places, some of them shared, copies of copies, and a passage that unlike documents hold."""
    rng = np.random.default_rng(4)
    base, rows = [f"b{k}" for k in range(150)], []
    for k in range(260):
        body = list(base if k % 5 else rows[int(rng.integers(0, len(rows)))][1].split() if rows else base)
        for at in rng.choice(150, int(rng.integers(0, 9)), replace=False):
            body[at] = f"e{int(rng.integers(0, 400))}" if rng.random() < 0.5 else f"own{k}at{at}"
        rows.append((int(rng.permutation(10_000)[0]) * 1000 + k, " ".join(body)))
    for k in range(60):
        own = int(rng.integers(5, 60))
        rows.append((k, " ".join([*(f"p{i}" for i in range(60)), *(f"d{k}w{i}" for i in range(own))])))
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == components(rows)
