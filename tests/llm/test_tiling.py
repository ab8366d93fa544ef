import re
import string
import time

import numpy as np

from weftgraph.llm import tiling


def words(prefix, n):
    return [f"{prefix}{k}" for k in range(n)]


def slow_tiles(doc, item, size):
    """Greedy string tiling by looking at every pair of places."""
    free_d, free_i, found = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and free_i[i + n] and free_d[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < size:
            return found
        free_i[i : i + n] = [False] * n
        free_d[d : d + n] = [False] * n
        found.append((i, d, n))


def test_tiles_against_brute_force():
    rng = np.random.default_rng(5)
    for k in range(120):
        letters = 2 + k % 3
        item = rng.integers(0, letters, 18).astype(np.uint64)
        doc = rng.integers(0, letters, 40).astype(np.uint64)
        same = lambda i, d, n: bool((item[i : i + n] == doc[d : d + n]).all())  # noqa: B023, E731
        assert tiling.tiles(doc, item, 3 + k % 3, same) == slow_tiles(doc.tolist(), item.tolist(), 3 + k % 3)


def test_unequal_words_of_equal_hashes_are_no_match():
    numbers = np.arange(20).astype(np.uint64)
    assert tiling.tiles(numbers, numbers, 5, lambda i, d, n: False) == []


def slow_leaks(texts, items, cover):
    found = []
    for t, text in enumerate(texts):
        for k, item in enumerate(items):
            doc, words_ = (re.sub(f"[{re.escape(string.punctuation)}]", " ", (x or "").lower()).split() for x in (text, item))
            if words_:
                marked = slow_tiles(doc, words_, min(5, len(words_)))
                if sum(n for *_, n in marked) >= cover * len(words_):
                    found.append((t, k, len(words_), sum(n for *_, n in marked), len(marked)))
    return found


def test_leaks_against_brute_force():
    rng = np.random.default_rng(8)
    draw = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 4, n))
    items = [*(draw(int(rng.integers(1, 25))) for _ in range(12)), None, "", "W1, w2!", draw(8)]
    items.append(items[0])
    texts = [*(draw(int(rng.integers(0, 60))) for _ in range(25)), None, "", items[3], "w1 w2"]
    found = tiling.leaks_in(texts, tiling.Items(list(enumerate(items))), 0.6)
    assert sorted(found) == sorted(slow_leaks(texts, items, 0.6)) and len(found) > 20


def test_long_repetitive_texts_take_seconds():
    items = tiling.Items([(1, "again " * 50_000), (2, " ".join(["one two"] * 20_000)), (3, " ".join(f"w{k % 97}" for k in range(30_000)))])
    texts = ["again " * 100_000, " ".join(["one two three"] * 5_000 + ["one two"] * 40_000), " ".join(f"w{k % 97}" for k in range(100_000))]
    began = time.time()
    found = tiling.leaks_in(texts, items, 0.6)
    assert [(t, k, covered) for t, k, _, covered, _ in found] == [(0, 0, 50_000), (1, 1, 40_000), (2, 2, 30_000)]
    assert time.time() - began < 60


def test_reordered_passage_is_caught(spark):
    item = words("q", 30)
    docs = [
        (1, " ".join(words("a", 50) + item[15:] + words("b", 9) + item[:15] + words("c", 5))),
        (2, " ".join(words("a", 50) + item[:8])),
        (3, " ".join(w.upper() + "," for w in item)),
        (4, None),
        (5, ""),
        (6, "short item"),
    ]
    benchmark = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, "short item"), (13, "")], "item_id long, text string")
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string").repartition(3)
    got = {(r["doc_id"], r["item_id"]): (r["covered_words"], r["n_tiles"]) for r in tiling.leaks(table, benchmark).collect()}
    assert got == {(1, 10): (30, 2), (3, 10): (30, 1), (6, 12): (2, 1)}
    assert sorted(r["doc_id"] for r in tiling.without_leaks(table, benchmark).collect()) == [2, 4, 5]


def test_blocks_give_the_same(spark, docs, monkeypatch):
    items = spark.createDataFrame([(k, " ".join(words(f"w{k}", 20))) for k in range(5)], "item_id long, text string")
    more = spark.createDataFrame([(900 + k, " ".join(words(f"w{k}", 20))) for k in range(3)], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(more)
    whole = sorted(map(tuple, tiling.leaks(table, items).collect()))
    monkeypatch.setattr(tiling, "BLOCK_WORDS", 30)
    assert sorted(map(tuple, tiling.leaks(table, items).collect())) == whole and len(whole) == 3


def test_empty_tables(docs, no_docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert tiling.leaks(docs, none).collect() == []
    assert tiling.leaks(no_docs, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).collect() == []
    assert tiling.without_leaks(docs, none).count() == docs.count()
