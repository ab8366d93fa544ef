import math
import random
import time
import zlib

import numpy as np
import pytest

from weftgraph.llm import toxicity


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    clean = ["table", "window", "garden", "river", "letter", "music", "orange", "silver", "market", "doctor", "yellow", "summer"]
    rows, labels = [], []
    for k in range(600):
        body = [rng.choice(clean) for _ in range(30)]
        bad = k % 5 == 0
        if bad:
            body[3] = rng.choice(["vilestuff", "nastyword"])
        rows.append((k, " ".join(body)))
        labels.append((k, int(bad)))
    rows += [(1000, "river v1le5tuff music"), (1001, "garden n a s t y w o r d table"), (1002, "silver viiiiilestuff"), (1003, "summer n.a.s.t.y.w.o.r.d"), (1004, None), (1005, ""), (1006, "river 123 l8r")]
    return (
        spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, toxic int, features string").repartition(4),
        spark.createDataFrame([*labels, (5, None), (7777, 1)], "doc_id long, toxic int"),
    )


def test_held_out_and_disguised(table):
    docs, labels = table
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    for k in range(600):
        assert got[k]["predicted"] == int(k % 5 == 0), k
    assert [got[k]["predicted"] for k in range(1000, 1007)] == [1, 1, 1, 1, 0, 0, 0]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert 0.2 < np.mean([r["held_out"] for r in got.values()]) < 0.45


def test_restoring_takes_the_likeliest_path():
    logs = np.full((64, 64, 64), -6.0, np.float32)
    for word in ("idiot", "loser"):
        a = b = 0
        for c in [toxicity._class[x] for x in word] + [0]:
            logs[a, b, c] = -0.1
            a, b = b, c
    assert [toxicity.restore(w, logs) for w in ("1d10t", "l0$er", "looooser", "i.d.i.o.t", "i d i o t")] == ["idiot", "loser", "loser", "idiot", "idiot"]


def test_cover_weighs_near_copies_as_one():
    rows = [(1, {10, 11})] * 50 + [(k, {20}) for k in range(100, 110)]
    counts = {10: (50, 0), 11: (50, 0), 20: (10, 0)}
    assert set(toxicity.cover(rows, counts)) == {20}


def test_odd_tables(docs, no_docs, doc_rows, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, none).collect()
    assert len(got) == len(doc_rows) and {round(r["score"], 6) for r in got} == {toxicity.BASE}
    assert toxicity.toxicity(no_docs, none).collect() == []


def every_path(token, logs):
    """(score, text) of every path through a token's lattice, by recursion."""
    if not token:
        yield 0.0, ""
        return
    run = len(token) - len(token.lstrip(token[0]))
    for emitted, end, cost in toxicity._arcs(token[0], 0, run):
        for score, text in every_path(token[end:], logs):
            yield score + cost, emitted + text


def test_restoring_against_all_paths():
    rng = np.random.default_rng(6)
    logs = np.log(rng.random((64, 64, 64)) + 0.01)
    number = lambda c: toxicity._class.get(c, 0 if c == " " else 63)
    for token in ("h3ll0", "aaab", "x.y.z", "b4$$", "a b c", "sss1", "!!|k", "héé€", "日1本", "a-1-b"):
        scored = []
        for cost, text in every_path(token, logs):
            seen = [0, 0, *map(number, text), 0]
            scored.append((cost + sum(float(logs[x, y, z]) for x, y, z in zip(seen, seen[1:], seen[2:])), text))
        best = max(s for s, _ in scored)
        assert toxicity.restore(token, logs) in {t.strip() for s, t in scored if s > best - 1e-9}, token


def test_tokens_of_a_million_characters(spark):
    logs = np.zeros((64, 64, 64), np.float32)
    reader = toxicity.Reader(logs, None)
    began = time.time()
    for text in ("a" * 1_000_000, "a1" * 100_000, "-" * 1_000_000 + "x", "a" * 400_000 + "1", "a " * 200_000):
        assert reader.features(text)
    assert time.time() - began < 60


def test_cover_against_slow_greedy():
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(0, 30)), {int(f) for f in rng.integers(0, 25, 6)}) for _ in range(60)]
    counts = {f: (sum(f in x for _, x in rows), int(rng.integers(0, 2))) for f in range(25)}
    size = {g: sum(h == g for h, _ in rows) for g, _ in rows}
    lexicon, done = {}, [0] * len(rows)
    while len(lexicon) < 25:
        gain = {f: sum(1 / size[g] for (g, x), k in zip(rows, done) if f in x and k < 3) - 3 * counts[f][1] for f in range(25) if f not in lexicon}
        best = max(gain, key=lambda f: (round(gain[f], 6), f & 1, f))
        if gain[best] < max(1.5, 0.002 * len(size)):
            break
        lexicon[best] = min(0.99, counts[best][0] / (sum(counts[best]) + 1))
        done = [k + (best in x) for (_, x), k in zip(rows, done)]
    assert lexicon and toxicity.cover(rows, counts) == lexicon


def test_scores_against_brute_force(spark, docs, doc_rows):
    """The whole query: features by the definition, precision from the training labels, noisy or of the lexicon."""
    rows = [(2000 + k, f"plain words number{k} and " + ("you awfulone go away" if k % 3 == 0 else "a kind line"), k % 3 == 0) for k in range(60)]
    rows += [(3000, "an aw4fulone", None), (3001, "a.w.f.u.l.o.n.e", None), (3002, None, None), (3003, "", None)]
    table = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(x)) for d, _, x in rows if x is not None], "doc_id long, toxic int")
    logs = toxicity.trigram_logs(table)
    got = {r["doc_id"]: r for r in toxicity.toxicity(table, labels).collect()}
    assert len(got) == len(rows)
    train = {d for d, _, x in rows if x is not None and zlib.crc32(str(d).encode()) % 3 != 1}
    toxic = {d for d, _, x in rows if x} & train
    features = {d: toxicity.Reader(logs, None).features(t) for d, t, _ in rows}
    lexicon = toxicity.learn(table, labels.filter(labels["doc_id"].isin(*train)), logs)
    for f, precision in lexicon.items():
        a, n = len([d for d in toxic if f in features[d]]), len([d for d in train if f in features[d]])
        assert a >= 2 and a >= 0.8 * n and math.isclose(precision, min(0.99, a / (n + 1)))
    for d, _, x in rows:
        clean = 0.98
        for f in features[d] & lexicon.keys():
            clean *= 1 - lexicon[f]
        assert math.isclose(got[d]["score"], 1 - clean, rel_tol=1e-9)
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and got[d]["predicted"] == (1 - clean >= 0.7)
        if x is not None:
            assert got[d]["predicted"] == x
