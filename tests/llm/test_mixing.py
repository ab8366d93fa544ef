import numpy as np

import slow_mix
from weftgraph.llm import mixing


def test_rake_holds_all_marginals():
    rng = np.random.default_rng(3)
    a, b = np.repeat(np.arange(4), 3), np.tile(np.arange(3), 4)
    w = mixing.rake(rng.random(12) + 0.1, [a, b], [np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.25, 0.25])])
    assert np.allclose(np.bincount(a, w), [0.4, 0.3, 0.2, 0.1]) and np.allclose(np.bincount(b, w), [0.5, 0.25, 0.25])


def test_probabilities_meet_the_budget():
    tokens, weights = np.array([100.0, 1000.0, 10.0, 0.0]), np.array([0.2, 0.3, 0.5, 0.0])
    p = mixing.probabilities(tokens, weights, 500)
    assert np.isclose((p * tokens).sum(), 500) and p[2] == 1 and p.max() <= 1


def test_mix_and_sample_agree(docs, doc_rows):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(doc_rows)
    assert sorted(str(r["doc_id"]) for r in rows if r["sampled"]) == sorted(str(r["doc_id"]) for r in mixing.sample(docs).collect())
    assert mixing.sample(docs).columns == docs.columns


def test_expected_shares(spark):
    rows = [(k, "word " * 100, "a" if k % 10 else "b", "en") for k in range(4000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixing.mix(table, {"source": {"a": 0.5, "b": 0.5}}, share=0.15).filter("sampled").groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    assert abs(n["a"] - 300) < 60 and abs(n["b"] - 300) < 60


def test_empty_table(no_docs):
    assert mixing.mix(no_docs).collect() == [] and mixing.sample(no_docs).collect() == []


def test_query_against_brute_force(docs):
    rows = [r.asDict() for r in docs.collect()]
    chance = slow_mix.chances(rows)
    assert sum(slow_mix.draw(r["doc_id"]) < chance[slow_mix.place(r)[0]] for r in rows) > 10
    expected = sorted((str(r["doc_id"]), *slow_mix.place(r)[0], slow_mix.place(r)[1], round(chance[slow_mix.place(r)[0]], 9)) for r in rows)
    found = mixing.mix(docs).collect()
    assert sorted((str(r["doc_id"]), r["source"], r["lang"], r["topic"], r["n_tokens"], round(r["probability"], 9)) for r in found) == expected
    assert sorted(str(r["doc_id"]) for r in found if r["sampled"]) == sorted(str(r["doc_id"]) for r in slow_mix.sample(rows))


def test_many_cells_are_fitted_alike(docs, monkeypatch):
    key = lambda r: (str(r["doc_id"]), r["source"], r["lang"], r["topic"], round(r["cell_weight"], 9), round(r["probability"], 9), r["sampled"])
    for targets in (None, {"source": {"s0": 0.7, "s1": 0.3, "gone": 1.0}}):
        near = sorted(map(key, mixing.mix(docs, targets, 0.3).collect()))
        monkeypatch.setattr(mixing, "FIT_CELLS", 3)
        assert sorted(map(key, mixing.mix(docs, targets, 0.3).collect())) == near
        monkeypatch.undo()
