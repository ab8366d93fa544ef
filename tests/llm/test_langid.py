import itertools
import math

import numpy as np
import pytest

from weftgraph.llm import langid
from weftgraph.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def path():
    return tokenizer_path("piece_bpe_32k.model")


def test_sum_over_all_segmentations(path):
    v = langid.Vocabulary.at(path)
    rng = np.random.default_rng(0)
    p = rng.random((v.size, 2)) / 100
    for word in ("the", "nation", "日x", "a" * 45):
        marked = "▁" + word
        if len(marked) < 9:
            expected = np.zeros(2)
            for cuts in itertools.product((0, 1), repeat=len(marked) - 1):
                ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(marked)]
                parts = [marked[a:b] for a, b in zip([0, *ends], ends)]
                ids = [v.ids.get(x, -1) for x in parts]
                ids = [v.unknown if i < 0 and len(x) == 1 else i for i, x in zip(ids, parts)]
                if min(ids) >= 0:
                    expected += np.prod(p[ids], axis=0)
            assert np.allclose(langid.log_sums([word], v, p)[0], np.log(expected))
        else:
            assert np.isfinite(langid.log_sums([word], v, p)).all()


def test_expected_counts_cover_every_word(path):
    v = langid.Vocabulary.at(path)
    p = np.full((v.size, 1), 1 / v.size)
    counts = langid.expected_counts(["banana", "cat"], np.array([0, 0]), np.array([2, 3]), v, p)
    sizes = {i: len(x) for x, i in v.ids.items() if i >= 0}
    assert math.isclose(sum(n * sizes.get(i, 1) for i, n in enumerate(counts[:, 0]) if n), 2 * 7 + 3 * 4)


def test_held_out_accuracy(spark, path):
    en = "the cat sat on the mat and the dog ran with that thing for a while "
    de = "der hund und die katze sind nicht auf dem tisch weil das wetter schlecht ist "
    rows = [(k, (en if k % 2 else de).split(), "en" if k % 2 else "de") for k in range(80)]
    rows = [(k, " ".join(w[k % 5 :] + w[: k % 3]), x) for k, w, x in rows] + [(900, None, "en"), (901, "123 !!", "de"), (902, "", None), (903, "½ ² ①", "en"), (904, "Ⅷ ⅻ.", None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), path).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert all(by[k]["lang_pred"] == x for k, _, x in rows[:80])
    assert all((by[k]["lang_pred"], by[k]["score"]) == ("und", 0.0) for k in (900, 901, 902, 903, 904))


def test_odd_tables(docs, no_docs, doc_rows, path):
    assert langid.identify(no_docs, path).collect() == []
    got = langid.identify(docs, path).collect()
    assert len(got) == len(doc_rows) and all(0 <= r["score"] <= 1 for r in got)


def segmentations(word, v):
    marked = "▁" + word
    for cuts in itertools.product((0, 1), repeat=len(marked) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(marked)]
        parts = [marked[a:b] for a, b in zip([0, *ends], ends)]
        ids = [v.ids.get(x, -1) for x in parts]
        ids = [v.unknown if i < 0 and len(x) == 1 else i for i, x in zip(ids, parts)]
        if min(ids) >= 0:
            yield ids


def test_training_and_prediction_against_brute_force(spark, path):
    v = langid.Vocabulary.at(path)
    rows = [(k, t, x) for k, (t, x) in enumerate([("The cat, sat!", "en"), ("the the dog 12 日x", "en"), ("der hund der", "de"), ("das tier", "de"), ("dogs 5", None), (None, "de")] * 2)]
    rows = [(1000 + k, t, x) for k, t, x in rows]
    p = {x: np.full(v.size, 1 / v.size) for x in ("de", "en")}
    for _ in range(2):
        for lang in p:
            n = np.full(v.size, 0.05)
            for _, text, x in rows:
                for word in langid.words_of(text) if x == lang else []:
                    if any(c.isalpha() for c in word):
                        ways = [(ids, math.prod(p[lang][i] for i in ids)) for ids in segmentations(word, v)]
                        whole = sum(q for _, q in ways)
                        for ids, q in ways:
                            for i in ids:
                                n[i] += q / whole
            p[lang] = n / n.sum()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, path)
    assert model.langs == ["de", "en"]
    assert np.allclose(model.p, np.stack([p["de"], p["en"]], axis=1), rtol=1e-9)
    prior = {"de": 6 / 10, "en": 4 / 10}
    for r in langid.predict(docs, model).collect():
        text = next(t for d, t, _ in rows if d == r["doc_id"])
        words = [w for w in langid.words_of(text) if any(c.isalpha() for c in w)]
        ll = {x: math.log(prior[x]) + sum(math.log(sum(math.prod(p[x][i] for i in ids) for ids in segmentations(w, v))) for w in words) for x in p}
        top = max(ll, key=ll.get)
        expected = (top, 1 / sum(math.exp(y - ll[top]) for y in ll.values())) if words else ("und", 0.0)
        assert r["lang_pred"] == expected[0] and math.isclose(r["score"], expected[1], rel_tol=1e-9)


def test_words_of_any_length(path, monkeypatch):
    v, rng = langid.Vocabulary.at(path), np.random.default_rng(3)
    p = rng.random((v.size, 2)) / 1e9
    words = ["internationalisation" * k for k in (1, 3, 9)] + ["x" * 150, "日" * 40]
    sums = langid.log_sums(words, v, p)
    counts = langid.expected_counts(words, np.array([0, 1, 0, 1, 0]), np.arange(1, 6), v, p)
    monkeypatch.setattr(langid, "LONGEST_TABLE", 0)
    assert np.allclose(sums, langid.log_sums(words, v, p))
    assert np.allclose(counts, langid.expected_counts(words, np.array([0, 1, 0, 1, 0]), np.arange(1, 6), v, p))


def test_token_of_a_million_letters(path):
    v = langid.Vocabulary.at(path)
    assert np.isfinite(langid.log_sums(["a" * 1_000_000], v, np.full((v.size, 1), 1 / v.size))).all()


def test_memory_in_halves(path, monkeypatch):
    v, rng = langid.Vocabulary.at(path), np.random.default_rng(7)
    p = rng.random((v.size, 2)) / 100
    monkeypatch.setattr(langid, "CACHE", 30)
    memory = langid._Sums(3)
    for k in range(8):
        tokens = ["often", "--", "(often)"] + [f"word{chr(97 + k)}{chr(97 + i)}" for i in range(20)]
        rows = memory.of(tokens, v, p)
        assert np.allclose(rows[0, :2], langid.log_sums(["often"], v, p)[0]) and rows[1].tolist() == [0, 0, 0]
        assert (rows[2] == rows[0]).all() and np.allclose(rows[-1, :2], langid.log_sums([tokens[-1]], v, p)[0])
