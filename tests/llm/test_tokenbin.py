import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from weftgraph.llm import tokenbin
from weftgraph.llm.queries import tokenizer_path

ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a\n b", "a\n\n  b", "a\t \nb", "\n ", "x \n", " \n x", "don't we'll", "1 2  3", "é ü", "　a b", "日本 語", "\U0001f600 \U0001f600", "x <|endoftext|> y", "<|endoftext|>"]


@pytest.fixture(scope="module")
def path():
    return tokenizer_path("byte_bpe_50k.json")


def test_encoder_equals_tokenizer(path, doc_rows):
    plain, coder = Tokenizer.from_file(path), tokenbin.Encoder(path)
    texts = ODD + [t for _, t, *_ in doc_rows] + [a + b for a in ODD for b in ODD]
    for text, ids in zip(texts, coder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_shard_round_trip_and_random_access():
    rng = np.random.default_rng(2)
    docs = [np.r_[rng.choice(40, n) * 7 % 300, 2].astype("<u4") for n in (0, 1, 500, 20_000, 3)] + [np.r_[[9] * 999, 2].astype("<u4")]
    shard = tokenbin.Shard(tokenbin.pack([5, None, 7, 8, 9, 10], [d.tobytes() for d in docs], 1000))
    assert [d for d, _ in shard.all_documents()] == [5, None, 7, 8, 9, 10]
    assert all(ids == d.tobytes() for (_, ids), d in zip(shard.all_documents(), docs))
    assert all((shard.document(k) == d).all() for k, d in enumerate(docs))
    assert len(shard.rules) and len(shard.symbols) < sum(map(len, docs))
    assert shard.first[6] - shard.first[5] < 20  # 999 equal ids
    assert (shard.sizes == tokenbin.lengths_of(shard.rules, 1000)).all()


def test_table_against_brute_force(spark, docs, doc_rows, path, monkeypatch):
    plain, start, expected = Tokenizer.from_file(path), 0, []
    for d, t, *_ in sorted(doc_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in tokenbin.tokenize(docs, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected


def test_empty_table(no_docs, path):
    assert tokenbin.tokenize(no_docs, path).collect() == []


def test_words_met_again_outlive_words_met_once(path, monkeypatch):
    monkeypatch.setattr(tokenbin, "CACHE", 50)
    plain, coder = Tokenizer.from_file(path), tokenbin.Encoder(path)
    for k in range(12):
        text = "always the same " + " ".join(f"once{k}x{i}" for i in range(40))
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
        assert "same" in coder.young and len(coder.young) <= 100
