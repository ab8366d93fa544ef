import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from weftgraph.llm import tokenbin
from weftgraph.llm.queries import tokenizer_path

ENDS = ["", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "​", "'s", ",", "1", "́", "中"]
HEADS = ["", "\n", "\x85", "\xa0", "　", "'", "(", "İ", "×", "я", "\U0001f600"]


@pytest.fixture(scope="module")
def path():
    return tokenizer_path("byte_bpe_50k.json")


def ids_of(coder, texts):
    return [np.frombuffer(ids, "<u4").tolist() for ids in coder.encode(texts)]


def test_new_words_are_encoded_together(path):
    coder, sent, send = tokenbin.Encoder(path), [], tokenbin.Encoder._ids
    coder._ids = lambda texts, *more: sent.extend(texts) or send(coder, texts, *more)
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefgh", k=9)) + end for end in ("", ",") for _ in range(5_000))
    assert ids_of(coder, [text]) == [Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids]
    assert len(sent) <= 2 + 10_000 // tokenbin.JOINED  # it was one for each word


def test_neighbours_do_not_change_a_words_ids(path):
    plain, coder, rng = Tokenizer.from_file(path), tokenbin.Encoder(path), random.Random(4)
    odd = [f"{h}{m}{e}" for h in HEADS for m in ("", "don", "Straße", "дом", "x9") for e in ENDS]
    texts = [" ".join(rng.choices(odd, k=rng.randrange(1, 30))) for _ in range(800)]
    texts += [f"{w}{s}" for w in odd for s in ("", " ", "\n", " a")] + [f"a {w}" for w in odd]
    assert ids_of(coder, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids_of(coder, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]  # as remembered


def test_words_move_from_the_old_half(path, monkeypatch):
    monkeypatch.setattr(tokenbin, "CACHE", 30)
    plain, coder, rng = Tokenizer.from_file(path), tokenbin.Encoder(path), random.Random(5)
    for _ in range(60):
        texts = [" ".join(rng.choices(["one", "two,", "да", "a\n", "b\t1"] + [f"w{k}" for k in range(60)], k=12)) for _ in range(3)]
        assert ids_of(coder, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_marks_after_letters_are_another_piece(path):
    coder, plain, rng = tokenbin.Encoder(path), Tokenizer.from_file(path), random.Random(5)
    words = ["".join(rng.choices("abcdéя", k=7)) for _ in range(300)]
    texts = [" ".join(f"{w}{rng.choice(['', '.', ',', '?!', chr(39), '...', '_)'])}" for w in rng.choices(words, k=90)) for _ in range(40)]
    assert ids_of(coder, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert coder.marks_apart and len(coder.young) <= len(words)  # each was learnt with every mark
