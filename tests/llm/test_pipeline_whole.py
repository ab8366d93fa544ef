"""run() against a plain version of every stage that shares no code with the operators but the trained language model."""

import math
import zlib

import numpy as np
import slow_mix
from test_minhash import components
from test_tiling import slow_tiles
from tokenizers import Tokenizer

import corpus_pipeline
from weftgraph.llm import langid
from weftgraph.llm.queries import tokenizer_path

KINDS = "doc_id long, text string, lang string, source string, n_chars long, component long, row string"


def letters(word):
    return any(c.isalpha() for c in word)


def plain_words(text):
    return "".join(c.lower() if c.isascii() and (c.isalnum() or c.isspace()) else " " if c.isascii() else c for c in text or "").split()


def slow_run(rows, items, model):
    v = langid.Vocabulary.at(model.path)
    logs, known = np.log(model.p).T.tolist(), {}

    def sums(word):
        if word not in known:
            known[word] = [langid._forward("▁" + word, v, column)[-1] for column in logs]
        return known[word]

    kept = []
    for row in rows:
        words = [w for w in langid.words_of(row["text"]) if letters(w)]
        ll = [q + sum(sums(w)[k] for w in words) for k, q in enumerate(model.prior.tolist())]
        if words and 1 / sum(math.exp(x - max(ll)) for x in ll) >= corpus_pipeline.LEAST_SCORE:
            kept.append(row)
    component = components([(r["doc_id"], r["text"]) for r in kept])
    kept = [r for r in kept if component[r["doc_id"]] == r["doc_id"]]
    item_words = [w for w in map(plain_words, items) if w]
    leak = lambda doc: any(sum(n for *_, n in slow_tiles(doc, w, min(5, len(w)))) >= 0.6 * len(w) for w in item_words if set(doc) & set(w))
    kept = slow_mix.sample([r for r in kept if not leak(plain_words(r["text"]))])
    out, start, tokenizer = [], 0, Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for row in sorted(kept, key=lambda r: r["doc_id"]):
        ids = np.array([*tokenizer.encode(row["text"], add_special_tokens=False).ids, 2], "<u4")
        out.append((row["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_run_against_brute_force(spark, tmp_path, doc_rows):
    en = "the cat sat on the mat and the dog ran with that thing for a while"
    fr = "le chat est sur la table avec le chien dans la maison pour un moment"
    rows = [(d, f"{t} {fr if k % 3 else en} doc{d}" if t and len(t) > 20 else t, x, s, 1, 7, "r") for k, (d, t, x, s) in enumerate(doc_rows) if d is not None and d not in (304, 5, 12)]
    rows += [(700, "Quiz: " + " ".join(f"q{k}," for k in range(9, 20)) + " " + " ".join(f"q{k}" for k in range(9)), "en", "s3", 1, 7, "r")]
    rows += [(800 + k, f"<|endoftext|> note {k} {en} {k * k}", "en", None, 1, 7, "r") for k in range(9)]
    spark.createDataFrame(rows, KINDS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    items = [" ".join(f"q{k}" for k in range(20)), None, ""]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = langid.train(docs.filter(langid.fold() != langid.HELD_OUT), tokenizer_path("piece_bpe_32k.model"))
    expected = slow_run([r.asDict() for r in docs.collect()], items, model)
    assert len(expected) > 15 and 700 not in {r[0] for r in expected}
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == expected


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], KINDS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
