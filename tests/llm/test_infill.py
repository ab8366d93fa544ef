import hashlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from weftgraph.llm import infill


def slow(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by plain slicing."""
    text, digest = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or h3 % 100 >= 90 or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def whole(cut):
    return cut.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()


def test_equals_plain_slicing_and_rebuilds(docs, doc_rows):
    rows = whole(infill.fill_in_middle(docs))
    found = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows), key=str)
    assert found == sorted(((k, *slow(k, text)) for k, text, *_ in doc_rows), key=str)
    assert sorted(r.back for r in rows) == sorted(text or "" for _, text, *_ in doc_rows)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_sentinels_inside_and_at_the_cuts(spark):
    texts = ["a <P> b", "<S>", "x<M>", "<<<P<S<M", "S>P>M>", "<" * 50, "P>" * 40, "\x00< S\r\n", "é\U0001f600‍" * 9]
    rows = [(k, texts[k % len(texts)]) for k in range(400)]
    out = whole(infill.fill_in_middle(spark.createDataFrame(rows, "doc_id int, text string")))
    assert sorted((r.doc_id, r.back) for r in out) == sorted(rows)
    assert all(r.form == "plain" for r in out if r.doc_id % len(texts) < 3)
    assert [(r.doc_id, r.output) for r in sorted(out)] == [(k, slow(k, text)[-1]) for k, text in rows]


def test_windows_and_long_words(spark, monkeypatch):
    monkeypatch.setattr(infill, "WINDOW", 7)
    for text in ("abc  def g", " ", "   ", "0123456 89 123 4567 " * 3, "w" * 200, "é" * 20 + " x" * 20):
        units = infill.Units()
        assert units.count(text) == len(text)
        assert [units.offset(k) for k in range(len(text) + 1)] == list(range(len(text) + 1))


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=60), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_any_text(text, h1, h2):
    n, form, prefix, middle, output = infill.arrange(text, infill.Units(), h1, h2, 0, 50)
    assert n == len(text)
    if form == "psm":
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        assert (prefix, middle, output) == (a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}")


def test_other_units():
    units = infill.Units(r"\S+\s*|\s+")
    assert units.count("one two  three") == 3
    assert [units.offset(k) for k in range(4)] == [0, 4, 9, 14]


def test_empty_table_and_map_columns(spark, no_docs):
    assert infill.fill_in_middle(no_docs).collect() == []
    odd = spark.createDataFrame([("k", "text here", {"a": 1})], "doc_id string, text string, output map<string,int>")
    assert infill.fill_in_middle(odd).collect()[0].n == 9


@pytest.mark.parametrize("doc_id", [None, -3])
def test_null_and_negative_ids(spark, doc_id):
    frame = spark.createDataFrame([(doc_id, "some words to cut")], "doc_id long, text string")
    assert tuple(infill.fill_in_middle(frame).first())[1:] == slow(doc_id, "some words to cut")
