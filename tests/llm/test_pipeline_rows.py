from collections import Counter

import corpus_pipeline


def test_rows_are_judged_not_ids(spark):
    text = lambda seed: " ".join(f"{seed}{k}" for k in range(60))
    rows = [
        (1, text("a"), "en"), (1, text("a"), "fr"), (1, text("a"), "en"),  # one row three times
        (2, text("a") + " more", "en"),  # a near copy of it
        (3, text("a"), "en"), (3, text("b"), "en"),  # a copy and a text of its own under one id
        (4, text("c"), "en"), (4, text("c") + " more", "en"),  # near copies under one id
        (5, "", "en"), (5, "", "en"), (6, None, "en"), (None, text("a"), "en"), (None, text("a"), "en"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    found = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert Counter(d for d, *_ in found) == {1: 1, 3: 1, 4: 1, 5: 2, 6: 1, None: 2}
    assert (1, text("a"), "en") in found and (3, text("b"), "en") in found


def test_without_repeated_ids(spark):
    text = lambda seed: " ".join(f"{seed}{k}" for k in range(60))
    docs = spark.createDataFrame([(2, text("a")), (1, text("a") + " more"), (3, text("b"))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]


def test_columns_that_have_no_order(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, {"a": k}, [None]) for k in (2, 1, 2)] + [(1, text + " more", {"b": None}, None), (2, "x", None, None), (None, None, {}, [])]
    docs = spark.createDataFrame(rows, "doc_id int, text string, __more map<string,int>, row array<string>").withColumnsRenamed({"__more": "digest"})
    found = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert Counter(r["doc_id"] for r in found) == {1: 1, 2: 1, None: 1}
    again = corpus_pipeline.near_dedup(spark, docs.repartition(7), "").collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_large_ids(spark):
    text = lambda seed: " ".join(f"{seed}{k}" for k in range(60))
    top = 2**62
    rows = [(top, text("a")), (top, text("b")), (top - 1, text("b")), (-5, text("a")), (-5, text("c"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert found == sorted([(-5, text("a")), (-5, text("c")), (top - 1, text("b"))])
