import re

from weftgraph.plans import page_queries as q

TEXTS = [
    "x " * 30 + "und more\nlast",  # after 40 characters of the first line
    "head\nmiddle with the word\nlast",  # neither in the first line nor in the last
    "head\n" + "w " * 5000 + "Tionary " + "w " * 5000 + "\nlast",
    "one line and no more",
    "head\nband under theta",
    "",
    None,
]


def test_topics_are_searched_in_whole_texts(spark, tmp_path):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    words = {"Joining": r"\b(and|und)\b", "Pointing": r"\b(the|der|la)\b", "Ending": r"\btion"}
    expected = {(str(k), topic) for k, t in enumerate(TEXTS) for topic, rx in words.items() if re.search(rx, t or "", re.I)}
    found = q.topic_tags(spark, str(tmp_path)).collect()
    assert {(r["url"], r["topic"]) for r in found} == expected == {("0", "Joining"), ("1", "Pointing"), ("2", "Ending"), ("3", "Joining")}
    assert {r["url"]: r["field"] for r in found} == {"0": "title", "1": "nav_label", "2": "nav_label", "3": "title"}
    pages = {r["topic"]: r["pages"] for r in q.topic_matrix(spark, str(tmp_path)).collect()}
    assert pages == {"Joining": 2, "Pointing": 1, "Ending": 1, "Nothing": 0}
