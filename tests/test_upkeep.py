from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftgraph.functions import predicates as p
from weftgraph.operators import upkeep


def test_replies():
    assert upkeep.parse_reply('Sure: {"entities": [{"name": "a"}, 3, {"name": "b"}]} done') == [{"name": "a"}, {"name": "b"}]
    assert upkeep.parse_reply("{no json}") == upkeep.parse_reply(None) == upkeep.parse_reply('{"entities": 5}') == upkeep.parse_reply("[]") == []


def test_proposals(spark):
    rows = [("u1", "Topic", "Road  Freight", ["Road", "road "]), ("u2", "Topic", "road freight", ["lorry"]), ("u2", "Topic", " ", ["x"]), ("u3", "Place", "Road Freight", [])]
    merged = upkeep.merge_proposals(spark.createDataFrame(rows, "url string, entity_type string, name string, terms array<string>"))
    assert [tuple(r) for r in merged.collect()] == [("Topic", "Road  Freight", ["lorry", "road"], ["u1", "u2"], 2), ("Place", "Road Freight", [], ["u3"], 1)]
    taken = spark.createDataFrame([("Place", "ROAD freight")], "entity_type string, name string")
    verdicts = {r["entity_type"]: r["verdict"] for r in upkeep.accept_proposals(merged, 2, taken).collect()}
    assert verdicts == {"Topic": "accepted", "Place": "known"}


def test_win_checks_limit_and_medians(spark):
    links = spark.createDataFrame([("a", "w1"), ("a", "w1"), ("b", "w1"), ("a", "x"), ("c", "w2")], "src string, url string")
    aliases = spark.createDataFrame([("x", "w2")], "url string, final_url string")
    found = upkeep.win_checks(links, aliases, p.Win(url_patterns=("w*",)).destination(F.col("url")), 1).collect()
    assert [tuple(r) for r in found] == [("w1", 2)]
    rows = spark.createDataFrame([("a", 1), ("a", 3), ("b", 1), ("b", 2)], "k string, n int")
    assert {r["k"]: r["m"] for r in rows.groupBy("k").agg(upkeep.plain_median("n").alias("m")).collect()} == {"a": "2", "b": "1.5"}


def test_every_query_has_its_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {q for q in entry.queries() if not q.startswith("op") and q != "pipeline"} - {"operator_dependency"} <= set(entry.oracle_sql())
