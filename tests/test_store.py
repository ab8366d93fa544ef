import json
import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from weftgraph.operators.numbering import numbered
from weftgraph.sources.store import Conflict, Store, changed_rows


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def aliases(spark, *pairs):
    return spark.createDataFrame(list(pairs), "url string, final_url string")


def content(snapshot, name="aliases"):
    return sorted(map(tuple, snapshot.table(name).collect()))


def test_versions_are_whole_and_pinned(spark, store):
    assert store.versions() == [] and content(store.snapshot()) == []
    change = store.change()
    change.append("aliases", aliases(spark, ("a", "b"), ("c", "d")))
    change.append("meta", spark.createDataFrame([("k", "1")], "key string, value string"))
    assert content(store.snapshot()) == []
    assert change.publish("first") == 1
    pinned = store.snapshot()
    change = store.change()
    change.upsert("aliases", aliases(spark, ("a", "z"), ("e", "f")), ["url"])
    change.delete("aliases", aliases(spark, ("c", "")), ["url"])
    assert content(change) == [("a", "z"), ("e", "f")]
    change.publish()
    assert content(pinned) == [("a", "b"), ("c", "d")] == content(store.snapshot(1))
    assert content(store.snapshot()) == [("a", "z"), ("e", "f")] and content(store.snapshot(), "meta") == [("k", "1")]
    with pytest.raises(ValueError):
        store.snapshot(7)


def test_second_change_of_one_version_is_refused(spark, store):
    first, second = store.change(), store.change()
    first.append("aliases", aliases(spark, ("a", "1")))
    second.append("aliases", aliases(spark, ("a", "2")))
    first.publish()
    with pytest.raises(Conflict):
        second.publish()
    assert content(store.snapshot()) == [("a", "1")] and store.versions() == [1]
    assert not [n for n in store.folder.names("versions") if "staged" in n]


def test_only_touched_files_are_rewritten(spark, store):
    for k in range(4):
        change = store.change()
        change.append("aliases", aliases(spark, *((f"{k}-{i}", "x") for i in range(5))).coalesce(1))
        change.publish()
    before = store.snapshot()
    assert len(before.files("aliases")) == 4
    change = store.change()
    change.merge("aliases", before.table("aliases").withColumn("final_url", F.when(F.col("url") == "2-3", "new").otherwise(F.col("final_url"))), ["url"])
    kept = set(change.files("aliases")) & set(before.files("aliases"))
    assert len(kept) == 3 and len(content(change)) == 20 and ("2-3", "new") in content(change)
    again = store.change()
    again.merge("aliases", before.table("aliases"), ["url"])
    assert again.files("aliases") == before.files("aliases")


def test_exchange_keeps_rows_that_are_not_meant(spark, store):
    link = "id long, src string, operator boolean"
    change = store.change()
    change.append("links", spark.createDataFrame([(1, "a", False), (2, "a", True), (3, "b", False), (4, "a", None)], link))
    gone = spark.createDataFrame([("a",)], "src string")
    change.exchange("links", gone, ["src"], spark.createDataFrame([(9, "a", False)], link), ~F.coalesce("operator", F.lit(False)))
    assert sorted(r["id"] for r in change.table("links").collect()) == [2, 3, 9]


def test_killed_writer_leaves_the_old_version(spark, store, tmp_path):
    change = store.change()
    change.append("aliases", aliases(spark, ("a", "b")))
    change.publish()
    code = f"""
        import os, sys
        from pyspark.sql import SparkSession
        from weftgraph.sources.store import Store
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        change = Store(spark, "{store.folder.path}").change()
        change.upsert("aliases", spark.createDataFrame([("a", "lost")], "url string, final_url string"), ["url"])
        assert change.table("aliases").first().final_url == "lost"
        os.kill(os.getpid(), 9)
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ended = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], env=os.environ | {"PYTHONPATH": root}, timeout=180, capture_output=True)
    assert ended.returncode == -9, ended.stderr.decode()[-800:]
    assert content(store.snapshot()) == [("a", "b")] and len(store.folder.names("aliases")) == 2
    assert store.vacuum() >= 1 and len(store.folder.names("aliases")) == 1
    assert content(store.snapshot()) == [("a", "b")]


def test_vacuum_keeps_what_the_last_versions_name(spark, store):
    for k in range(3):
        change = store.change()
        change.replace("aliases", aliases(spark, ("a", str(k))))
        change.publish()
    store.vacuum(keep=2)
    assert store.versions() == [2, 3]
    assert content(store.snapshot(2)) == [("a", "1")] and content(store.snapshot()) == [("a", "2")]


def test_changed_rows_sees_nulls_maps_and_lists(spark):
    kind = "id int, a array<string>, m map<string,string>, s string"
    old = spark.createDataFrame([(1, ["x"], {"k": "v"}, None), (2, None, None, "t"), (3, ["y"], {}, "")], kind)
    new = spark.createDataFrame([(1, ["x"], {"k": "v"}, None), (2, [], None, "t"), (3, ["y"], {}, None), (4, None, None, None)], kind)
    assert sorted(r["id"] for r in changed_rows(old, new, ["id"]).collect()) == [2, 3, 4]


def test_version_file_names_the_files(spark, store):
    change = store.change()
    change.append("aliases", aliases(spark, ("a", "b")))
    change.publish("why")
    said = json.loads(store.folder.read("versions/000000000001.json"))
    assert said["note"] == "why" and said["tables"]["aliases"] == store.snapshot().files("aliases")


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_numbers_have_no_gaps(spark, n):
    rows = spark.range(n).select((F.col("id") * 7919 % 1009).alias("a"), F.col("id").alias("b")).repartition(7)
    found = numbered(rows, "n", "a", "b", start=5).collect()
    assert [r["n"] for r in sorted(found, key=lambda r: (r["a"], r["b"]))] == list(range(5, 5 + n))
