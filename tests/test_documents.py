from xml.etree import ElementTree

from pyspark.sql import functions as F

from weftgraph.sources import documents as d

ML, GX = "{http://graphml.graphdrawing.org/xmlns}", "{http://gexf.net/1.3}"
ODD = 'a<b>&"c"\n\tü\x00'


def parsed(spark, tmp_path, name):
    d.one_file(spark, f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}.xml")
    return ElementTree.parse(tmp_path / f"{name}.xml").getroot()


def test_graphml_reads_back(spark, tmp_path):
    nodes = spark.createDataFrame([(ODD, True, 3, 0.5, ["x", "y"], "t"), ("b", None, None, None, None, None)], "id string, win boolean, d int, share double, tags array<string>, `odd name` string")
    edges = spark.createDataFrame([("b", ODD, "nav"), (ODD, "b", None)], "source string, target string, region string")
    d.write_graphml(nodes, edges, f"file://{tmp_path}/g")
    root = parsed(spark, tmp_path, "g")
    keys = {k.get("id"): (k.get("for"), k.get("attr.name"), k.get("attr.type")) for k in root.iter(f"{ML}key")}
    assert [(f, t) for f, _, t in keys.values()] == [("node", "boolean"), ("node", "long"), ("node", "double"), ("node", "string"), ("node", "string"), ("edge", "string")]
    found = {n.get("id"): {keys[x.get("key")][1]: x.text for x in n} for n in root.iter(f"{ML}node")}
    assert found == {ODD.replace("\x00", ""): {"win": "true", "d": "3", "share": "0.5", "tags": "x,y", "odd name": "t"}, "b": {"win": "false", "d": "-1", "share": "-1", "tags": None, "odd name": None}}
    assert [(e.get("source"), e[0].text) for e in root.iter(f"{ML}edge")] == [(ODD.replace("\x00", ""), None), ("b", "nav")]


def test_large_graphs_stay_in_order(spark, tmp_path):
    n = 200_000
    nodes = spark.range(n).repartition(7).select(F.format_string("n%07d", "id").alias("id"), F.lit("").alias("label"), F.when(F.col("id") % 3 == 0, "win").alias("role"), (F.col("id") % 5).cast("int").alias("size"))
    edges = spark.range(n).select(F.format_string("n%07d", "id").alias("source"), F.format_string("n%07d", (F.col("id") * 7 + 1) % n).alias("target"), F.lit(2).alias("weight"))
    d.write_gexf(nodes, edges, f"file://{tmp_path}/x")
    root = parsed(spark, tmp_path, "x")
    ids = [e.get("id") for e in root.iter(f"{GX}node")]
    assert ids == [f"n{k:07}" for k in range(n)]
    assert [(e.get("source"), e.get("target")) for e in root.iter(f"{GX}edge")] == [(f"n{k:07}", f"n{(k * 7 + 1) % n:07}") for k in range(n)]


def test_empty_graph(spark, tmp_path):
    d.write_graphml(spark.createDataFrame([], "id string, win boolean"), spark.createDataFrame([], "source string, target string"), f"file://{tmp_path}/e")
    assert len(list(parsed(spark, tmp_path, "e").iter(f"{ML}node"))) == 0
