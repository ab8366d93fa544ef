from pyspark.sql import functions as F

from weftgraph.functions import predicates as p, urls
from weftgraph.operators import seeds


def test_each_step_of_a_seed_url_is_written_once(spark):
    given = [" HTTPS://User@WWW.LinkedIn.com:443/posts/a//?x=1#y ", "//linkedin.com/posts/b/", "linkedin.com", "", "  ", None, "https://", "http://[::1]:80/a/", "x://h./p?q"]
    found = spark.createDataFrame([(k, u) for k, u in enumerate(given)], "k int, u string").select("k", urls.seed_url(F.col("u")).alias("seed"))
    assert str(found._jdf.queryExecution().analyzed()).count(urls.SPACES) == 1
    wanted = ["https://www.linkedin.com/posts/a", "https://linkedin.com/posts/b", "https://linkedin.com", None, None, None, None, "http://::1/a", "x://h/p"]
    assert [r["seed"] for r in found.orderBy("k").collect()] == wanted


def test_parameters_are_read_once_for_each_spelling(spark):
    scope = p.Scope(("shop.example",), capture_params=("camp",))
    given = [None, "", "https://shop.example/a", "https://shop.example/a?camp=1", "https://shop.example/a?camp=1", "https://shop.example/b?CAMP=&camp=2", "?", "https://shop.example/c#?camp=3"]
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(given)], "k int, u string")
    told = rows.withColumn("direct", urls.captured_params(F.col("u"), scope.capture_params))
    found = seeds._tagged(told, "u", "of", scope).orderBy("k").collect()
    assert len(found) == len(given) and all(r["of"] == r["direct"] for r in found)
    assert found[3]["of"] == {"camp": "1"} and found[2]["of"] == {}
