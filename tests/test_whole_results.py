"""Results that larger tables showed to differ from their SQL."""

import pytest

from weftgraph.operators import leads
from weftgraph.plans import markup_queries


@pytest.mark.parametrize("n", [7, 49, 107])
def test_archetypes_of_great_sums_are_whole(spark, n):
    total = 2.0**42 + 1
    one = spark.createDataFrame([("BIG_9", f"s{k}", ["w"], ["nav"]) for k in range(n)], "tag string, src string, targets array<string>, regions array<string>")
    rows, _ = leads.attribute(spark.createDataFrame([("BIG_9", total, "w")], "lead_tag string, leads double, main_conversion_page string"), one)
    found = leads.archetypes(one, rows, spark.createDataFrame([("w",)], "url string"), r"(?P<archetype>[A-Z]+)_").collect()
    assert [tuple(r) for r in found] == [("BIG", 1, n, n, int(total))]


def test_sitemap_pages_of_several_files(spark, tmp_path):
    rows = [(0, "https://a.test/x", ""), (1, "https://a.test/x", ""), (1000, "https://a.test/x", ""), (6000, "https://a.test/x", ""), (2, "https://a.test/y", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = sorted(r["url"] for r in markup_queries.sitemap_pages(spark, str(tmp_path)).collect())
    assert found == ["https://a.test/x", "https://a.test/x", "https://a.test/y"]  # files 0 and 1; file 6 is gone
