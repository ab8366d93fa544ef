import pytest

from weftgraph.plans import page_queries as q


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("leads"))
    parts = [(1, "A", 1), (2, "BB", 2), (3, "CC", 33), (4, "D", 9)]  # kinds of 3, 4, 5 and 3 characters
    sold = [(1, 5, 1, 10.0), (1, 7, 4, 20.0), (2, 11, 1, 4.0), (3, 8, 2, 6.0), (4, 9, 6, 7.0), (4, 9, 1, 1.0)]
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_size int").write.parquet(f"{where}/part.parquet")
    spark.createDataFrame(sold, "l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{where}/lineitem.parquet")
    return where


def test_every_supplier_of_a_kind_is_a_carrier(spark, sf_dir):
    rows = {(r["lead_tag"], r["src"]): (r["join_type"], r["region"], r["tag_source_pages"], r["leads_allocated"], r["attribution"]) for r in q.lead_attribution(spark, sf_dir).collect()}
    assert rows == {
        ("A_1", "s5"): ("exact", "body", 2, 15.0, "shared"),
        ("A_1", "s7"): ("exact", "nav", 2, 15.0, "shared"),
        ("BB_2", "s11"): ("exact", "body", 1, 4.0, "exact"),
        ("CC_33_123456", "s8"): ("fallback", "body", 1, 6.0, "exact"),
        ("D_9", "s9"): ("exact", "body,nav", 1, 8.0, "exact"),
    }
    assert sum(r["pages"] for r in q.lead_matches(spark, sf_dir).collect()) == 5


def test_zero_lead_tags_come_from_all_carriers(spark, tmp_path):
    spark.createDataFrame([(1, "AAA", 11)], "p_partkey long, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")  # 6 characters: NONE_
    sold = [(1, 5, 1, 10.0), (1, 7, 4, 20.0), (1, 11, 1, 1.0)]
    spark.createDataFrame(sold, "l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [(r["tag"], r["pages"], r["win_pages"]) for r in q.zero_lead_tags(spark, str(tmp_path)).collect()] == [("AAA_11", 3, 1)]
