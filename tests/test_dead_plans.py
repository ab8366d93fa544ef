from weftgraph.plans import page_queries as q


def test_bodies_and_titles_are_read(spark, tmp_path):
    pages = [
        (0, "https://x.com/a", "<html><head><title>Shop</title></head><body><p>Sorry, this page\n no longer exists.</p></body></html>"),
        (5, "https://x.com/a", "<html><head><title>Shop</title></head><body>Please solve the captcha</body></html>"),
        (6, "https://x.com/b", "<html><head><TITLE lang='en'>404 &amp; gone</TITLE></head><body>x</body></html>"),
        (7, "https://x.com/c", "<html><head><title>Shop</title></head><body>captcha " + "word " * 900 + "</body></html>"),
        (12, "https://x.com/d", "<html><head><title>Shop</title></head><body>fine</body></html>"),
        (1, "https://x.com/e", "<html><head><title>Shop</title></head><body>fine</body></html>"),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r["page_id"]: (r["dead_reason"], r["block_reason"]) for r in q.dead_and_blocked(spark, str(tmp_path)).collect()} == {
        0: ("page says 'this page no longer exists'", None),
        5: (None, "page says 'captcha'"),
        6: ("title starts with 404", None),
        7: (None, None),
        12: (None, None),
        1: ("HTTP 404", None),
    }
