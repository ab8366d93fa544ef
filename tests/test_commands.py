import json

import yaml

from weftgraph.__main__ import main
from weftgraph.sources.runs import open_run
from weftgraph.sources.store import Store

B = "https://shop.test/"
CONFIG = {
    "client": {"name": "Shop", "slug": "shop"},
    "scope": {"allowed_domains": ["shop.test"], "strip_query_params": ["sid"], "capture_params": ["sid"]},
    "win": {"name": "buy", "url_patterns": [B + "buy*"]},
    "campaigns": [{"id": "spring", "name": "Spring", "platform": "posts", "ad_copy": "x", "entry_links": [{"label": "home", "url": B}]}],
}


def test_a_run_from_saving_to_its_report(spark, tmp_path, capsys):
    from weftgraph.operators import crawl_store as cs
    from weftgraph.sources.runs import save_run

    run = f"file://{tmp_path}/run"
    assert main(["status", run]) == 2 and "can't be read" in capsys.readouterr().err
    store = save_run(spark, run, yaml.safe_dump(CONFIG))
    change = store.change()
    cs.add_entries(change, spark.createDataFrame([("home", B)], "label string, url string"), "label")
    link = "src string, href string, url string, text string, region string, in_scope boolean, operator boolean"
    links = [(B, "buy?sid=7", B + "buy?sid=7", "buy now", "body", True, False), (B, "a", B + "a", "a", "nav", True, False), (B + "a?sid=1", "/", B, "home", "nav", True, False)]
    pages = spark.createDataFrame([(B, "ok", "Alpha shop"), (B + "a?sid=1", "ok", "A")], "url string, status string, title string")
    cs.save_crawled(change, pages, spark.createDataFrame(links, link), "href")
    change.publish("crawl")
    (tmp_path / "seeds.csv").write_text("Post URL,Title,Landing page\nlinkedin.com/posts/1,News,https://shop.test/new?sid=3\nlinkedin.com/posts/1,News,https://else.test/\n")
    (tmp_path / "terms.yaml").write_text(yaml.safe_dump({"types": ["T"], "entities": [{"type": "T", "name": "alpha", "terms": ["alpha"]}]}))
    assert main(["repair", run]) == 0
    assert "version 2: pages merged 0, links renormalized 1, page tags 2, links tagged 1" in capsys.readouterr().out
    assert main(["seeds", run, "spring", f"file://{tmp_path}/seeds.csv"]) == 0 and "version 3: new entry 1" in capsys.readouterr().out
    assert main(["extract", run, str(tmp_path / "terms.yaml")]) == 0 and "version 4: pages 2, read 2" in capsys.readouterr().out
    assert main(["status", run]) == 0
    told = capsys.readouterr().out
    assert "version 4" in told and "pages external: 1" in told and "entries: 2" in told and "page_entities: 1" in told
    assert main(["report", run, str(tmp_path / "out")]) == 0
    assert json.loads((tmp_path / "out" / "report.json").read_text())["wins"] == 1
    assert {r["url"] for r in open_run(spark, run).tables.table("pages").collect()} == {B, B + "a", "https://linkedin.com/posts/1"}
    assert main(["vacuum", run]) == 0 and Store(spark, f"{run}/store").versions() == [4]
