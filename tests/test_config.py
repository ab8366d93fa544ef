import copy
import json

import pytest
import yaml

from weftgraph.__main__ import main
from weftgraph.sources import config as c
from weftgraph.sources.tables import ConfigError

GOOD = {
    "client": {"name": "Shop", "slug": "shop"},
    "scope": {"allowed_domains": ["shop.test"], "strip_query_params": ["utm_*"]},
    "win": {"name": "buy", "url_patterns": ["https://shop.test/buy*"]},
    "campaigns": [{"id": "spring", "name": "Spring", "platform": "mail", "ad_copy": "Come", "entry_links": [{"label": "home", "url": "https://shop.test"}]}],
}


def changed(**paths):
    data = copy.deepcopy(GOOD)
    for path, value in paths.items():
        at = data
        *up, last = (int(x) if x.isdigit() else x for x in path.split("__"))
        for x in up:
            at = at[x]
        at[last] = value
    return data


def test_defaults_and_parts():
    found = c.parse_config(GOOD)
    assert found.data["crawl"]["max_depth"] == 8 and found.data["leads"]["join"]["key"] == "wt_mc_id" and found.warnings() == []
    assert found.scope.strip_query_params == ("utm_*",) and found.win.url_patterns == ("https://shop.test/buy*",)
    assert found.entries("spring") == [("home", "https://shop.test/")]
    with pytest.raises(ConfigError, match="known: spring"):
        found.campaign("autumn")


def test_all_problems_at_once():
    data = changed(client__slug="No Slug", scope__allowed_domains=[], scope__more=1, win__match="loose", campaigns__0__entry_links=[{"label": ""}], crawl={"max_pages": 0, "headed": "yes", "backoff_s": 0.5})
    with pytest.raises(ConfigError) as error:
        c.parse_config(data, "x.yaml")
    text = str(error.value)
    for part in ("client.slug", "scope.allowed_domains: needs 1", "scope.more: is not known", "win.match", "campaigns.0.entry_links.0.label", "campaigns.0.entry_links.0.url: is missing", "crawl.max_pages", "crawl.headed"):
        assert part in text, part
    assert "backoff_s" not in text
    for bad in ([], None, {"client": 3}, changed(win__url_patterns=["re:("]), changed(win__require_form=True), changed(win__url_patterns=[]), changed(campaigns__0__entry_links=[{"label": "x", "url": "mailto:x"}]), changed(leads={"archetype_pattern": "a"})):
        with pytest.raises(ConfigError):
            c.parse_config(bad)


def test_warnings_and_placeholders():
    data = changed(
        win__url_patterns=["https://other.test/x", "https://*.test/x", "re:https://else.test"], win__known_pages=[{"url": "https://far.test/", "type": "t"}, {"url": "https://shop.test/no", "type": "t"}],
        win__exclude_patterns=["*/no"], campaigns__0__ad_copy="REPLACE-ME now", campaigns__0__entry_links=[{"label": "a", "url": "https://shop.test/?utm_x=1"}, {"label": "b", "url": "https://SHOP.test/#x"}], client__name="REPLACE-ME",
    )
    found = c.parse_config(data)
    told = found.warnings()
    assert len(told) == 6 and sum("other.test" in x for x in told) == 1 and sum("is excluded" in x for x in told) == 1 and sum("one URL" in x for x in told) == 1
    assert found.placeholders() == ["client.name", "campaigns[0].ad_copy"] and found.placeholders("spring") == ["campaigns[0].ad_copy"]


def test_command_line(spark, tmp_path, capsys):
    file = tmp_path / "shop.yaml"
    file.write_text(yaml.safe_dump(GOOD))
    assert main(["validate", str(file)]) == 0 and "1 campaigns" in capsys.readouterr().out
    assert main(["validate", str(tmp_path / "none.yaml")]) == 2
    file.with_name("bad.yaml").write_text("a: [")
    assert main(["validate", str(file.with_name("bad.yaml"))]) == 2
    home = "https://shop.test/"
    pages = [(home, "ok", False, None, None), (home + "a", "ok", False, None, None), (home + "end", "ok", False, None, None)]
    links = [(home, home + "a", "body"), (home + "a", home + "buy/1", "nav"), (home, home + "end", "body")]
    store = tmp_path / "store"
    spark.createDataFrame(pages, "url string, status string, win boolean, win_source string, form_present boolean").write.parquet(f"{store}/pages.parquet")
    spark.createDataFrame([(*x, False, True) for x in links], "src string, url string, region string, operator boolean, in_scope boolean").write.parquet(f"{store}/links.parquet")
    spark.createDataFrame([], "url string, final_url string").write.parquet(f"{store}/aliases.parquet")
    assert main(["analyze", str(file), "spring", str(store), str(tmp_path / "out")]) == 0
    told = json.loads((tmp_path / "out" / "report.json").read_text())
    assert (told["pages"], told["links"], told["wins"]) == (4, 3, 1)
    assert {(r["label"], r["clicks"], r["clicks_to_dead_end"]) for r in told["entries"]} == {("all_links", 2, 1), ("content_only", None, 0)}
    assert "| all_links | https://shop.test/ | 2 | 1 |" in (tmp_path / "out" / "report.md").read_text()
    assert c.find_taxonomy("shop", configs=str(tmp_path)) is None and c.find_taxonomy("shop", str(file)) == str(file)
