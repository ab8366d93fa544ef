import random
import re

import pytest

from weftgraph.llm import url_rules

CASES = {
    "https://a.example.org/es/1": ("a.example.org", "/es/1", "example.org/es/", "block", None),
    "HTTP://Example.ORG/en/12?x#y": ("example.org", "/en/12", "example.org/en/1", "block", None),
    "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow", None),
    "http://badexample.org/es/1": ("badexample.org", "/es/1", "org/", "allow", None),
    "http://example.org": ("example.org", "", None, "allow", None),
    "http://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow", None),
    "http://cheap-pills.com/fr/a": ("cheap-pills.com", "/fr/a", "com/fr/", "allow", None),
    "http://x.com/de/": ("x.com", "/de/", "com/de/", "block", None),
    "http://x.com/de": ("x.com", "/de", None, "allow", None),
    "http://cheap-pills.example.com/en/": ("cheap-pills.example.com", "/en/", None, "block", "pills"),
    "http://pillsbury.example.com/en/": ("pillsbury.example.com", "/en/", None, "allow", None),
    "http://h?a/b": ("h", "", None, "allow", None),
    "://h/p": ("h", "/p", None, "allow", None),
    "no url": ("", "", None, "allow", None),
    "": ("", "", None, "allow", None),
    None: ("", "", None, "allow", None),
    "http://x.org/" + "a" * 50_000: ("x.org", "/" + "a" * 50_000, "org/", "allow", None),
}


def test_cases_repeats_and_null_ids(spark):
    rows = [(k, u, "h", "p") for k, u in enumerate(CASES)] + [(0, list(CASES)[0], "h", "p"), (None, "http://x.com/de/", "h", "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string")
    got = url_rules.judge_urls(pages).collect()
    assert len(got) == len(rows)
    urls = list(CASES)
    for r in got:
        url = "http://x.com/de/" if r["page_id"] is None else urls[r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"], r["pattern"]) == CASES[url]


def test_rules_without_tokens_always_run(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.net/y")], "page_id long, url string")
    rule = url_rules.Rule("x", "block", "/x$", (), 0)
    assert {r["page_id"]: r["verdict"] for r in url_rules.judge_urls(pages, (rule,)).collect()} == {1: "block", 2: "allow"}


def test_rules_are_filed_under_their_rarest_token(spark):
    sites = spark.createDataFrame([("h", "p", ["common", "rare"]), ("h", "q", ["common"])], "host string, path string, tokens array<string>")
    index = url_rules.rule_index(sites, (url_rules.Rule("r", "block", "x", ("common", "rare"), 0),)).collect()
    assert [r["token"] for r in index] == ["rare"]


def test_empty_table(spark):
    assert url_rules.judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def slow_judge(url, rules):
    """Every rule is tried on the URL."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(r.rank, r.verdict, r.name) for r in rules if re.search(r.regex, host + path)]
    if not fits:
        return host, path, None, "allow", None
    rank, verdict, name = max(fits)
    return host, path, name if rank >= 1000 else None, verdict, None if rank >= 1000 else name


def test_rule_file_against_every_rule(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["news", "shop", "bad", "good", "xxx", "mail", "top", "free", "win", "a1", "b2"])
    lines = ["# a comment", "", "allow word good  # here too", r"block re:^[^/]*/.*(?:bad|worse)[0-9]+$", r"block re:^[^/]*/(?:.*[^a-z0-9])?xxx-[0-9]+$ xxx"]
    for _ in range(600):
        lines.append(rng.choice(["block", "allow"]) + " " + rng.choice([f"{word()}.test/{word()}", f"{word()}.{word()}.test/", f"word {word()}{rng.randrange(9)}", f"path {word()} {word()}", f"path {word()}"]))
    rules = url_rules.read_rules(lines) + url_rules.DEFAULT_RULES
    urls = [f"http://{word()}-{word()}{rng.choice(['', '3'])}.{word()}.{rng.choice(['test', 'com', 'org'])}/{word()}{rng.choice('/-_.')}{word()}{rng.choice(['', '7', '-7', '?q=xxx'])}" for _ in range(700)]
    urls += ["http://m.test/sid=0123456789abcdef01/x", "http://free-a-b-c.net/", "http://u.net/x/top-10-best-things", "http://u.net/Buy-VIAGRA.html", "http://www.spam-farm.net/", None, "", "x://"]
    found = url_rules.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert len(found) == len(urls)
    for r in found:
        assert tuple(r)[1:] == slow_judge(urls[r["page_id"]], rules), urls[r["page_id"]]
    assert len({r["pattern"] for r in found}) > 20


def test_rule_files_are_checked():
    for bad in ("deny x.test/", "block", "block re:("):
        with pytest.raises((ValueError, re.error)):
            url_rules.read_rules(["allow a.test/", bad])
