"""URL filtering by rules that are found through their rarest literal token.

A rule is a regular expression over host + path and the literal tokens every URL that it fits must hold.
Each rule is filed under that token of its own which the fewest distinct URLs hold; a URL fetches the rules filed
under its tokens, and only those run. Everything stays in DataFrame operations.

Defined cases: a null URL or one without `://` has an empty host and path, fits no rule and is allowed. Repeated
rows are judged alike and all returned. Among the host rules that fit, the longest wins; of equal ones, block.
An empty table gives an empty result. Only `id_col` and `url_col` are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Rule rows up to which the index is sent to every executor; a larger one is joined by shuffle.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    rank: int  # host rules: length of the rule, above every pattern rule


def host_rule(rule: str, verdict: str) -> Rule:
    """`host/path-prefix`: fits the host and its subdomains where the path starts with the rule's."""
    host, _, path = rule.partition("/")
    whole = re.findall(r"[a-z0-9]+", host) + re.findall(r"(?<![a-z0-9])([a-z0-9]+)(?=[^a-z0-9])", "/" + path.lower())
    return Rule(rule, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}", tuple(whole), 1000 + len(rule))


def word_rule(word: str, verdict: str = "block") -> Rule:
    """Fits a host with `word` between dots, hyphens or its ends."""
    return Rule(word, verdict, rf"^(?:[^/]*[.-])?{re.escape(word)}(?:[.-][^/]*)?(?:/|$)", tuple(re.findall("[a-z0-9]+", word)), 0)


def path_rule(words: str, verdict: str = "block") -> Rule:
    """Fits a path that holds the words, in any case, one after the other with one mark between them, as whole words."""
    parts = words.split()
    body = "[^A-Za-z0-9]".join(map(re.escape, parts))
    return Rule(f"/{words}", verdict, rf"^[^/]*/(?i:(?:.*[^A-Za-z0-9])?{body}(?:[^A-Za-z0-9]|$))", tuple(re.findall("[a-z0-9]+", words)), 0)


def pattern_rule(name: str, regex: str, tokens: tuple[str, ...], verdict: str = "block") -> Rule:
    """A regular expression over host + path. Every URL that it fits must hold the tokens as whole words of a-z and 0-9."""
    return Rule(name, verdict, regex, tokens, 0)


def read_rules(lines: Iterable[str]) -> tuple[Rule, ...]:
    """Rules of a file: `allow|block host/path`, `... word w`, `... path w w` or `... re:regex token token`; # begins a comment."""
    found = []
    for number, line in enumerate(lines, 1):
        verdict, _, rest = line.split("#", 1)[0].strip().partition(" ")
        if not verdict:
            continue
        kind, _, body = rest.strip().partition(" ")
        if verdict not in ("allow", "block") or not kind:
            raise ValueError(f"line {number}: should begin with allow or block and a rule")
        if kind in ("word", "path"):
            found.append((word_rule if kind == "word" else path_rule)(body.strip().lower(), verdict))
        elif kind.startswith("re:"):
            re.compile(kind[3:])
            found.append(pattern_rule(kind[3:], kind[3:], tuple(body.lower().split()), verdict))
        else:
            found.append(host_rule(kind, verdict))
    return tuple(found)


# The host rules of the registered query.
HOST_RULES = (
    host_rule("org/", "allow"),
    host_rule("example.org/en/1", "block"),
    host_rule("example.org/es/", "block"),
    host_rule("com/fr/", "allow"),
    host_rule("com/de/", "block"),
)
# Words in host names that mark adult, gambling, pill, malware and spam sites.
HOST_WORDS = """
    adult blackjack bitcoin-doubler camgirls casino cialis cracked crackz dating-now escort escorts fakeid fetish gambling
    hentai jackpot keygen lottery malware milf nude nudes onlyfans-leak payday-loans phishing pills poker porn porno pornhub
    replica-watches roulette sexcam sexshop slots spam spam-farm sportsbet spyware steroids strip stripper tramadol torrentz
    trojan viagra warez webcam-girls xanax xvideos xxx
""".split()
# Words of paths, in this order, that mark downloads of stolen goods, link farms and shop spam.
PATH_WORDS = (
    "adult", "buy viagra", "buy followers", "cheap pills", "casino bonus", "crack download", "credit card generator", "doorway", "escort service", "fake id",
    "free keygen", "free porn", "free slots", "full crack", "get rich quick", "hack tool", "hot singles", "keygen", "link farm", "lose weight fast", "miracle cure", "no prescription",
    "nulled", "online casino", "payday loan", "porn", "replica watches", "serial key", "sex cam", "torrent download", "viagra", "warez", "xxx",
)
#: Chains of marks in host names and session numbers in paths, as generated sites have them.
PATTERN_RULES = (
    pattern_rule("free-host-chain", r"^(?:[^/]*[.-])?free(?:-[a-z0-9]+){2,}\.[^/]*/", ("free",)),
    pattern_rule("best-top-list", r"^[^/]*/(?:.*/)?top-[0-9]+-best-[^/]*$", ("top", "best")),
    pattern_rule("session-path", r"^[^/]*/(?:.*/)?(?:sid|sessionid)=[0-9a-f]{16,}(?:/|$)", ()),
)
DEFAULT_RULES = HOST_RULES + tuple(map(word_rule, HOST_WORDS)) + tuple(map(path_rule, PATH_WORDS)) + PATTERN_RULES


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""))


def rule_index(sites: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(token, name, verdict, regex, rank): every rule under its rarest token among all of `sites`."""
    wanted = sorted({t for r in rules for t in r.tokens})
    seen = (
        sites.select(F.explode("tokens").alias("token")).filter(F.col("token").isin(wanted)).groupBy("token").count()
    )
    counts = {r["token"]: r["count"] for r in seen.collect()}  # at most one row for each token of the rules
    rows = [
        (min(r.tokens, key=lambda t: (counts.get(t, 0), t)) if r.tokens else None, r.name, r.verdict, r.regex, r.rank)
        for r in rules
    ]
    return sites.sparkSession.createDataFrame(
        rows, "token string, name string, verdict string, regex string, rank int"
    )


def judge_urls(
    pages: DataFrame,
    rules: tuple[Rule, ...] = DEFAULT_RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """id, host, path, rule (the host rule that decided), verdict, pattern (the other rule that decided)."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    sites = rows.select("host", "path").distinct().withColumn("tokens", _tokens(F.concat("host", F.lit("/"), "path")))
    index = rule_index(sites, rules)
    if len(rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    found = sites.select("host", "path", F.explode("tokens").alias("token")).join(index, "token").drop("token")
    always = [r for r in rules if not r.tokens]
    if always:
        loose = sites.select(
            "host",
            "path",
            F.explode(
                F.array(
                    *(
                        F.struct(
                            F.lit(r.name).alias("name"),
                            F.lit(r.verdict).alias("verdict"),
                            F.lit(r.regex).alias("regex"),
                            F.lit(r.rank).alias("rank"),
                        )
                        for r in always
                    )
                )
            ).alias("r"),
        ).select("host", "path", "r.*")
        found = found.unionByName(loose)
    best = (
        found.filter(F.expr("concat(host, path) rlike regex"))
        .groupBy("host", "path")
        .agg(F.max(F.struct("rank", F.col("verdict").alias("says"), "name")).alias("best"))
    )
    joined = rows.join(best, ["host", "path"], "left")
    by_host = F.col("best.rank") >= 1000
    return joined.select(
        "page_id",
        "host",
        "path",
        F.when(by_host, F.col("best.name")).alias("rule"),
        F.coalesce(F.col("best.says"), F.lit("allow")).alias("verdict"),
        F.when(~by_host, F.col("best.name")).alias("pattern"),
    )


ORACLE = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts
), fitting AS (
  SELECT page_id, max(name) AS pattern FROM ruled JOIN (VALUES __RULES__) t(name, regex) ON regexp_matches(host || path, regex)
  WHERE rule IS NULL GROUP BY page_id
)
SELECT ruled.page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  pattern
FROM ruled LEFT JOIN fitting ON fitting.page_id = ruled.page_id
""".replace("__RULES__", ", ".join(f"('{r.name}', '{r.regex}')" for r in DEFAULT_RULES if r.rank == 0))
