"""Scope, win, robots, block and dead-page predicates as columns that are built from a configuration."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain, pairwise
from operator import or_
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.functions import urls


def anywhere(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def java_regex(pattern: str) -> str:
    """A Python pattern for Spark: named groups respelled, classes meant for all of Unicode."""
    return "(?U)" + pattern.replace("(?P<", "(?<")


def prefix_match(text: Column, pattern: str) -> Column:
    return text.rlike(f"^(?:{java_regex(pattern)})")


def glob_regex(glob: str) -> str:
    """A shell pattern over the whole text."""
    return f"(?s)^{urls.glob_body(glob)}$"


@dataclass(frozen=True)
class Scope:
    allowed_domains: tuple[str, ...]
    locale_include: tuple[str, ...] = ()
    locale_exclude: tuple[str, ...] = ()
    locale_hosts: tuple[str, ...] = ()
    include_patterns: tuple[str, ...] = ()
    strip_query_params: tuple[str, ...] = ()
    capture_params: tuple[str, ...] = ()
    region_selectors: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def holds(self, url: Column) -> Column:
        inside = urls.host_allowed(url, list(self.allowed_domains))
        locale = urls.locale_allowed(url, list(self.locale_include), list(self.locale_exclude))
        if self.locale_hosts:
            locale |= ~urls.host_allowed(url, list(self.locale_hosts))
        wanted = anywhere([prefix_match(url, p) for p in self.include_patterns]) if self.include_patterns else F.lit(True)
        return F.coalesce(inside & locale & wanted, F.lit(False))


@dataclass(frozen=True)
class WinClass:
    name: str
    patterns: tuple[str, ...]
    any_win: bool = True


@dataclass(frozen=True)
class Win:
    name: str = "win"
    url_patterns: tuple[str, ...] = ()
    classes: tuple[WinClass, ...] = ()
    known_pages: tuple[tuple[str, str], ...] = ()  # (url, type)
    exclude_patterns: tuple[str, ...] = ()
    ignore_case: bool = False
    near_miss_keywords: tuple[str, ...] = ()

    def _any(self, url: Column, patterns: tuple[str, ...]) -> Column:
        flags = "(?iu)" if self.ignore_case else ""
        made = [f"^(?:{java_regex(p[3:])})$" if p.startswith("re:") else glob_regex(p) for p in patterns]
        return anywhere([url.rlike(flags + m) for m in made])

    def excluded(self, url: Column) -> Column:
        return self._any(url, self.exclude_patterns)

    def _known(self, url: Column, place: int) -> Column:
        found = F.lit(None).cast("string")
        for known in reversed(self.known_pages):
            page = known[0]
            same = (url == F.lit(urls.normal_url(page))) | (urls.conversion_url(url) == urls.conversion_url(F.lit(page)))
            found = F.when(same, F.lit(known[place])).otherwise(found)
        return found

    def known_page(self, url: Column) -> Column:
        """The known page that the URL is, after either normalization."""
        return self._known(url, 0)

    def known_type(self, url: Column) -> Column:
        """The type of the known page that the URL is, after either normalization."""
        return self._known(url, 1)

    def class_of(self, url: Column) -> Column:
        kinds = [F.when(anywhere([prefix_match(url, p) for p in c.patterns]), F.lit(c.name)) for c in self.classes]
        return F.when(~self.excluded(url), F.coalesce(*kinds)) if kinds else F.lit(None).cast("string")

    def matches(self, url: Column) -> Column:
        counted = [c.name for c in self.classes if c.any_win]
        in_class = F.coalesce(self.class_of(url).isin(counted), F.lit(False)) if counted else F.lit(False)
        hit = self.known_type(url).isNotNull() | self._any(url, self.url_patterns) | in_class
        return F.coalesce(hit & ~self.excluded(url), F.lit(False))

    def type_of(self, url: Column) -> Column:
        return F.when(self.matches(url), F.coalesce(self.known_type(url), self.class_of(url), F.lit(self.name)))

    def destination(self, url: Column) -> Column:
        return self.matches(url) | self.class_of(url).isNotNull()

    def keywords(self) -> list[str]:
        """The configured ones, or the first two words of three letters of each shell pattern's last part."""
        if self.near_miss_keywords:
            return list(self.near_miss_keywords)
        found: list[str] = []
        for p in self.url_patterns:
            if not p.startswith("re:"):
                last = [x for x in p.split("/") if x][-1:] or [""]
                found += re.findall(r"[a-z]{3,}", re.sub(r"\.\w+$", "", last[0].lower()))[:2]
        return list(dict.fromkeys(found))

    def near_miss(self, url: Column) -> Column:
        path = F.lower(urls.path_of(url))
        return anywhere([path.contains(k) for k in self.keywords()]) & ~self.matches(url) & ~self.excluded(url)


# ---- robots.txt


_RECORD = re.compile(r"^[^\S\n]*([\w-]+)[^\S\n]*:[^\S\n]*([^#\n]*?)[^\S\n]*(?:#.*)?$", re.MULTILINE)


@dataclass(frozen=True)
class RobotsGroup:
    agents: frozenset[str]
    rules: tuple[tuple[bool, str], ...]  # (allow, pattern)

    def names(self, agent: str) -> bool:
        """Whether an agent of the group, other than the one for all, is part of this one's name."""
        return any(a in agent.lower() for a in self.agents - {"*"})


def robots_groups(text: str) -> list[RobotsGroup]:
    """A group begins with a run of agent records; sitemaps stand outside of all groups."""
    lines = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    records = [(m[1].lower(), m[2]) for m in _RECORD.finditer(lines) if m[1].lower() != "sitemap"]
    agent = [key == "user-agent" for key, _ in records]
    begins = [k for k, here in enumerate(agent) if here and not (k and agent[k - 1])]
    parts = [records[a:b] for a, b in pairwise([*begins, len(records)])]
    return [
        RobotsGroup(
            frozenset(value.lower() for key, value in part if key == "user-agent"),
            tuple((key == "allow", value) for key, value in part if key in ("allow", "disallow") and value),
        )
        for part in parts
    ]


def robots_rules(text: str, agent: str) -> list[tuple[bool, str]]:
    """The rules of all groups that name the agent, or where there is none, of those for all."""
    groups = robots_groups(text)
    chosen = [g for g in groups if g.names(agent)] or [g for g in groups if "*" in g.agents]
    return list(chain.from_iterable(g.rules for g in chosen))


def robots_named(text: str, bot: str) -> bool:
    return any(g.names(bot) for g in robots_groups(text))


def robots_allowed(url: Column, rules: list[tuple[bool, str]]) -> Column:
    """Longest fitting pattern wins, allow on a tie; patterns and URLs are compared with escapes decoded."""
    rest = F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    target = F.try_url_decode(F.replace(F.when(rest == "", "/").otherwise(rest), F.lit("+"), F.lit("%2B")))
    target = F.coalesce(target, rest)
    verdict = F.lit(True)
    for allow, pattern in sorted(rules, key=lambda r: (len(r[1]), r[0])):
        body, end = (pattern[:-1], "$") if pattern.endswith("$") else (pattern, "")
        made = ".*".join(re.escape(unquote(p)) for p in body.split("*"))
        verdict = F.when(target.rlike(f"(?s)^{made}{end}"), F.lit(allow)).otherwise(verdict)
    return F.when(target == "/robots.txt", F.lit(True)).otherwise(verdict)


def robots_join(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """url, allowed of pages(origin, url) by rules(origin, allow, regex, size); origins without rules allow all."""
    hit = pages.join(rules, "origin").filter(F.expr("url rlike regex"))
    best = hit.groupBy("url").agg(F.max_by("allow", F.struct("size", "allow")).alias("allow"))
    return pages.join(best, "url", "left").select("url", F.coalesce("allow", F.lit(True)).alias("allowed"))


def origin_of(url: str) -> str:
    parts = urlsplit(url)
    return f"{parts.scheme}://{parts.netloc}"


# ---- page states

# Phrases of bot walls, in the order in which they name the reason; phrases of pages that are gone.
BLOCK_PHRASES = (
    "captcha",
    "are you a robot",
    "are you human",
    "verify you are human",
    "unusual traffic",
    "access denied",
    "request blocked",
    "just a moment",
    "attention required",
    "pardon our interruption",
)
GONE_STATUSES = (404, 410)
GONE_TITLE = "page not found"
GONE_TEXT = "this page no longer exists"
AI_CRAWLERS = (
    "GPTBot", "OAI-SearchBot", "ChatGPT-User", "ClaudeBot", "Claude-SearchBot", "Claude-User", "anthropic-ai",
    "PerplexityBot", "Perplexity-User", "Google-Extended", "Applebot-Extended", "CCBot", "Bytespider", "Meta-ExternalAgent",
)


def detect_block(status: Column, title: Column, text: Column) -> Column:
    """Why a page counts as refused, or null. Phrases count in the title and the first 2000 characters of short texts."""
    body = F.coalesce(text, F.lit(""))
    seen = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(body, 1, 2000)))
    reason = F.when(status.isin(403, 429), F.concat(F.lit("HTTP "), status.cast("string")))
    for phrase in BLOCK_PHRASES:
        reason = reason.when((F.length(body) < 3000) & seen.contains(phrase), F.lit(f"page says '{phrase}'"))
    return reason


def detect_dead(status: Column, title: Column, text: Column) -> Column:
    """Why a page counts as gone, or null."""
    head = F.lower(urls.strip(title))
    return (
        F.when(status.isin(*GONE_STATUSES), F.concat(F.lit("HTTP "), status.cast("string")))
        .when(head.startswith("404"), "title starts with 404")
        .when(head.contains(GONE_TITLE), f"title says '{GONE_TITLE}'")
        .when(F.lower(text).contains(GONE_TEXT), f"page says '{GONE_TEXT}'")
    )


def robots_ai_rules(text: str, base: str, bots: tuple[str, ...] = AI_CRAWLERS) -> list[tuple[str, bool, bool]]:
    """(bot, named, allowed on the home page) of each crawler."""
    home = base.rstrip("/") + "/"
    return [(bot, robots_named(text, bot), _allowed(home, robots_rules(text, bot))) for bot in bots]


def _allowed(url: str, rules: list[tuple[bool, str]]) -> bool:
    parts = urlsplit(url)
    target = unquote(parts.path or "/") + (f"?{unquote(parts.query)}" if parts.query else "")
    best = (-1, True)
    for allow, pattern in rules:
        body, end = (pattern[:-1], r"\Z") if pattern.endswith("$") else (pattern, "")
        made = ".*".join(re.escape(unquote(p)) for p in body.split("*"))
        if re.match(f"(?s:{made}){end}", target):
            best = max(best, (len(pattern), allow))
    return target == "/robots.txt" or best[1]
