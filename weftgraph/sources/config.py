"""The configuration of a site, read from YAML and checked as a whole: all problems are told at once, each with its place."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import yaml

from weftgraph.functions import predicates as p, urls
from weftgraph.sources.tables import ConfigError

# The word that marks what is still to be filled in, and the sections with their fields and defaults.
PLACEHOLDER = "REPLACE-ME"
_SLUG = re.compile(r"[a-z0-9]+(?:[-_][a-z0-9]+)*")


@dataclass(frozen=True)
class Text:
    default: str | None = None
    needed: bool = False
    slug: bool = False
    choices: tuple[str, ...] = ()
    regex: bool = False

    def check(self, value: object, at: str) -> Iterator[str]:
        if value is None and not self.needed:
            return
        if not isinstance(value, str):
            yield f"{at}: should be text"
        elif self.needed and not value.strip():
            yield f"{at}: must not be empty"
        elif self.slug and not _SLUG.fullmatch(value):
            yield f"{at}: {value!r} should be lower-case letters, digits, hyphens and underscores"
        elif self.choices and value not in self.choices:
            yield f"{at}: {value!r} is none of {', '.join(self.choices)}"
        elif self.regex:
            try:
                re.compile(value)
            except re.error as error:
                yield f"{at}: {value!r}: {error}"


@dataclass(frozen=True)
class Number:
    default: float
    least: float
    whole: bool = True

    def check(self, value: object, at: str) -> Iterator[str]:
        kinds = (int,) if self.whole else (int, float)
        if isinstance(value, bool) or not isinstance(value, kinds):
            yield f"{at}: should be a {'whole ' if self.whole else ''}number"
        elif value < self.least:
            yield f"{at}: should be {self.least:g} at least"


@dataclass(frozen=True)
class Flag:
    default: bool

    def check(self, value: object, at: str) -> Iterator[str]:
        if not isinstance(value, bool):
            yield f"{at}: should be true or false"


@dataclass(frozen=True)
class Many:
    of: object
    least: int = 0
    default: tuple = ()

    def check(self, value: object, at: str) -> Iterator[str]:
        if not isinstance(value, (list, tuple)):
            yield f"{at}: should be a list"
            return
        if len(value) < self.least:
            yield f"{at}: needs {self.least} at least"
        for k, item in enumerate(value):
            yield from self.of.check(item, f"{at}.{k}")


class Section:
    def __init__(self, needed: bool = False, **fields):
        self.fields, self.needed, self.default = fields, needed, None

    def check(self, value: object, at: str) -> Iterator[str]:
        if value is None and not self.needed:
            return
        if not isinstance(value, dict):
            yield f"{at or 'the file'}: should be a mapping"
            return
        for name in value.keys() - self.fields.keys():
            yield f"{_at(at, str(name))}: is not known"
        for name, field in self.fields.items():
            if name in value:
                yield from field.check(value[name], _at(at, name))
            elif getattr(field, "needed", False) or getattr(field, "least", 0) and isinstance(field, Many):
                yield f"{_at(at, name)}: is missing"

    def filled(self, value: dict | None) -> dict:
        """The section with defaults for what is not given."""
        given, out = value or {}, {}
        for name, field in self.fields.items():
            here = given.get(name)
            if isinstance(field, Section):
                out[name] = field.filled(here)
            elif isinstance(field, Many) and isinstance(field.of, Section):
                out[name] = [field.of.filled(x) for x in here or ()]
            else:
                out[name] = (list(field.default) if isinstance(field, Many) else field.default) if here is None else here
        return out


def _at(place: str, name: str) -> str:
    return f"{place}.{name}" if place else name


_need, _texts, _globs = Text(needed=True), Many(Text(needed=True)), Many(Text(needed=True))
SHAPE = Section(
    needed=True,
    client=Section(needed=True, name=_need, slug=Text(needed=True, slug=True)),
    scope=Section(
        needed=True, allowed_domains=Many(_need, 1), locale_include=_texts, locale_exclude=_texts, locale_hosts=_texts, strip_query_params=_texts, capture_params=_texts,
        include_patterns=Many(Text(needed=True, regex=True)), region_selectors=Section(nav=_texts, header=_texts, footer=_texts),
    ),
    win=Section(
        needed=True, name=_need, url_patterns=_globs, classes=Many(Section(needed=True, name=_need, patterns=Many(Text(needed=True, regex=True), 1), any_win=Flag(True))),
        known_pages=Many(Section(needed=True, url=_need, type=_need)), exclude_patterns=_globs, match=Text("exact", choices=("exact", "case_insensitive_path")),
        form_selector=Text(), require_form=Flag(False), near_miss_keywords=_texts,
    ),
    campaigns=Many(Section(needed=True, id=Text(needed=True, slug=True), name=_need, platform=_need, ad_copy=_need, ad_urls=_texts, entry_links=Many(Section(needed=True, label=_need, url=_need), 1), external_seeds=Text()), 1),
    crawl=Section(
        max_depth=Number(8, 1), max_pages=Number(300, 1), delay_ms=Number(1500, 0), headed=Flag(True), slow_mo_ms=Number(400, 0), respect_robots=Flag(True), page_timeout_ms=Number(30_000, 1000),
        screenshot=Flag(True), backoff_s=Number(0, 0, whole=False), backoff_retries=Number(2, 0), host_block_limit=Number(5, 1),
    ),
    leads=Section(
        files=Many(Section(needed=True, path=_need)), join=Section(key=Text("wt_mc_id"), fallback=Text("strip_numeric_suffix")),
        allocation=Text("even_split_across_source_pages", choices=("even_split_across_source_pages",)), min_cell=Number(5, 1), archetype_pattern=Text(regex=True),
    ),
    health=Section(home_url=Text(), ai_crawlers=_texts, check_site_files=Flag(True)),
)


@dataclass(frozen=True)
class Config:
    data: dict

    @property
    def scope(self) -> p.Scope:
        held = {k: v for k, v in self.data["scope"].items() if k != "region_selectors"}
        return p.Scope(**{k: tuple(v) for k, v in held.items()}, region_selectors={k: tuple(v) for k, v in self.data["scope"]["region_selectors"].items() if v})

    @property
    def win(self) -> p.Win:
        w = self.data["win"]
        return p.Win(
            w["name"], tuple(w["url_patterns"]), tuple(p.WinClass(c["name"], tuple(c["patterns"]), c["any_win"]) for c in w["classes"]),
            tuple((k["url"], k["type"]) for k in w["known_pages"]), tuple(w["exclude_patterns"]), w["match"] != "exact", tuple(w["near_miss_keywords"]),
        )

    def campaign(self, name: str) -> dict:
        for c in self.data["campaigns"]:
            if c["id"] == name:
                return c
        raise ConfigError(f"no campaign {name!r} in the configuration (known: {', '.join(c['id'] for c in self.data['campaigns'])})")

    def entries(self, name: str) -> list[tuple[str, str | None]]:
        """(label, normal URL) of a campaign's entry links."""
        strip = tuple(self.data["scope"]["strip_query_params"])
        return [(e["label"], urls.normal_url(e["url"], None, strip)) for e in self.campaign(name)["entry_links"]]

    # ---- what is allowed but probably meant otherwise

    def placeholders(self, campaign: str | None = None) -> list[str]:
        """Places that are still to be filled in; with a campaign those that keep it from being crawled."""
        found = list(_marked(self.data, ""))
        if campaign is None:
            return found
        at = [c["id"] for c in self.data["campaigns"]].index(self.campaign(campaign)["id"])
        return [x for x in found if x.startswith(("win.", f"campaigns[{at}]"))]

    def warnings(self) -> list[str]:
        told = [f"{x} still contains the placeholder {PLACEHOLDER!r}" for x in self.placeholders()]
        domains = {d.lower() for d in self.data["scope"]["allowed_domains"]}
        for pattern in self.data["win"]["url_patterns"]:
            host = re.match(r"[a-z]+://([^/?#:]*)", pattern.lower())
            if not pattern.startswith("re:") and host and host[1] and not set("*?[") & set(host[1]) and host[1] not in domains:
                told.append(f"win pattern {pattern!r} is on a host that is not in scope.allowed_domains, so no crawl reaches it")
        excluded = [re.compile(x[3:] if x.startswith("re:") else urls.glob_body(x), re.DOTALL) for x in self.data["win"]["exclude_patterns"]]
        for page in self.data["win"]["known_pages"]:
            address = urls.Address.read(page["url"])
            if address is None or address.host not in domains:
                told.append(f"known page {page['url']!r} is not on an allowed domain, so no link reaches it")
            if any(x.fullmatch(page["url"]) for x in excluded):
                told.append(f"known page {page['url']!r} is excluded, so it is no win")
        for c in self.data["campaigns"]:
            labels: dict[str | None, str] = {}
            for label, url in self.entries(c["id"]):
                if labels.setdefault(url, label) is not label:
                    told.append(f"campaign {c['id']!r}: entry links {labels[url]!r} and {label!r} are one URL, {url}")
        return told


def _marked(value: object, at: str) -> Iterator[str]:
    if isinstance(value, str) and PLACEHOLDER in value:
        yield at
    elif isinstance(value, dict):
        for name, item in value.items():
            yield from _marked(item, _at(at, name))
    elif isinstance(value, (list, tuple)):
        for k, item in enumerate(value):
            yield from _marked(item, f"{at}[{k}]")


def _cross_checks(data: dict) -> Iterator[str]:
    """Problems between fields of a configuration whose fields are each right."""
    win = data["win"]
    if not (win["url_patterns"] or win["known_pages"] or win["classes"] or win["form_selector"]):
        yield "win: needs url_patterns, known_pages, classes or form_selector"
    if win["require_form"] and not win["form_selector"]:
        yield "win: require_form needs form_selector"
    for name in ("url_patterns", "exclude_patterns"):
        for k, pattern in enumerate(win[name]):
            if pattern.startswith("re:"):
                yield from Text(regex=True).check(pattern[3:], f"win.{name}.{k}")
    ids = [c["id"] for c in data["campaigns"]]
    yield from (f"campaigns: {x!r} is used twice" for x in sorted({x for x in ids if ids.count(x) > 1}))
    for k, c in enumerate(data["campaigns"]):
        for n, e in enumerate(c["entry_links"]):
            if PLACEHOLDER not in e["url"] and urls.normal_url(e["url"]) is None:
                yield f"campaigns.{k}.entry_links.{n}.url: {e['url']!r} is no http(s) URL"
    pattern = data["leads"]["archetype_pattern"]
    if pattern and "archetype" not in re.compile(pattern).groupindex:
        yield "leads.archetype_pattern: needs a group named archetype"


def parse_config(data: object, source: str = "configuration") -> Config:
    problems = list(SHAPE.check(data, ""))
    if not problems:
        config = Config(SHAPE.filled(data))
        problems = list(_cross_checks(config.data))
    if problems:
        raise ConfigError("\n".join([f"{source} is invalid:", *(f"  - {x}" for x in problems)]))
    return config


def load_config(path: str) -> Config:
    try:
        data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except OSError as error:
        raise ConfigError(f"cannot read {path}: {error.strerror or error}") from None
    except yaml.YAMLError as error:
        raise ConfigError(f"{path} is not YAML: {error}") from None
    return parse_config(data, str(path))


def find_taxonomy(slug: str, explicit: str | None = None, configs: str = "configs", run: str | None = None) -> str | None:
    """The taxonomy file to use: the named one, that of the client, or the copy kept with a run."""
    options = [explicit, f"{configs}/{slug}.entities.yaml", f"{run}/entities.yaml" if run else None]
    return next((x for x in options if x and Path(x).is_file()), None)
