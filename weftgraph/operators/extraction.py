"""Extraction over a stored crawl: text that repeats across the site goes, entities are tagged, and both are done again only for
pages that something changed for.

Runs of words are known by 128-bit hashes, made in one pass over a page. Pages' runs are counted by packed hashes (runs.py), and exactly only
where they can be common, so that neither shuffles nor the store hold a row for each word. The store keeps the common runs, which a later
extraction counts anew and compares, and which text of each page was read last. What headings were common then is read from the version
of the store that the last extraction saw.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from weftgraph.functions import urls
from weftgraph.operators import crawl_store
from weftgraph.operators.entities import SEPARATOR, common_headings, tag_entities
from weftgraph.operators.runs import BLOCKS, Sieve, pack, sieve
from weftgraph.sources.store import Change, Store
from weftgraph.storage import drop, durable, releasing

_EDGES = re.compile(r"^\W+|\W+$")
_PAGE = "url string, title string, headings array<string>, body string"


@dataclass(frozen=True)
class Settings:
    """What an extraction depends on beside the taxonomy."""

    window: int = 8
    window_pages: int = 30
    heading_pages: int = 5
    weights: tuple[float, float, float] = (3.0, 2.0, 1.0)
    body_cap: int = 5
    least_score: float = 1.0

    def print_of(self, taxonomy: list) -> str:
        return hashlib.sha256(json.dumps([asdict(self), taxonomy, "common runs"], sort_keys=True).encode()).hexdigest()


def source_pages(pages: DataFrame) -> DataFrame:
    """(url, title, headings, body, digest) of the pages that were loaded well."""
    texts = F.coalesce(F.transform("headings", lambda h: F.coalesce(h["text"], F.lit(""))), F.array().cast("array<string>"))
    rows = pages.filter("status = 'ok'").select("url", F.coalesce("title", F.lit("")).alias("title"), texts.alias("headings"), F.coalesce("body_text", F.lit("")).alias("body"))
    return rows.withColumn("digest", F.sha2(F.to_json(F.struct("title", "headings", "body")), 256))


def words_of(body: str, headings: list[str]) -> list[str]:
    """The body's words without the page's headings, the longest taken out first."""
    for heading in sorted({h.strip() for h in headings if h.strip()}, key=lambda h: (-len(h), h)):
        body = body.replace(heading, f" {SEPARATOR} ")
    return body.split()


def runs_of(words: list[str], window: int) -> list[bytes]:
    """A hash for each run of `window` neighbouring words."""
    keys = [_EDGES.sub("", w.lower()) for w in words]
    return [xxhash.xxh3_128_digest("\x1f".join(keys[k : k + window])) for k in range(len(keys) - window + 1)]


def _runs_by_page(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(url, runs, their first 64 bits) of each page that has runs."""
    for batch in batches:
        for url, headings, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if found := runs_of(words_of(body, headings), window):
                yield url, found, np.frombuffer(b"".join(found), ">u8")[::2].astype(np.uint64)


def possible_runs(pages: DataFrame, window: int, least_pages: int) -> Sieve:
    """What lets every run through that is on that many pages, and few others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pack(np.unique(hashes) for _, _, hashes in _runs_by_page(batches, window))

    return sieve(pages.select("url", "headings", "body").mapInArrow(count, BLOCKS), least_pages)


def possible_runs_of(few: DataFrame) -> Sieve:
    """What lets these runs through, and few others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pack(np.frombuffer(b"".join(batch["run"].to_pylist()), ">u8")[::2].astype(np.uint64) for batch in batches)

    return sieve(few.select("run").mapInArrow(count, BLOCKS), 1)


def page_runs(pages: DataFrame, window: int, often: Sieve | None = None) -> DataFrame:
    """(run, url, places): where each page has each run, or each that passes `often`."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for url, found, hashes in _runs_by_page(batches, window):
            places: dict[bytes, list[int]] = {}
            for k in range(len(found)) if often is None else np.flatnonzero(often.passes(hashes)).tolist():
                places.setdefault(found[k], []).append(k)
            if places:
                columns = [pa.array(list(places), pa.binary()), pa.array([url] * len(places), pa.string()), pa.array(list(places.values()), pa.list_(pa.int32()))]
                yield pa.record_batch(columns, names=["run", "url", "places"])

    return pages.select("url", "headings", "body").mapInArrow(find, "run binary, url string, places array<int>")


def without_repeats(pages: DataFrame, runs: DataFrame, frequent: DataFrame, headings: DataFrame, window: int) -> DataFrame:
    """pages(url, title, headings, body) without words that stand in frequent(run), and without frequent headings(heading); with
    dropped_words. runs: page_runs() of these pages."""
    hit = runs.join(frequent, "run", "left_semi").groupBy("url").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("marks"))
    named = pages.select("url", F.posexplode("headings").alias("at", "h")).withColumn("heading", urls.collapse(F.lower("h")))
    kept = named.filter("heading <> ''").join(headings, "heading", "left_anti").groupBy("url").agg(F.array_sort(F.collect_list(F.struct("at", "h"))).alias("x"))
    rows = pages.select("url", "title", "headings", "body").join(hit, "url", "left").join(kept.select("url", F.transform("x", lambda x: x["h"]).alias("kept")), "url", "left")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url, title, headings, body, marks, kept in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(body, headings)
                gone = bytearray(len(words))
                for k in marks or ():
                    gone[k : k + window] = b"\x01" * window
                left: list[str] = []
                for k, word in enumerate(words):
                    if not gone[k]:
                        if left and gone[k - 1]:
                            left.append(SEPARATOR)
                        left.append(word)
                out.append((url, title, kept or [], " ".join(left), sum(gone)))
            names = ("url", "title", "headings", "body", "dropped_words")
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int64())
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=list(names))

    return rows.select("url", "title", "headings", "body", "marks", "kept").mapInArrow(strip, _PAGE + ", dropped_words long")


def extract(store: Store, change: Change, taxonomy: list[tuple[str, str, list[str]]], settings: Settings = Settings()) -> dict[str, int]:
    """Bring page_entities up to date in a change of the store; how many pages there are, were read again, and lost tags.

    All is done anew at first and where settings or taxonomy changed. Else pages with another text are read, and pages
    that hold a run of words or a heading which has become common, or is so no more.
    """
    spark = change.folder.spark
    with releasing(spark):
        now = durable(source_pages(change.table("pages")), "extract-pages")
    print_, before = settings.print_of(taxonomy), crawl_store.meta(change, "entities", {}) or {}
    known = change.table("extractions")
    fresh = before.get("print") != print_ or before.get("version") not in store.versions()
    changed = now.select("url", "digest").join(known, ["url", "digest"], "left_anti").select("url")
    if not fresh:
        gone = durable(known.select("url").join(now.select("url"), "url", "left_anti"), "extract-gone")
        changed = durable(changed, "extract-changed")
        if changed.isEmpty() and gone.isEmpty():
            told = {"pages": now.count(), "read": 0, "gone": 0}
            drop(now)
            return told
    with releasing(spark):
        headings = durable(common_headings(now, settings.heading_pages), "extract-headings")
        places = durable(page_runs(now, settings.window, possible_runs(now, settings.window, settings.window_pages)), "extract-places")
        counted = places.groupBy("run").agg(F.count("*").alias("pages")).filter(F.col("pages") >= settings.window_pages)
        frequent = durable(counted.select("run"), "extract-common")
    if fresh:
        again, gone, held = now, known.select("url").limit(0), places
        change.replace("common_runs", frequent)
        if change.files("run_counts"):  # of a store that kept all runs
            change.replace("run_counts", change.table("run_counts").limit(0))
    else:
        with releasing(spark):
            stored = change.table("common_runs")
            risen = durable(frequent.join(stored, "run", "left_anti"), "extract-risen")
            fallen = durable(stored.join(frequent, "run", "left_anti"), "extract-fallen")
            old = store.snapshot(before["version"]).table("pages")
            was = common_headings(source_pages(old), settings.heading_pages)
            other = durable(was.join(headings, "heading", "left_anti").unionByName(headings.join(was, "heading", "left_anti")), "extract-turned")
            touched = changed.unionByName(places.join(risen, "run", "left_semi").select("url"))
            if not fallen.isEmpty():  # their pages are looked for by themselves, as they are no longer told
                touched = touched.unionByName(page_runs(now, settings.window, possible_runs_of(fallen)).join(fallen, "run", "left_semi").select("url"))
            if not other.isEmpty():
                own = now.select("url", F.explode("headings").alias("h")).select("url", urls.collapse(F.lower("h")).alias("heading"))
                touched = touched.unionByName(own.join(other, "heading", "left_semi").select("url"))
            touched = durable(touched.distinct(), "extract-touched")
            again = durable(now.join(touched, "url", "left_semi"), "extract-again")
            held = places.join(touched, "url", "left_semi")
        if not (risen.isEmpty() and fallen.isEmpty()):
            change.exchange("common_runs", fallen, ["run"], risen)
    with releasing(spark):
        clean = durable(without_repeats(again, held, frequent, headings, settings.window), "extract-clean")
    drop(places)
    tags = durable(tag_entities(clean, taxonomy, settings.weights, settings.body_cap, settings.least_score), "extract-tags")
    dropped = clean.agg(F.coalesce(F.sum("dropped_words"), F.lit(0))).first()[0]
    drop(clean)
    if fresh:
        change.replace("page_entities", tags)
        change.replace("extractions", now.select("url", "digest"))
    else:
        out = again.select("url").unionByName(gone)
        change.exchange("page_entities", out, ["url"], tags)
        change.exchange("extractions", out, ["url"], again.select("url", "digest"))
    crawl_store.set_meta(change, entities={"print": print_, "version": change.version + 1})  # the one that this change becomes
    told = {"pages": now.count(), "read": again.count(), "gone": gone.count(), "dropped_words": dropped}
    for table in {id(t): t for t in (now, again)}.values():
        drop(table)
    return told
