"""Folders of a crawl: pages as HTML files, and runs, which are a store with the configuration that it was made by."""

from __future__ import annotations

from dataclasses import dataclass

import yaml
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftgraph.functions import predicates as p, urls
from weftgraph.operators.crawl_store import meta
from weftgraph.operators.graph import Graph
from weftgraph.operators.store_graph import graph_from_store
from weftgraph.sources import html
from weftgraph.sources.config import Config, parse_config
from weftgraph.sources.store import Folder, Snapshot, Store
from weftgraph.sources.tables import completed


class RunError(ValueError):
    """A folder that is no run."""


def html_files(spark: SparkSession, path: str, base: str, glob: str = "*.html") -> DataFrame:
    """(url, html) of the HTML files below a folder; a file's address is base and its path below the folder."""
    top = Folder(spark, path).below()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    below = F.expr(f"substring(path, instr(path, '{top}') + {len(top)})")
    return raw.select(F.concat(F.lit(base), below).alias("url"), F.decode("content", "UTF-8").alias("html"))


def graph_from_html(raw: DataFrame, scope: p.Scope, win: p.Win) -> Graph:
    """The link graph of pages(url, html) as a crawl would store it: links within scope, wins recorded but not read."""
    normal = lambda c: urls.normalize_url(c, stripped=scope.strip_query_params)
    pages = raw.select(normal(F.col("url")).alias("url"), "html").withColumn("won", win.matches(F.col("url")))
    links = html.extract_links(pages.filter("not won").select("url", "html"), scope.strip_query_params, scope.region_selectors or None, scope.capture_params)
    status = F.when(F.col("won"), "not_fetched").otherwise("ok")
    stored = completed(pages.select("url", status.alias("status"), F.col("won").alias("win"), F.when(F.col("won"), "pattern").alias("win_source")), "pages")
    found = links.filter("url is not null").withColumns({"in_scope": scope.holds(F.col("url")), "operator": F.lit(False)})
    none = raw.sparkSession.createDataFrame([], "url string, final_url string")
    return graph_from_store(stored, found, none, win)


@dataclass
class Run:
    """A run opened at one version of its store."""

    config: Config
    tables: Snapshot

    def graph(self) -> Graph:
        table = self.tables.table
        return graph_from_store(table("pages"), table("links"), table("aliases"), self.config.win, self.config.data["win"]["require_form"])

    def entries(self) -> DataFrame:
        return self.tables.table("entries").orderBy("idx").select("label", F.col("node_url").alias("url"))


def open_run(spark: SparkSession, path: str, config: str | None = None, version: int | None = None) -> Run:
    """The run in a folder with `config.yaml` and `store`; config: another configuration file to read it by. What a crawl was
    told in place of its configuration (the fact crawl_overrides) holds."""
    folder = Folder(spark, path)
    try:
        text = folder.read("config.yaml") if config is None else Folder(spark, config.rpartition("/")[0] or ".").read(config.rpartition("/")[2])
    except Py4JJavaError:
        raise RunError(f"{config or path + '/config.yaml'} can't be read") from None
    store = Store(spark, f"{path}/store")
    if not store.versions():
        raise RunError(f"{path} has no store")
    found = parse_config(yaml.safe_load(text), config or f"{path}/config.yaml")
    tables = store.snapshot(version)
    found.data["crawl"].update(meta(tables, "crawl_overrides", {}) or {})
    return Run(found, tables)


def save_run(spark: SparkSession, path: str, config: str) -> Store:
    """A new run: its configuration's text and an empty store."""
    if not Folder(spark, path).publish("config.yaml", config):
        raise RunError(f"{path} is a run already")
    return Store(spark, f"{path}/store")


