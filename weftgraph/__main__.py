"""Command line: `validate CONFIG`; `analyze CONFIG CAMPAIGN STORE OUT` over the stored tables of a crawl; and over a run's folder
`status RUN`, `report RUN OUT`, `repair RUN`, `seeds RUN CAMPAIGN FILE`, `extract RUN TAXONOMY`, `vacuum RUN`. What changes a run is
one version of its store."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from pathlib import Path

from weftgraph.sources.config import Config, load_config
from weftgraph.sources.tables import ConfigError, load_taxonomy, read_seeds


def validate(config: Config) -> int:
    for line in config.warnings():
        print(f"warning: {line}")
    print(f"{config.data['client']['name']}: {len(config.data['campaigns'])} campaigns, configuration is valid")
    return 0


def _session():
    from pyspark.sql import SparkSession

    from weftgraph.session import ship

    return ship(SparkSession.builder.appName("weftgraph").getOrCreate())


def _write_report(graph, entries, name: str, out: str) -> int:
    from weftgraph.operators import analysis

    document = analysis.report(graph, entries, analysis.analyze(graph, entries))
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "report.json").write_text(analysis.report_json(document), encoding="utf-8")
    (folder / "report.md").write_text(analysis.report_markdown(document, name), encoding="utf-8")
    return 0


def analyze(config: Config, campaign: str, store: str, out: str) -> int:
    from weftgraph.operators.store_graph import graph_from_store

    spark = _session()
    pages, links, aliases = (spark.read.parquet(f"{store}/{n}.parquet") for n in ("pages", "links", "aliases"))
    graph = graph_from_store(pages, links, aliases, config.win, config.data["win"]["require_form"])
    entries = spark.createDataFrame([(u,) for _, u in config.entries(campaign) if u], "url string").distinct()
    return _write_report(graph, entries, config.data["client"]["name"], out)


# ---- over a run


def status(run: str) -> int:
    from weftgraph.operators.upkeep import status_counts
    from weftgraph.sources.runs import open_run

    found = open_run(_session(), run)
    print(f"version {found.tables.version}")
    for row in status_counts(found.tables.table("pages")).orderBy("status").collect():
        print(f"pages {row['status']}: {row['pages']}")
    for name in ("links", "entries", "queue", "page_tags", "page_entities"):
        print(f"{name}: {found.tables.table(name).count()}")
    return 0


def report(run: str, out: str) -> int:
    from weftgraph.sources.runs import open_run

    found = open_run(_session(), run)
    return _write_report(found.graph(), found.entries().select("url").distinct(), found.config.data["client"]["name"], out)


def _change(run: str, note: str, work: Callable) -> int:
    from weftgraph.sources.runs import open_run
    from weftgraph.sources.store import Store

    spark = _session()
    found, store = open_run(spark, run), Store(spark, f"{run}/store")
    change = store.change()
    told = work(found.config, store, change)
    version = change.publish(note)
    print(f"version {version}: " + ", ".join(f"{k.replace('_', ' ')} {v}" for k, v in told.items()))
    return 0


def repair(run: str) -> int:
    from weftgraph.functions.urls import normalize_url
    from weftgraph.operators import repairs

    def work(config: Config, _, change) -> dict:
        scope = config.scope
        return repairs.repair(change, lambda url: normalize_url(url, stripped=scope.strip_query_params), scope.capture_params)

    return _change(run, "repair", work)


def seeds(run: str, campaign: str, file: str) -> int:
    from pyspark.sql import functions as F

    from weftgraph.operators import seeds as s

    def work(config: Config, _, change) -> dict:
        spark, chosen = change.folder.spark, config.campaign(campaign)
        rows = read_seeds(spark, file).withColumn("id", F.monotonically_increasing_id())  # in the order of the file
        ads = spark.createDataFrame([(u,) for u in chosen.get("ad_urls") or []], "url string")
        found = s.ingest(change, rows, config.scope, chosen["platform"], ads, config.win)
        return {r["state"]: r["count"] for r in found.landing.groupBy("state").count().collect()}

    return _change(run, f"seeds of {file}", work)


def extract(run: str, taxonomy: str) -> int:
    from weftgraph.operators import extraction

    terms = load_taxonomy(taxonomy)
    return _change(run, f"entities of {taxonomy}", lambda _, store, change: extraction.extract(store, change, terms))


def vacuum(run: str) -> int:
    from weftgraph.sources.store import Store

    print(f"{Store(_session(), f'{run}/store').vacuum()} files removed")
    return 0


COMMANDS: dict[str, tuple[tuple[str, ...], Callable]] = {
    "validate": (("config",), validate), "analyze": (("config", "campaign", "store", "out"), analyze), "status": (("run",), status), "report": (("run", "out"), report),
    "repair": (("run",), repair), "seeds": (("run", "campaign", "file"), seeds), "extract": (("run", "taxonomy"), extract), "vacuum": (("run",), vacuum),
}


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weftgraph", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (places, _) in COMMANDS.items():
        command = commands.add_parser(name)
        for place in places:
            command.add_argument(place)
    given = vars(parser.parse_args(arguments))
    places, work = COMMANDS[given["command"]]
    values = [given[place] for place in places]
    try:
        if places[0] == "config":
            values[0] = load_config(values[0])
        if given["command"] == "analyze" and (blocked := values[0].placeholders(given["campaign"])):
            raise ConfigError(f"still to be filled in: {', '.join(blocked)}")
        return work(*values)
    except ValueError as error:  # of a configuration, a run, a taxonomy or a file
        print(error, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
