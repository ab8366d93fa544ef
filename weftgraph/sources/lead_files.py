"""Lead files with the place of each row: every fault of every file is found before one is told, none of a value's text is kept.

Files are read one by one, as each has a header of its own; there is a handful of them, named by the configuration. A file may hold
values over several lines, so it is one task; rows are counted as the file has them, the header being row 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftgraph.functions.urls import clean_tag, conversion_url
from weftgraph.sources.tables import PERSONAL_VALUE, REQUIRED, LeadFileError, personal_columns

COUNTS = {"leads": "leads_most_recent_tag", "source_leads": "leads_source_initiative_tag", "paid_leads": "paid_click_leads"}
MOST_TOLD = 20  # faults that a message spells out; it tells the number of all
_ROWS = "file string, row long, lead_tag string, leads double, source_leads double, paid_leads double, page string"


def files_of(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files below the paths, each once, by name."""
    found = spark.read.format("binaryFile").load(paths).select("path").distinct().collect()  # names alone
    return sorted(r["path"] for r in found)


def _raw(spark: SparkSession, file: str) -> DataFrame:
    raw = spark.read.csv(file, header=True, multiLine=True, escape='"')
    raw = raw.toDF(*(c.strip().lstrip("﻿").lower() for c in raw.columns))
    return raw.withColumn("__row", F.monotonically_increasing_id() + 2)  # one file is one task


def _number(raw: DataFrame, column: str) -> tuple[Column, Column]:
    """(the count, whether it is none)."""
    if column not in raw.columns:
        return F.lit(0.0), F.lit(False)
    plain = F.trim(F.replace(F.col(column), F.lit(","), F.lit("")))
    blank = plain.isNull() | (plain == "")
    value = F.when(blank, 0.0).otherwise(plain.try_cast("double"))
    return value, value.isNull()


def read_lead_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, faults): rows(file, row, lead_tag, leads, source_leads, paid_leads, page), lead_tag null where a row has none, and
    faults(file, row, fault) of all files; faults of a header have row 1, and nothing else of such a file is read."""
    rows, faults = spark.createDataFrame([], _ROWS), spark.createDataFrame([], "file string, row long, fault string")
    for file in files_of(spark, paths):
        raw = _raw(spark, file)
        names = [c for c in raw.columns if c != "__row"]
        told = [f"column {c} identifies persons" for c in personal_columns(names)] + [f"column {c} is missing" for c in REQUIRED if c not in names]
        if told:
            faults = faults.unionByName(spark.createDataFrame([(file, 1, t) for t in told], "file string, row long, fault string"))
            continue
        personal = [F.when(F.col(f"`{c}`").rlike(PERSONAL_VALUE), F.lit(f"the value of {c} identifies persons")) for c in names]
        numbers = {name: _number(raw, column) for name, column in COUNTS.items()}
        wrong = [F.when(bad, F.lit(f"the value of {COUNTS[name]} is no number")) for name, (_, bad) in numbers.items()]
        found = raw.select(F.lit(file).alias("file"), F.col("__row").alias("row"), F.explode(F.array_compact(F.array(*personal, *wrong))).alias("fault"))
        page = conversion_url(F.col("main_conversion_page")) if "main_conversion_page" in names else F.lit(None).cast("string")
        tag = clean_tag(F.col("wt_mc_id"))
        rows = rows.unionByName(raw.select(F.lit(file).alias("file"), F.col("__row").alias("row"), F.when(tag != "", tag).alias("lead_tag"), *(v.alias(n) for n, (v, _) in numbers.items()), page.alias("page")))
        faults = faults.unionByName(found)
    return rows, faults


def checked_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of the files. Raises LeadFileError with the places of the first faults of all files, and how many there are."""
    rows, faults = read_lead_files(spark, paths)
    first = faults.orderBy("file", "row", "fault").limit(MOST_TOLD).collect()
    if first:
        lines = [f"{r['file'].rpartition('/')[2]} row {r['row']}: {r['fault']}" for r in first]
        more = faults.count() - len(first)
        raise LeadFileError("\n".join([*lines, *([f"and {more} more"] if more else [])]))
    return rows


def tag_totals(rows: DataFrame) -> DataFrame:
    """(leads, untagged): the leads of rows with a tag, and of those without, which no link can carry."""
    with_tag = F.col("lead_tag").isNotNull()
    return rows.agg(F.coalesce(F.sum(F.when(with_tag, F.col("leads"))), F.lit(0.0)).alias("leads"), F.coalesce(F.sum(F.when(~with_tag, F.col("leads"))), F.lit(0.0)).alias("untagged"))


def tag_pages(rows: DataFrame) -> DataFrame:
    """(lead_tag, page): the page with most leads of each tag, of equal ones the least."""
    sums = rows.filter("lead_tag is not null and page is not null").groupBy("lead_tag", "page").agg(F.sum("leads").alias("n"))
    return sums.groupBy("lead_tag").agg(F.min_by("page", F.struct(-F.col("n"), "page")).alias("page"))
