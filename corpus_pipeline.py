"""A corpus pipeline over `documents`: language, near copies, benchmark leaks, mixing, token shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared folder
and reads it as the next stage's docs. All stages but the last keep the columns of documents.

Defined cases, for all stages: an empty table gives an empty table; columns besides doc_id, text, lang and source are carried
along unread, whatever their names, but for names that begin with two underscores; rows with a null doc_id are kept by the
stages that compare documents. Each stage says what it does with null texts, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weftgraph.llm import langid, minhash, mixing, tiling, tokenbin
from weftgraph.llm.queries import tokenizer_path
from weftgraph.llm.store import durable
from weftgraph.session import ship

#: Documents whose best language has a lower posterior are rejected, as are those without a letter.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language. The model learns from those that are not in its held-out fold.

    Null texts and texts without a letter are rejected; a null lang or doc_id is not learned from but judged; rows with equal
    texts are judged alike, as the verdict depends on the text alone."""
    ship(spark)
    model = langid.train(docs.filter(langid.fold() != langid.HELD_OUT), tokenizer_path("piece_bpe_32k.model"))
    return langid.accepted(docs, model, LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the least doc_id. Rows are judged by their own text: of equal
    doc_ids the least digest of the text stays, of equal texts under one doc_id the first row by the other columns' JSON, whatever
    their types. Rows with a null doc_id or without words are kept. Rows are told apart by doc_id and a digest of 256 bits."""
    ship(spark)
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    named = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), "text")
    ids = durable(named.groupBy("doc_id", "digest").agg(F.count("*").alias("copies")), "near-ids")
    several = ids.groupBy("doc_id").agg(F.count("*").alias("texts")).filter("texts > 1").select("doc_id")
    # texts that share a doc_id are numbered beyond all doc_ids, the others go by theirs; numbers hold as they are written
    beyond = F.lit((ids.agg(F.max("doc_id")).first()[0] or 0) + 1) + F.monotonically_increasing_id()
    odd = durable(ids.join(several, "doc_id").select("doc_id", "digest", beyond.alias("number")), "near-numbers")
    texts = named
    if not odd.isEmpty():
        ids, texts = (x.join(odd, ["doc_id", "digest"], "left") for x in (ids, named))
        ids, texts = (x.withColumn("row", F.coalesce("number", "doc_id")) for x in (ids, texts))
        texts = texts.select(F.col("row").alias("doc_id"), "text")
    else:
        ids = ids.withColumn("row", F.col("doc_id"))
    judged = minhash.near_duplicates(texts.select("doc_id", "text"))
    judged = judged.filter("n_shingles > 0").select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")).distinct()
    judged = durable(judged.join(ids, "row"), "near-rows")
    first = judged.groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("first")).select("first.doc_id", "first.digest")
    mine = ["__id", "__digest"]
    gone = judged.join(first, ["doc_id", "digest"], "left_anti").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    kept = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__digest": digest}).join(gone, mine, "left_anti")
    repeated = judged.filter("copies > 1").join(first, ["doc_id", "digest"], "left_semi").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    if repeated.isEmpty():
        return kept.select(docs.columns)
    order = Window.partitionBy(*mine).orderBy(F.sha2(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}), 256))
    one = kept.join(repeated, mine, "left_semi").withColumn("__n", F.row_number().over(order)).filter("__n = 1")
    return kept.join(repeated, mine, "left_anti").select(docs.columns).unionByName(one.select(docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of the benchmark. Null and empty texts leak nothing and are kept, as are all documents
    where the benchmark is empty; rows with equal texts are judged alike."""
    ship(spark)
    return tiling.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample that holds the target shares of sources, languages and topics. Null source and lang are a category of their
    own; texts without words count no tokens and are drawn like others of their cell; rows with equal doc_id of one cell are drawn together."""
    ship(spark)
    return mixing.sample(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, read back: doc_id, start, n_tokens, ids_crc32. A null text is the end id alone; equal doc_ids stand in
    the order of their texts; repeated rows are written repeated."""
    ship(spark)
    return tokenbin.tokenize(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_output),
]

#: The stages' models and sketches can't be expressed in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = durable(docs, "stage-" + "-".join(name.replace("/", " ").lower().split()))
    return docs
