"""The corpus pipeline: five stages, each a table of documents in and out, the last the token files."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelgraph.llm import decontaminate, languages, minhash, mixing, tokens
from parcelgraph.llm.shared import shared_folder, small_batches, table
from parcelgraph.session import ship_package


def _prepare(spark: SparkSession) -> None:
    ship_package(spark)
    small_batches(spark)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; a null text or one without a letter goes.  Learns from all given documents with a label."""
    _prepare(spark)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    found = languages.identify(rows, docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang"), key="row")
    return found.filter(F.col("lang_pred") != languages.UNKNOWN).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    _prepare(spark)
    return minhash.representatives(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document is there as a whole, once for each time that the mix takes it."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and reads them back: doc_id, start, n_tokens, ids_crc32."""
    _prepare(spark)
    folder = shared_folder(spark)
    return tokens.read_tokens(tokens.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), folder), folder)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mix", mixed),
    ("token_ids", token_ids),
]

#: Hashed orders, EM and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each stage's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
