"""A training corpus from raw documents: quality rules, language ID, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecrest.llm import langid, packing, rules, simhash
from sievecrest.llm.queries import document_tokenizer
from sievecrest.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return rules.apply_rules(docs, "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled part of these very documents teaches.

    Four fifths of the labelled documents teach, the others set the level of their language. Null texts
    and texts without a letter go; without any labelled document all stay.
    """
    training = langid.training_row(F.col("doc_id"))
    filters = langid.train_filters(docs.where(training), "text", "lang")
    levels = langid.language_levels(docs.where(~training), filters, "text", "lang")
    return langid.keep_identified(docs, filters, "text", levels=levels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_per_component(docs, "doc_id", "text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2,048 tokens."""
    return packing.pack_documents(docs, "doc_id", "text", document_tokenizer())


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The stages cut texts by a tokenizer and hash them bit by bit: SQL cannot express that.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
