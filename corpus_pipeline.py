"""The documents of a corpus made into training sequences: language, quality, near copies, personal data,
packing. Each stage is written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexspark.llm import langid, packing, pii, quality, simhash
from lexspark.llm.queries import vocabulary
from lexspark.operators.lineage import settle

#: A document stays if more than this share of its words is in one language.
ONE_LANGUAGE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or without a prevailing language go, null and empty texts among them.

    Every row is judged by its own text, so repeated rows stay or go together. Without a learned language, as in
    an empty table, no row stays."""
    model = langid.train_languages(docs.filter(~langid.held_out()))
    return langid.filter_languages(docs, model, ONE_LANGUAGE)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the counts or the likelihood ratio go, null and empty texts among them.

    A ratio right at the threshold passes; repeated rows are judged alike; without labels of both kinds only the
    counts decide. An empty table stays empty."""
    model = quality.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.filter_quality(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that of the least doc_id; rows without an id stay.

    Fingerprints within two bits (operator 5) join copies first; chains of pairs of similarity 0.8 are then
    completed. Rows of one id and different texts are judged each by its own text, of repeated rows one stays,
    null and empty texts are copies of each other. An empty table stays empty."""
    return simhash.drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets in texts give way to their kind in brackets.

    Null texts stay null, empty ones empty; repeated rows are treated alike; no row goes."""
    return pii.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents by sequence, with their ids.

    Null and empty texts are an end id alone; repeated rows are packed each on their own; null doc_ids stay null."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("language", language),
    ("quality", rules),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("packing", sequences),
]

#: No stage but the first two has an equivalent in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
