"""Ingest of documents: cleaned, deduplicated, chunked, annotated, embedded."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions import legal
from lexspark.functions.text import clean_text, content_hash, extraction_quality, joined, strip, word_count
from lexspark.functions.vectors import DIMENSION, repeated_hash_embedding, unit_hash_embedding
from lexspark.operators.chunking import chunk_documents, enhanced_chunks
from lexspark.operators.collection import deduplicate
from lexspark.operators.lineage import settle, spread

VERSION = "4.0"


def process_documents(docs: DataFrame, as_of: datetime) -> DataFrame:
    """docs (doc_id, text, source, ...) with cleaned text and the metadata of a processed document."""
    rows = spread(docs).withColumn("text", clean_text(F.col("text")))
    text = F.col("text")
    return rows.withColumns(
        {
            "document_hash": content_hash(text), "processed_at": F.lit(as_of).cast("timestamp"), "legal_document_type": legal.document_type(text),
            "legal_terms": joined(legal.legal_terms(text)), "processing_version": F.lit(VERSION), "word_count": word_count(text),
            "char_count": F.length(text), "extraction_quality": extraction_quality(text),
        }
    )


def ingest(docs: DataFrame, as_of: datetime, size: int = 1000, overlap: int = 200, unit: bool = True) -> DataFrame:
    """The chunk table of docs (doc_id, text, source): processed, one row per text, chunked, annotated and
    embedded by hash. Blank documents are left out. The processed documents are written once, so that
    cleaning is not done again for the search of copies."""
    rows = deduplicate(settle(process_documents(docs.filter(strip(F.col("text")) != ""), as_of), "processed"))
    kept = rows.select("doc_id", "source", "document_hash", "legal_document_type", "legal_terms", "processed_at", "text")
    text = F.col("text")
    chunks = chunk_documents(kept, size, overlap).withColumn("legal_score", legal.legal_score(text))
    return chunks.withColumns(
        {
            "section_type": legal.section_type(text), "complexity_score": legal.complexity_score(text, F.col("legal_score")),
            "entities": legal.entities(text), "embedding": unit_hash_embedding(text) if unit else repeated_hash_embedding(text),
            "embedding_model": F.lit("unit_hash" if unit else "repeated_hash"), "embedding_dimension": F.lit(DIMENSION),
        }
    )


def analyse(docs: DataFrame, repeat_paragraphs: bool = True) -> tuple[DataFrame, DataFrame]:
    """(chunks, documents) of the enhanced form: annotated chunks with the document's citations that occur
    in them, and one row of analysis per document."""
    text = F.col("text")
    chunks = enhanced_chunks(docs, repeat_paragraphs).withColumn("legal_score", legal.legal_score(text))
    scores = ["legal_score", "complexity_score"]
    chunks = chunks.withColumn("complexity_score", legal.complexity_score(text, F.col("legal_score")))
    per = chunks.groupBy("doc_id").agg(F.avg("complexity_score").alias("legal_complexity"), F.count(F.lit(1)).alias("chunks_created"), F.sum("chunk_size").alias("total_tokens"))
    cited = docs.select("doc_id", F.array_distinct(legal.citations(F.coalesce("text", F.lit("")))).alias("all"))
    chunks = chunks.join(cited, "doc_id").withColumns(
        {
            "precedents": F.filter("all", lambda c: text.contains(c)), "legal_entities": legal.entities(text),
        }
    ).drop("all").select(*[c for c in chunks.columns if c not in scores], "precedents", "legal_entities", *scores)
    found = docs.select("doc_id", legal.citations(text).alias("c"), legal.vocabulary_terms(text).alias("t"), "text")
    rows = found.select(
        "doc_id", (F.size("c") + F.size("t")).alias("total_entities"), F.size("c").alias("precedent_count"), F.slice("t", 1, 10).alias("key_legal_terms"),
        F.slice("c", 1, 5).alias("citations_found"), legal.document_class(text, F.size("c")).alias("document_class"),
    )
    documents = rows.join(per, "doc_id", "left").withColumns({"chunks_created": F.coalesce("chunks_created", F.lit(0)), "total_tokens": F.coalesce("total_tokens", F.lit(0))})
    return chunks, documents.withColumn("suggestions", legal.query_suggestions(F.col("document_class"), F.col("key_legal_terms")))


def roll_up(processed: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """(key, value, n): documents by type, by legal term, and by the section types of their chunks.

    processed: legal_document_type, legal_terms. chunks: doc_id, section_type.
    """
    kinds = processed.select(F.lit("legal_document_type").alias("key"), F.col("legal_document_type").alias("value"))
    terms = processed.select(F.lit("legal_term").alias("key"), F.explode(F.filter(F.split("legal_terms", ", "), lambda t: t != "")).alias("value"))
    rows = kinds.unionByName(terms)
    if chunks is not None:
        rows = rows.unionByName(chunks.select("doc_id", "section_type").distinct().select(F.lit("section_type").alias("key"), F.col("section_type").alias("value")))
    return rows.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
