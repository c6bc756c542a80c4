"""Batch question answering over a chunk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import preprocess_legal
from lexspark.functions.vectors import unit_hash_embedding
from lexspark.operators.retrieval import answer_questions, nearest_chunks, with_chunks


def embed_questions(questions: DataFrame) -> DataFrame:
    """(query_id, question, embedding) with the chunks' own normalisation and embedding."""
    return questions.select("query_id", "question", unit_hash_embedding(preprocess_legal(F.col("question"))).alias("embedding"))


def answer(questions: DataFrame, chunks: DataFrame, k: int = 5, metric: str = "cosine", where: Column | None = None, weights: tuple[float, float, float] | None = None) -> DataFrame:
    """One row per question: sources, confidence and answer."""
    found = nearest_chunks(embed_questions(questions), chunks, k, metric, weights, where)
    return answer_questions(questions, with_chunks(found, chunks, ["text", "source"]))
