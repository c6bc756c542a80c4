"""Retrieval for tables of questions: vector search, re-ranking, confidence, context and answers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.functions.text import strip
from lexspark.operators.lineage import settle

#: Bytes of query vectors that are broadcast at once; more are searched in several passes over the chunks.
QUERY_BYTES = 64 << 20
#: Queries whose scores of one batch of chunks are held at once, and results that are handed on at once.
SLICE, ROWS = 256, 10_000
#: Sentences of answers and marks of contexts, here and below, are fixed values.
NO_ANSWER = "I couldn't find any relevant documents to answer your question."


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length out of their Arrow buffer."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _kernel(matrix: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Queries x chunks: cosine similarity (0 without length) or one less the squared distance."""
    if metric == "cosine":
        size = np.linalg.norm(matrix, axis=1)[:, None] * np.linalg.norm(vectors, axis=1)[None, :]
        return np.divide(matrix @ vectors.T, size, out=np.zeros(size.shape), where=size > 0)
    square = (matrix**2).sum(axis=1)[:, None] - 2 * matrix @ vectors.T + (vectors**2).sum(axis=1)[None, :]
    return 1 - np.maximum(square, 0)


def best(score: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row, ties to the column of least order."""
    low = np.partition(score, -k, axis=1)[:, -k, None] if score.shape[1] > k else -np.inf
    row, col = np.nonzero(score >= low)
    at = np.lexsort((order[col], -score[row, col], row))
    row, col = row[at], col[at]
    first = np.searchsorted(row, row)
    kept = np.arange(len(row)) - first < k
    return row[kept], col[kept]


def running_best(held: list[tuple], k: int) -> tuple:
    """(query, name, score, base): the k best of each query among all that is held, ties to the lesser name."""
    query, names, score, base = (np.concatenate(x) for x in zip(*held, strict=True))
    _, order = np.unique(names, return_inverse=True)
    at = np.lexsort((order, -score, query))
    first = np.searchsorted(query[at], query[at])
    at = at[np.arange(len(at)) - first < k]
    return query[at], names[at], score[at], base[at]


def nearest_chunks(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 5,
    metric: str = "cosine",
    weights: tuple[float, float, float] | None = None,
    where: Column | None = None,
    least: float | None = None,
) -> DataFrame:
    """(query_id, rank, id, score, base): the k best chunks of each query, ties to the lesser id.

    queries: query_id, embedding. chunks: id, embedding, and for weights legal_score and complexity_score
    (null: 0). metric "cosine" or "l2"; score is the similarity, for l2 one less the squared distance,
    base its value before weights. where filters chunks before the search, least the results after it.
    Queries without an embedding find nothing. The result, k rows a query, is written once, since contexts,
    answers and confidence all read it. The search is exact: each task keeps the k best of each query over all its
    chunks, so k rows a query and task are shuffled. Queries are broadcast QUERY_BYTES at a time, each such block
    after the one before is done; for more questions than a few blocks hold, vector_index.search_index
    reads only the cells that matter.
    """
    asked = queries.filter("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    if where is not None:
        chunks = chunks.filter(where)
    extra = ["legal_score", "complexity_score"] if weights else []
    rows = chunks.filter("embedding is not null").select(
        F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in extra]
    )
    asked = settle(asked, "asked")
    size = asked.agg(F.sum(F.size("embedding") * F.lit(8)).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    context = queries.sparkSession.sparkContext
    found = []
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        ids = part["query_id"].to_numpy()
        shared = context.broadcast((ids, _matrix(part["embedding"].combine_chunks()) if len(ids) else np.zeros((0, 0))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            held: list[tuple] = []
            count = 0
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                vectors, names = _matrix(batch.column("embedding")), np.array(batch.column("id").to_pylist(), dtype=object)
                order = np.empty(len(names), dtype=np.int64)
                order[np.argsort(names, kind="stable")] = np.arange(len(names))
                added = weights[1] * batch.column("legal_score").to_numpy() + weights[2] * batch.column("complexity_score").to_numpy() if weights else 0.0
                for at in range(0, len(ids), SLICE):
                    base = np.round(_kernel(matrix[at : at + SLICE], vectors, metric), 12)  # equal vectors tie, wherever they stand
                    score = weights[0] * base + added if weights else base
                    row, col = best(score, order, k)
                    held.append((at + row, names[col], score[row, col], base[row, col]))
                    count += len(row)
                if count > 4 * k * len(ids):
                    held = [running_best(held, k)]
                    count = len(held[0][0])
            query, names, score, base = running_best(held, k) if held else (np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0), np.zeros(0))
            for at in range(0, len(query), ROWS):
                part = slice(at, at + ROWS)
                kept = [pa.array(ids[query[part]]), pa.array(names[part], pa.string()), pa.array(score[part]), pa.array(base[part])]
                yield pa.RecordBatch.from_arrays(kept, ["query_id", "id", "score", "base"])

        found.append(rows.mapInArrow(run, "query_id long, id string, score double, base double"))
        if blocks > 1:  # one block of queries at a time is in memory
            found[-1] = settle(found[-1], "block")
            shared.unpersist()
    every = reduce(DataFrame.unionByName, found)
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    if least is not None:
        ranked = ranked.filter(F.col("score") >= least)
    return settle(ranked.select("query_id", "rank", "id", "score", "base"), "nearest")


def with_chunks(results: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """results with columns of their chunks. Results are k rows a query, and Spark broadcasts them if they
    are small by its own statistics."""
    return results.join(chunks.select("id", *columns), "id")


#: What a search may return beside ids, and the column of chunks or results that has it.
INCLUDED = {"documents": "text", "metadatas": "metadata", "distances": "distance"}


def search(queries: DataFrame, chunks: DataFrame, k: int = 5, where: Column | None = None, include: tuple[str, ...] = tuple(INCLUDED)) -> DataFrame:
    """(query_id, rank, id, and of text, metadata and distance what include names): the k nearest chunks by
    squared distance. chunks: id, embedding, and text and metadata where they are asked for."""
    unknown = set(include) - set(INCLUDED)
    if unknown:
        raise ValueError(f"unknown parts of results: {sorted(unknown)}")
    found = nearest_chunks(queries, chunks, k, "l2", where=where).withColumn("distance", 1 - F.col("base"))
    asked = [INCLUDED[c] for c in include]
    held = [c for c in asked if c != "distance"]
    return (with_chunks(found, chunks, held) if held else found).select("query_id", "rank", "id", *asked)


def confidence(results: DataFrame) -> DataFrame:
    """(query_id, confidence, top_score): 0.7 of the mean score and 0.3 of the count over 5, at most 1."""
    mean = F.avg("score") * 0.7 + F.least(F.count(F.lit(1)), F.lit(5)) / 5 * 0.3
    return results.groupBy("query_id").agg(F.least(mean, F.lit(1.0)).alias("confidence"), F.max_by("score", -F.col("rank")).alias("top_score"))


def _in_order(*columns: str) -> Column:
    return F.sort_array(F.collect_list(F.struct("rank", *columns)))


def context_block() -> Column:
    """One numbered block: source, chunk, section, score and content of a result."""
    chunk = F.when(F.coalesce("chunk_index", F.lit(0)) != 0, F.concat(F.lit(" (chunk "), F.col("chunk_index").cast("string"), F.lit(")"))).otherwise("")
    section = F.when(F.coalesce("section_num", F.lit(0)) != 0, F.col("section_num").cast("string")).otherwise("General")
    source = F.coalesce("source", F.concat(F.lit("Document "), F.col("rank").cast("string")))
    return F.concat(
        F.lit("\n--- Document "), F.col("rank").cast("string"), F.lit(": "), source, chunk, F.lit(" ---\nSection: "), section,
        F.lit("\nRelevance Score: "), F.format_string("%.2f", F.col("score")), F.lit("\n\n"), F.col("text"), F.lit("\n"),
    )


def contexts(results: DataFrame) -> DataFrame:
    """(query_id, context) of results with text, source, chunk_index and section_num, blocks in rank order."""
    blocks = results.withColumn("block", context_block()).groupBy("query_id").agg(_in_order("block").alias("b"))
    return blocks.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n").alias("context"))


def extractive_answer(texts: Column) -> Column:
    """The first 500 characters of the first three texts, 1000 at most."""
    told = F.array_join(F.transform(F.slice(texts, 1, 3), lambda t: F.substring(t, 1, 500)), "\n")
    found = F.concat(F.lit("Based on the retrieved documents: "), F.substring(told, 1, 1000), F.lit("..."))
    return F.when(F.coalesce(F.size(texts), F.lit(0)) > 0, found).otherwise(NO_ANSWER)


def fallback_answer(query: Column, context: Column) -> Column:
    """An answer from the first snippets of a context."""
    head = F.concat(
        F.lit("**Confidence Level: Medium**\n\nBased on the available legal documents, here are the relevant sections for your query:\n\n**Query:** "),
        query,
        F.lit("\n\n**Relevant Information:**\n"),
    )
    foot = "\n**Note:** This response was generated from document excerpts. For detailed legal advice, please consult with a qualified attorney."
    snippets = F.slice(F.split(context, "---", 4), 2, 2)

    def told(snippet: Column, at: Column) -> Column:
        lines = F.split(strip(snippet), "\n")
        kept = F.filter(lines, lambda x: (strip(x) != "") & ~x.startswith("Section:") & ~x.startswith("Relevance"))
        text = F.concat(F.lit("\n"), (at + 1).cast("string"), F.lit(". "), lines[0], F.lit("\n"), F.array_join(F.slice(kept, 1, 3), "\n"), F.lit("\n"))
        return F.when(strip(snippet) == "", "").otherwise(text)

    return F.concat(head, F.array_join(F.transform(snippets, told), ""), F.lit(foot))


def answer_questions(questions: DataFrame, results: DataFrame) -> DataFrame:
    """One row per question: query_id, n_sources, sources, confidence, top_score, answer; questions that
    found nothing keep a row. results: of nearest_chunks with text and source."""
    per = results.groupBy("query_id").agg(_in_order("id", "source", "score", "text").alias("found"))
    rows = questions.select(F.col("query_id").cast("long").alias("query_id")).join(per, "query_id", "left").join(confidence(results), "query_id", "left")
    texts = F.coalesce(F.transform("found", lambda x: x["text"]), F.array().cast("array<string>"))
    return rows.select(
        "query_id",
        F.coalesce(F.size("found"), F.lit(0)).alias("n_sources"),
        F.transform("found", lambda x: x["id"]).alias("sources"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("top_score", F.lit(0.0)).alias("top_score"),
        extractive_answer(texts).alias("answer"),
    )


def evaluate(cases: DataFrame, results: DataFrame, least: float = 0.5, suite: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """((query_id, coverage, passed), (pass_rate, passed)): the share of expected keywords in the sources.

    cases: query_id, keywords. results: query_id, rank, text.
    """
    texts = results.groupBy("query_id").agg(_in_order("text").alias("t"))
    texts = texts.select("query_id", F.lower(F.array_join(F.transform("t", lambda x: x["text"]), " ")).alias("told"))
    expected = cases.groupBy("query_id").agg(F.flatten(F.collect_list("keywords")).alias("keywords")).filter(F.size("keywords") > 0)
    found = F.filter("keywords", lambda k: F.coalesce(F.col("told").contains(F.lower(k)), F.lit(False)))
    each = expected.join(texts, "query_id", "left").select("query_id", (F.size(found) / F.size("keywords")).alias("coverage"))
    each = each.withColumn("passed", F.col("coverage") >= least)
    total = each.agg(F.avg(F.col("passed").cast("int")).alias("pass_rate")).withColumn("passed", F.col("pass_rate") >= suite)
    return each, total


def evaluate_answers(cases: DataFrame, answers: DataFrame, least: float = 0.5, suite: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """((query_id, coverage, passed), (pass_rate, passed)): the share of expected keywords in the answers'
    own texts; without a source no case passes.

    cases: query_id, keywords. answers: query_id, answer, n_sources.
    """
    expected = cases.groupBy("query_id").agg(F.flatten(F.collect_list("keywords")).alias("keywords")).filter(F.size("keywords") > 0)
    told = expected.join(answers.select("query_id", F.lower("answer").alias("told"), "n_sources"), "query_id", "left")
    found = F.filter("keywords", lambda k: F.coalesce(F.col("told").contains(F.lower(k)), F.lit(False)))
    each = told.select("query_id", (F.size(found) / F.size("keywords")).alias("coverage"), F.coalesce("n_sources", F.lit(0)).alias("n"))
    each = each.select("query_id", "coverage", ((F.col("coverage") >= least) & (F.col("n") > 0)).alias("passed"))
    total = each.agg(F.avg(F.col("passed").cast("int")).alias("pass_rate")).withColumn("passed", F.col("pass_rate") >= suite)
    return each, total
