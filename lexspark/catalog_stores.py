"""Registered queries over what jobs store: files, tables, indexes, logs, sketches and the sinks of streams."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark import catalog
from lexspark.catalog import CHUNKS_SQL, STOP_WORDS, query
from lexspark.operators import analytics, embed, similarity, vector_index
from lexspark.operators.lineage import folder, settle, shared_dir
from lexspark.sources import folders, tables
from lexspark.sources.chunk_store import ChunkStore, KeyedLog
from lexspark.streaming import jobs


def _place(df: DataFrame) -> str:
    """A folder of its own in the shared one, not there yet, that goes when the driver's JVM ends."""
    path = f"{shared_dir(df.sparkSession)}/lexspark-store-{uuid.uuid4().hex}"
    at, files = folder(df.sparkSession, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return f"{path}/store"


# Files and tables


@query("documents", sql="SELECT CAST(sum(length(coalesce(text, '')) + 2) AS BIGINT) AS n_chars, CAST(count(*) AS BIGINT) AS n_texts, 0 AS n_rejected, 'utf-8' AS encodings FROM documents")
def folder_texts(documents: DataFrame) -> DataFrame:
    """The texts written as files of a folder, many to a file, each ended by a mark, and read back."""
    root = _place(documents)
    documents.select(F.concat(F.coalesce("text", F.lit("")), F.lit("\x1e")).alias("value")).write.text(f"{root}/in")
    accepted, rejected = folders.read_folder(documents.sparkSession, f"{root}/in")
    read = folders.decode_texts(accepted)
    row = read.agg(
        F.sum(F.length("text")).cast("long").alias("n_chars"),
        F.sum(F.length("text") - F.length(F.replace("text", F.lit("\x1e"), F.lit("")))).cast("long").alias("n_texts"),
        F.array_join(F.array_sort(F.collect_set("encoding_used")), ",").alias("encodings"),
    )
    return row.crossJoin(rejected.agg(F.count(F.lit(1)).cast("int").alias("n_rejected")))  # one row each


@query("documents", sql="SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents WHERE lang IS NOT NULL")
def stored_table(documents: DataFrame) -> DataFrame:
    """Documents appended to a table in folders by language, in two parts, and read back under a schema."""
    root = _place(documents)
    for odd in (0, 1):
        tables.write_table(documents.filter((F.col("doc_id") % 2 == odd) & F.col("lang").isNotNull()), root, ["lang"])
    read = tables.read_table(documents.sparkSession, root, documents.schema)
    return read.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query("files", sql="SELECT id, filename, upload_date, category, coalesce(source, 'Unknown') AS source FROM files")
def exported_listing(files: DataFrame) -> DataFrame:
    """The document listing exported as JSON lines and read back."""
    root = _place(files)
    rows = catalog.collection.listing(files)
    tables.write_json(rows, root)
    return files.sparkSession.read.schema(rows.schema).json(root)


def _letters() -> object:
    return lambda texts: [[float(t.count(c)) for c in "etaoin"] for t in texts]


_LETTERS = ", ".join(f"CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE) AS {c}" for c in "etaoin")


@query("documents", sql=f"SELECT CAST(doc_id AS VARCHAR) AS id, {_LETTERS}, 'letters' AS embedding_model, 6 AS embedding_dimension FROM documents")
def embedded_texts(documents: DataFrame) -> DataFrame:
    """Texts through an embedder that is given as a function: how often six letters occur."""
    rows = embed.embed_with(documents.select(F.col("doc_id").alias("id"), "text"), _letters, "letters")
    return rows.select("id", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("etaoin")], "embedding_model", "embedding_dimension")


# Chunks and logs


@query("documents", sql=f"more {CHUNKS_SQL} SELECT id, min(CASE WHEN doc_id % 3 <> 1 THEN 0 ELSE 1 END) AS batch FROM named GROUP BY id")
def stored_chunks(documents: DataFrame) -> DataFrame:
    """Chunks of overlapping batches in a store of buckets with Bloom filters, each id once."""
    store = ChunkStore(_place(documents), buckets=32)
    chunks = settle(catalog._chunks(documents).withColumn("third", F.col("doc_id") % 3), "chunks")
    store.add(chunks.filter("third <> 1"), 0)
    store.add(chunks.filter("third <> 2"), 1)
    return store.read(documents.sparkSession).select("id", F.col("batch").cast("int").alias("batch"))


@query("query_analytics", sql="SELECT query_id, CASE WHEN seq % 3 = 0 THEN processing_time + 1 ELSE processing_time END AS processing_time FROM query_analytics")
def merged_query_log(query_analytics: DataFrame) -> DataFrame:
    """The query log, of which a third is written again later, kept in buckets that are overwritten where they change."""
    log = KeyedLog(_place(query_analytics), "query_id", "seq", 16)
    rows = query_analytics.withColumn("scores", F.array("avg_similarity_score")).drop("avg_similarity_score")
    log.merge(analytics.query_log(rows))
    again = rows.filter("seq % 3 = 0").withColumns({"seq": F.col("seq") + 1_000_000_000, "processing_time": F.col("processing_time") + 1})
    log.merge(analytics.query_log(again))
    return log.read(rows.sparkSession).select("query_id", "processing_time")


@query("document_analytics", sql="SELECT document_id, CASE WHEN CAST(document_id AS BIGINT) % 4 = 0 THEN 0 ELSE file_size END AS file_size FROM document_analytics")
def merged_document_log(document_analytics: DataFrame) -> DataFrame:
    """Uploads of which every fourth comes again, with another time and size: its last write replaces it whole."""
    log = KeyedLog(_place(document_analytics), "document_id", "seq", 16)
    rows = document_analytics.withColumn("seq", F.lit(1))
    log.merge(analytics.document_log(rows))
    again = rows.filter("document_id % 4 = 0").withColumns({"seq": F.lit(2), "file_size": F.lit(0).cast("long"), "upload_timestamp": F.expr("upload_timestamp + INTERVAL 3 DAYS")})
    log.merge(analytics.document_log(again.unionByName(again.withColumns({"seq": F.lit(1), "file_size": F.lit(-1).cast("long")}))))
    return log.read(rows.sparkSession).select("document_id", "file_size")


# Streams: the events come in four files, one a batch, and later files hold earlier rows


def _stream(rows: DataFrame) -> DataFrame:
    root = _place(rows)
    rows.repartition(4, F.pmod(F.hour("timestamp"), F.lit(4))).write.parquet(root)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(root)


def _windows(windows: DataFrame, key: list[str]) -> DataFrame:
    root = _place(windows)
    jobs.run_available(jobs.windows_kept(windows, f"{root}/windows", f"{root}/checkpoint"))
    return jobs.last_windows(windows.sparkSession, f"{root}/windows", key)


@query("user_activity", sql="SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H:%M') AS start, activity_type AS kind, count(*) AS n FROM user_activity GROUP BY ALL")
def event_windows(user_activity: DataFrame) -> DataFrame:
    """Events by hour and type, counted as a stream whose watermark lets every late row in."""
    rows = _windows(jobs.counts(_stream(user_activity), "activity_type", late="1000 days"), ["start", "kind"])
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "kind", "n")


@query(
    "system_performance",
    sql="""
more spans AS (SELECT date_trunc('hour', timestamp) + to_hours(unnest(range(1, 25))) AS until, cpu_usage, memory_usage, error_rate FROM system_performance),
means AS (SELECT until, avg(cpu_usage) AS cpu, avg(memory_usage) AS memory, avg(error_rate) AS errors FROM spans GROUP BY until)
SELECT strftime(until, '%Y-%m-%d %H:%M') AS until, round(cpu, 11) AS cpu, round(memory, 11) AS memory, CASE WHEN cpu < 80 AND errors < 0.05 THEN 'healthy' ELSE 'warning' END AS status FROM means
""".strip(),
)
def event_health(system_performance: DataFrame) -> DataFrame:
    """Health of rolling windows of a day, as a stream whose watermark lets every late row in."""
    rows = _windows(jobs.rolling_health(_stream(system_performance), late="1000 days"), ["until"])
    return rows.select(F.date_format("until", "yyyy-MM-dd HH:mm").alias("until"), F.round("cpu", 11).alias("cpu"), F.round("memory", 11).alias("memory"), "status")


# Search and similarity


@query("chunk_vectors")
def indexed_search(chunk_vectors: DataFrame) -> DataFrame:
    """cosine_search through a stored index, of which a fifth of the vectors is added later."""
    root = _place(chunk_vectors)
    vector_index.build_index(chunk_vectors.filter("label >= 2"), root)
    vector_index.add_to_index(chunk_vectors.filter("label < 2"), root, "more")
    found = vector_index.search_index(catalog._vector_queries(chunk_vectors), root)
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


catalog.ORACLE_SQL["indexed_search"] = catalog.ORACLE_SQL["cosine_search"]


@query("chunk_vectors")
def indexed_hybrid_search(chunk_vectors: DataFrame) -> DataFrame:
    """hybrid_search through a stored index, whose cells also bound the scores that are added."""
    root = _place(chunk_vectors)
    vector_index.build_index(chunk_vectors, root)
    found = vector_index.search_index(catalog._vector_queries(chunk_vectors), root, 10, weights=(0.7, 0.2, 0.1), least=0.3)
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


catalog.ORACLE_SQL["indexed_hybrid_search"] = catalog.ORACLE_SQL["hybrid_search"]


@query(
    "chunk_vectors",
    sql="""
more v AS (SELECT CAST(id AS BIGINT) AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM chunk_vectors),
pairs AS (SELECT a.id AS doc1_id, b.id AS doc2_id, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) AS s FROM v a JOIN v b ON a.id < b.id)
SELECT doc1_id, doc2_id, round(s, 6) AS similarity_score FROM pairs WHERE s >= 0.43
""".strip(),
)
def similar_vectors_banded(chunk_vectors: DataFrame) -> DataFrame:
    """Pairs of vectors by bands of signs, at a recall that leaves one of ten thousand out."""
    docs = chunk_vectors.select(F.col("id").cast("long").alias("doc_id"), "embedding")
    return similarity.similar_documents_banded(docs, 0.43, recall=0.9999).withColumn("similarity_score", F.round("similarity_score", 6))


def _grown(chunk_vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs of the old documents, pairs that the new ones add, clusters of all, grown from those of the old)."""
    docs = catalog._centroids(chunk_vectors)
    new = F.col("doc_id") % 4 == 3
    old = settle(similarity.similar_documents(docs.filter(~new), 0.25), "pairs")
    more = settle(similarity.similar_documents(docs, 0.25, new=new), "pairs")
    return old, more, similarity.grown_clusters(similarity.clusters(old, 0.35), more, 0.35)


@query("chunk_vectors")
def grown_similar_documents(chunk_vectors: DataFrame) -> DataFrame:
    """similar_documents in two steps: those of three quarters of the documents, and what the last quarter adds."""
    old, more, _ = _grown(chunk_vectors)
    score = F.col("similarity_score")
    return old.unionByName(more).select("doc1_id", "doc2_id", F.round(score, 6).alias("similarity_score"), similarity.band(score).alias("band"))


@query("chunk_vectors")
def grown_document_clusters(chunk_vectors: DataFrame) -> DataFrame:
    """document_clusters grown by a last quarter of the documents."""
    return _grown(chunk_vectors)[2]


for _name in ("similar_documents", "document_clusters"):
    catalog.ORACLE_SQL[f"grown_{_name}"] = catalog.ORACLE_SQL[_name]


@query("documents")
def stored_tfidf_vectors(documents: DataFrame) -> DataFrame:
    """tfidf_vectors by a model whose counts were stored in two batches."""
    texts, root = embed.tokens(documents.select(F.col("doc_id").alias("id"), "text"), STOP_WORDS), _place(documents)
    for batch in (0, 1):
        embed.store_counts(texts.filter(F.col("id") % 2 == batch), root, batch, STOP_WORDS)
    found = embed.tfidf(texts, embed.stored_model(documents.sparkSession, root), STOP_WORDS)
    return found.withColumn("weight", F.round("weight", 6))


catalog.ORACLE_SQL["stored_tfidf_vectors"] = catalog.ORACLE_SQL["tfidf_vectors"]


# Sketches and sessions


@query(
    "query_analytics",
    sql="""
more days AS (SELECT * FROM query_analytics WHERE CAST(timestamp AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25')
SELECT count(*) AS total_queries, round_even(coalesce(avg(processing_time), 0), 3) AS avg_processing_time, round_even(coalesce(avg(avg_similarity_score), 0), 3) AS avg_similarity_score, TRUE AS users_within_bound FROM days
""".strip(),
)
def sketched_query_stats(query_analytics: DataFrame) -> DataFrame:
    """Statistics of a window of days out of stored daily sketches; the estimate of users is held to its bound."""
    first, last = date(2024, 1, 5), date(2024, 1, 25)
    row = analytics.sketched_stats(settle(analytics.daily_sketches(query_analytics), "sketches"), first, last)
    exact = query_analytics.filter(F.to_date("timestamp").between(F.lit(first), F.lit(last))).agg(F.countDistinct("user_id").alias("users"))
    within = F.abs(F.col("unique_users") - F.col("users")) <= F.ceil(F.col("users") * analytics.USERS_ERROR)
    return row.crossJoin(exact).select("total_queries", "avg_processing_time", "avg_similarity_score", within.alias("users_within_bound"))  # one row each


@query(
    "query_analytics",
    sql="SELECT query_type, count(*) AS n FROM query_analytics WHERE CAST(timestamp AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY query_type ORDER BY n DESC, query_type LIMIT 10",
)
def sketched_query_types(query_analytics: DataFrame) -> DataFrame:
    """The most frequent types of a window of days out of stored daily sketches."""
    return analytics.sketched_types(settle(analytics.daily_sketches(query_analytics), "sketches"), date(2024, 1, 5), date(2024, 1, 25))


@query(
    "user_activity",
    sql="""
more gaps AS (SELECT *, lag(timestamp) OVER (PARTITION BY user_id ORDER BY timestamp) AS before FROM user_activity),
marked AS (SELECT *, sum(CASE WHEN before IS NULL OR timestamp > before + INTERVAL 90 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY timestamp RANGE UNBOUNDED PRECEDING) AS session FROM gaps),
per AS (SELECT (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 60e6 AS minutes, count(CASE WHEN activity_type = 'click' THEN 1 END) AS q FROM marked GROUP BY user_id, session)
SELECT count(*) AS sessions, round_even(coalesce(avg(minutes), 0), 2) AS avg_session_minutes, round_even(coalesce(avg(q), 0), 3) AS avg_queries_per_session FROM per
""".strip(),
)
def gap_sessions(user_activity: DataFrame) -> DataFrame:
    """Engagement by sessions that end where a user does nothing for 90 minutes."""
    return analytics.engagement_by_gap(user_activity, ("click",), "90 minutes")
