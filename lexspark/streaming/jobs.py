"""Streaming forms: file ingest, windowed counts, rolling health, upsert of the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lexspark.operators import analytics
from lexspark.operators.chunking import chunk_documents
from lexspark.sources.chunk_store import ChunkStore, KeyedLog
from lexspark.sources.folders import decode_texts, sort_files

FILES = "path string, modificationTime timestamp, length long, content binary"


def folder_stream(spark: SparkSession, path: str) -> DataFrame:
    """Files as they are dropped into a folder."""
    return spark.readStream.format("binaryFile").schema(FILES).load(path)


def ingest(files: DataFrame, store: str | ChunkStore, checkpoint: str, size: int = 1000, overlap: int = 200) -> DataStreamWriter:
    """Chunks of new text files added to a chunk store, each id once.

    A batch that is run again replaces its own folder, so nothing is written twice. Ids that other batches have are left
    out; only buckets whose filters admit an id of the batch are read for that.
    """
    kept = ChunkStore(store) if isinstance(store, str) else store

    def put(batch: DataFrame, number: int) -> None:
        docs = decode_texts(sort_files(batch)[0].filter("content_type = 'text/plain'"))
        docs = docs.select(F.md5("path").alias("doc_id"), F.col("path").alias("source"), "text", "encoding_used")
        kept.add(chunk_documents(docs, size, overlap), number)

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def once(events: DataFrame, key: str = "id", late: str = "1 hour", time: str = "timestamp") -> DataFrame:
    """The first row of each key within late of it, in bounded state: a key is forgotten when the watermark has passed
    its time and late, so nothing that is stored is read. A repetition later than that is a new row."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counts(events: DataFrame, kind: str, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, kind, n) of tumbling windows over timestamp; rows later than late are dropped."""
    rows = events.withWatermark("timestamp", late).groupBy(F.window("timestamp", every), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("start"), "kind", "n")


def rolling_health(performance: DataFrame, late: str = "1 hour") -> DataFrame:
    """(until, averages, status) of windows of 24 hours that begin every hour."""
    rows = performance.withWatermark("timestamp", late).groupBy(F.window("timestamp", "24 hours", "1 hour"))
    rows = rows.agg(F.avg("cpu_usage").alias("cpu"), F.avg("memory_usage").alias("memory"), F.avg("error_rate").alias("errors"))
    status = F.when((F.col("cpu") < 80) & (F.col("errors") < 0.05), "healthy").otherwise("warning")
    return rows.select(F.col("window.end").alias("until"), "cpu", "memory", "errors", status.alias("status"))


def upsert_queries(events: DataFrame, root: str, checkpoint: str, buckets: int = 64) -> DataStreamWriter:
    """The query log under root kept current: each batch's last row of a query_id replaces the stored one.

    The log lies in buckets by hash of query_id (KeyedLog); a batch reads and rewrites those of its own ids only. A
    batch that is run again gives the same table.
    """
    log = KeyedLog(root, "query_id", "seq", buckets)

    def merge(batch: DataFrame, number: int) -> None:
        log.merge(analytics.query_log(batch))

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def windows_kept(windows: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """Windows of a stream (counts, rolling_health) as they change: each batch's under root/batch=N, the last of a key
    counts (last_windows). Windows that are still open are there too, and late rows within the watermark change them.
    A batch that is run again replaces its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    return windows.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)


def last_windows(spark: SparkSession, root: str, key: list[str]) -> DataFrame:
    """The windows that windows_kept has written, each as it was last."""
    rows = spark.read.parquet(root)
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*key, *[f"last.{c}" for c in rest if c != "batch"])


def run_available(writer: DataStreamWriter) -> None:
    """Run a stream over all that is there now, to its end."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
