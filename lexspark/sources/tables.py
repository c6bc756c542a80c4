"""Tables of chunks, logs and reports on storage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.operators.lineage import folder

#: Schemas of the logs.
QUERY_LOG = (
    "query_id string, query_text string, timestamp timestamp, processing_time double, documents_retrieved int, avg_similarity_score double,"
    "max_similarity_score double, user_id string, user_feedback double, session_id string, query_type string"
)
DOCUMENT_LOG = (
    "document_id string, filename string, upload_timestamp timestamp, file_size long, chunks_created int, processing_time double, document_type string,"
    "legal_complexity double, query_count long, last_queried timestamp, avg_similarity_score double, total_similarity_score double, uploader_id string"
)
ACTIVITY_LOG = ("user_id string, activity_type string, activity_data string, timestamp timestamp, session_id string, ip_address string, user_agent string")
PERFORMANCE_LOG = (
    "timestamp timestamp, cpu_usage double, memory_usage double, active_connections int, query_throughput double, avg_response_time double, error_rate double, storage_usage double"
)
SIMILARITY = ("doc1_id string, doc2_id string, similarity_score double, calculated_at timestamp")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "append") -> None:
    """Write Parquet, in folders by the given columns."""
    df.write.mode(mode).partitionBy(*(partition_by or [])).parquet(path)


def write_log(df: DataFrame, path: str, time: str = "timestamp") -> None:
    """Append a log in folders by day, so that windows of days read only theirs."""
    write_table(df.withColumn("day", F.to_date(time)), path, ["day"])


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def replace_table(df: DataFrame, root: str) -> str:
    """Write a new version of a table beside the one that df may read; returns its path."""
    path = f"{root}/version={uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def drop_versions(spark: SparkSession, root: str, *keep: str) -> None:
    """Delete the versions of a table other than those of these paths."""
    at, files = folder(spark, root)
    kept = {path.rstrip("/").rpartition("/")[2] for path in keep}
    for status in files.listStatus(at):
        name = status.getPath().getName()
        if name.startswith("version=") and name not in kept:
            files.delete(status.getPath(), True)


def write_json(df: DataFrame, path: str) -> None:
    """Document lists and reports as JSON lines."""
    df.write.mode("overwrite").json(path)


def payload_value(text: Column, path: str, kind: str = "string") -> Column:
    """A value out of a JSON payload with open keys; null where it is missing or the text is no JSON."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)
