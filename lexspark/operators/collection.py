"""A collection of chunks or documents kept as a table: add, get, delete, update, list, search."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.functions.text import content_hash, preview
from lexspark.operators.chunking import document_id

COMPARE = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(*v),
    "$nin": lambda c, v: ~c.isin(*v),
}


def predicate(where: dict[str, Any] | None) -> Column:
    """A filter of equalities, comparisons and $and / $or, as a column; every given condition must hold."""
    if not where:
        return F.lit(True)
    parts = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            join = (lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b)
            parts.append(reduce(join, map(predicate, value)))
        elif isinstance(value, dict):
            unknown = set(value) - set(COMPARE)
            if unknown:
                raise ValueError(f"unknown operators: {sorted(unknown)}")
            parts += [COMPARE[op](F.col(key), v) for op, v in value.items()]
        else:
            parts.append(F.col(key) == value)
    return reduce(lambda a, b: a & b, parts)


def add(table: DataFrame, new: DataFrame, as_of: datetime) -> DataFrame:
    """table and those rows of new whose id it lacks; missing ids come from text and source. Of new rows
    with one id the first by text stays."""
    ids = F.coalesce("id", document_id(F.col("text"), F.col("source")))
    rows = new.withColumn("id", ids).withColumn("indexed_at", F.lit(as_of).cast("timestamp"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("text"))
    rows = rows.withColumn("_n", first).filter("_n = 1").drop("_n")
    return table.unionByName(rows.join(table.select("id"), "id", "left_anti"), allowMissingColumns=True)


def get(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id").distinct(), "id", "left_semi")


def delete(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id").distinct(), "id", "left_anti")


def delete_where(table: DataFrame, where: dict[str, Any]) -> DataFrame:
    """Rows of which the condition is not true, unknown included."""
    return table.filter(~F.coalesce(predicate(where), F.lit(False)))


def update_metadata(table: DataFrame, updates: DataFrame, as_of: datetime, order: str | None = None) -> DataFrame:
    """metadata (a map) merged with that of updates (id, metadata), whose values win; updated_at is stamped.

    Of several updates of one id every key takes its last value by the column order, the greatest without
    one or among equals; null values change nothing.
    """
    entries = updates.select("id", F.col(order).alias("_at") if order else F.lit(0).alias("_at"), F.explode_outer("metadata").alias("_key", "_value"))
    last = entries.groupBy("id", "_key").agg(F.max(F.when(F.col("_value").isNotNull(), F.struct("_at", "_value"))).alias("_last"))
    pair = F.when(F.col("_key").isNotNull() & F.col("_last").isNotNull(), F.struct(F.col("_key"), F.col("_last._value").alias("_value")))
    new = last.groupBy("id").agg(F.map_from_entries(F.collect_list(pair)).alias("_new"))
    merged = F.map_zip_with(F.coalesce("metadata", F.create_map().cast("map<string,string>")), "_new", lambda _, old, new: F.coalesce(new, old))
    rows = table.join(new, "id", "left")
    at = F.when(F.col("_new").isNotNull(), F.lit(as_of).cast("timestamp"))
    kept = F.coalesce(at, F.col("updated_at")) if "updated_at" in table.columns else at
    return rows.withColumn("updated_at", kept).withColumn("metadata", F.when(F.col("_new").isNotNull(), merged).otherwise(F.col("metadata"))).drop("_new")


def search_metadata(table: DataFrame, where: dict[str, Any], limit: int = 10) -> DataFrame:
    return table.filter(predicate(where)).orderBy("id").limit(limit)


def list_rows(table: DataFrame, where: dict[str, Any] | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of rows by time and id, with a preview of the text. after_key() pages without counting rows."""
    page = table.filter(predicate(where)).orderBy("indexed_at", "id").offset(offset).limit(limit)
    return page.withColumn("preview", preview(F.col("text"))).drop("text")


def after_key(table: DataFrame, indexed_at: datetime, id_: str, limit: int = 100) -> DataFrame:
    """The page that follows a row: a filter and a top-k, at any depth."""
    later = (F.col("indexed_at") > F.lit(indexed_at)) | ((F.col("indexed_at") == F.lit(indexed_at)) & (F.col("id") > id_))
    return table.filter(later).orderBy("indexed_at", "id").limit(limit)


def listing(table: DataFrame) -> DataFrame:
    """(id, filename, upload_date, category, source) with defaults."""
    default = {"filename": "Unknown", "upload_date": "Unknown", "category": "general", "source": "Unknown"}
    return table.select("id", *[F.coalesce(F.col(c).cast("string"), F.lit(d)).alias(c) for c, d in default.items()])


def listing_total(table: DataFrame) -> DataFrame:
    """One row: how many rows a listing has."""
    return table.agg(F.count(F.lit(1)).alias("total"))


def stats(table: DataFrame, name: str) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("document_count")).select(F.lit(name).alias("name"), "document_count", F.lit("active").alias("status"))


def search_files(files: DataFrame, asked: str) -> DataFrame:
    """Files whose name, category or source holds the text in any case, the newest first."""
    hit = F.lit(False)
    for c in ("filename", "category", "source"):
        hit = hit | F.coalesce(F.lower(c).contains(asked.lower()), F.lit(False))
    return files.filter(hit).orderBy(F.desc("upload_date"), "id")


def files_by_category(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce("category", F.lit("general")).alias("category")).agg(F.count(F.lit(1)).alias("n_files"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row per text, that of the least doc_id, with document_hash and n_copies.

    A null text counts as an empty one. Null ids come last; of rows with one text and one id the least by
    their other columns stays. Copies are counted and the row is chosen by partial aggregates, so a text
    that fills a third of the table makes no large group.
    """
    kept = [c for c in docs.columns if c not in ("document_hash", "n_copies")]
    rest = [c for c, kind in docs.select(*kept).dtypes if c not in ("doc_id", "text") and not kind.startswith("map")]
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *rest)
    hashed = docs.select(*kept, content_hash(F.col("text")).alias("document_hash"))
    first = hashed.groupBy("document_hash").agg(F.min_by(F.struct(*kept), order).alias("row"), F.count(F.lit(1)).alias("n_copies"))
    return first.select("row.*", "document_hash", "n_copies")


def last_messages(chat: DataFrame, n: int = 5, role: str | None = None) -> DataFrame:
    """(conv_id, turn, role, preview) of the last n messages of each conversation, of one role if given."""
    rows = chat.filter(F.col("role") == role) if role else chat
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return rows.withColumn("n", back).filter(F.col("n") <= n).select("conv_id", "turn", "role", preview(F.col("text"), 80, always=True).alias("preview"))
