"""Usage analytics over query, document, activity and system logs.

Every function takes tables and, where a window matters, the moment it ends (as_of) in place of a clock.
Averages skip nulls, empty windows give 0, results are rounded half to even.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexspark.functions.text import preview
from lexspark.operators.lineage import settle
from lexspark.operators.similarity import similarity_totals, top_pairs

N = "*"


def since(column: str, as_of: datetime, days: float) -> Column:
    return F.col(column) >= F.lit(as_of - timedelta(days=days)).cast("timestamp")


def mean(column: str | Column, digits: int) -> Column:
    return F.bround(F.coalesce(F.avg(column), F.lit(0.0)), digits)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, whole rows compared after order; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in (key, order)]
    last = rows.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("last"))
    return last.select(key, "last.*").select(*rows.columns)


def query_log(events: DataFrame) -> DataFrame:
    """Logged queries with average and maximum of the array scores (0 when empty); the last write of a
    query_id, by seq, wins."""
    n = F.coalesce(F.size("scores"), F.lit(0))
    average = F.when(n > 0, F.aggregate("scores", F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0)
    rows = events.withColumns({"avg_similarity_score": average, "max_similarity_score": F.when(n > 0, F.array_max("scores")).otherwise(0.0)})
    return latest(rows.drop("scores"), "query_id", "seq")


def document_log(uploads: DataFrame) -> DataFrame:
    """Logged uploads; the last of a document_id, by seq, replaces the row whole, so its use starts at 0."""
    rows = latest(uploads, "document_id", "seq")
    return rows.withColumns({"query_count": F.lit(0).cast("long"), "avg_similarity_score": F.lit(0.0), "total_similarity_score": F.lit(0.0)})


def activity_rows(events: DataFrame, payload: str) -> DataFrame:
    """Activity with its map payload as JSON text, null when empty."""
    text = F.when(F.coalesce(F.size(payload), F.lit(0)) > 0, F.to_json(payload))
    return events.withColumn("activity_data", text).drop(*([payload] if payload != "activity_data" else []))


METRICS = ("cpu_usage", "memory_usage", "active_connections", "query_throughput", "avg_response_time", "error_rate", "storage_usage")


def performance_rows(metrics: DataFrame) -> DataFrame:
    """(timestamp, seven metrics) from a map of metrics; missing ones are 0."""
    return metrics.select("timestamp", *[F.coalesce(F.try_element_at("metrics", F.lit(m)), F.lit(0.0)).alias(m) for m in METRICS])


def query_stats(queries: DataFrame, as_of: datetime, days: int = 30, approximate: bool = False) -> DataFrame:
    users = F.approx_count_distinct("user_id") if approximate else F.countDistinct("user_id")
    return queries.filter(since("timestamp", as_of, days)).agg(
        F.count(N).alias("total_queries"), mean("processing_time", 3).alias("avg_processing_time"),
        mean("avg_similarity_score", 3).alias("avg_similarity_score"), users.alias("unique_users"),
    )


def document_stats(documents: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    return documents.filter(since("upload_timestamp", as_of, days)).agg(
        F.count(N).alias("total_documents"), mean("file_size", 0).alias("avg_file_size"), mean("chunks_created", 1).alias("avg_chunks"),
        mean("processing_time", 3).alias("avg_processing_time"), mean("legal_complexity", 3).alias("avg_complexity"),
    )


def daily_queries(queries: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    return queries.filter(since("timestamp", as_of, days)).groupBy(F.to_date("timestamp").alias("day")).agg(F.count(N).alias("n")).orderBy("day")


def top_query_types(queries: DataFrame, as_of: datetime, days: int = 30, limit: int = 10) -> DataFrame:
    rows = queries.filter(since("timestamp", as_of, days)).groupBy("query_type").agg(F.count(N).alias("n"))
    return rows.orderBy(F.desc("n"), "query_type").limit(limit)


def system_averages(performance: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    return performance.filter(since("timestamp", as_of, days)).agg(
        mean("avg_response_time", 3).alias("avg_response_time"), mean("error_rate", 3).alias("avg_error_rate"), mean("query_throughput", 2).alias("avg_throughput")
    )


# Bounds and names of the categories are fixed values.


def latency_category() -> Column:
    t = F.col("processing_time")
    return F.when(t < 0.1, "very_fast").when(t < 0.5, "fast").when(t < 1.0, "moderate").when(t < 2.0, "slow").otherwise("very_slow")


def quality_category() -> Column:
    s = F.col("avg_similarity_score")
    return F.when(s >= 0.8, "excellent").when(s >= 0.6, "good").when(s >= 0.4, "fair").when(s >= 0.2, "poor").otherwise("very_poor")


def latency_distribution(queries: DataFrame) -> DataFrame:
    return queries.groupBy(latency_category().alias("category")).agg(F.count(N).alias("n"), F.bround(F.avg("processing_time"), 3).alias("avg_time"))


def slowest_queries(queries: DataFrame, limit: int = 10) -> DataFrame:
    top = queries.orderBy(F.desc("processing_time"), "query_id").limit(limit)
    return top.select(
        "query_id", preview(F.col("query_text"), 100).alias("query"), F.bround("processing_time", 3).alias("processing_time"),
        F.bround(F.coalesce("avg_similarity_score", F.lit(0.0)), 3).alias("similarity_score"),
    )


def quality_distribution(queries: DataFrame) -> DataFrame:
    return queries.filter("avg_similarity_score is not null").groupBy(quality_category().alias("category")).agg(F.count(N).alias("n"))


def suggestions(queries: DataFrame) -> DataFrame:
    """One row: advice from the shares of slow and of poor queries, and from the number of queries.

    Bounds and sentences are fixed values.
    """
    scored = F.col("avg_similarity_score").isNotNull()
    share = lambda part, whole: F.when(whole > 0, part / whole * 100)
    row = queries.agg(
        share(F.count_if(latency_category().isin("slow", "very_slow")), F.count(N)).alias("slow"),
        share(F.count_if(scored & quality_category().isin("poor", "very_poor")), F.count_if(scored)).alias("poor"),
        F.least(F.count(N), F.lit(10)).alias("listed"),
    )
    told = F.array_compact(
        F.array(
            F.when(F.col("slow") > 20, "Consider optimizing query processing - over 20% of queries are slow"),
            F.when(F.col("slow") > 10, "Review document chunking strategy to improve retrieval speed"),
            F.when(F.col("poor") > 30, "Improve document preprocessing to enhance similarity matching"),
            F.when(F.col("poor") > 15, "Consider expanding legal vocabulary for better semantic understanding"),
            F.when(F.col("listed") > 5, "Implement query caching for frequently asked questions"),
            F.when(F.col("listed") > 5, "Consider pre-computing embeddings for common query patterns"),
        )
    )
    default = F.array(
        F.lit("System performance is good - consider adding more documents for better coverage"),
        F.lit("Monitor user feedback to identify areas for improvement"),
    )
    return row.select(F.when(F.size(told) > 0, told).otherwise(default).alias("suggestions"))


def active_users(activity: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    return activity.filter(since("timestamp", as_of, days)).agg(F.countDistinct("user_id").alias("active_users"))


def activity_types(activity: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    rows = activity.filter(since("timestamp", as_of, days)).groupBy("activity_type").agg(F.count(N).alias("n"))
    return rows.orderBy(F.desc("n"), "activity_type")


def hourly_profile(activity: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    rows = activity.filter(since("timestamp", as_of, days)).groupBy(F.hour("timestamp").alias("h")).agg(F.count(N).alias("n"))
    return rows.select(F.format_string("%02d:00", "h").alias("hour"), "n").orderBy("hour")


def top_users(activity: DataFrame, as_of: datetime, days: int = 30, limit: int = 10) -> DataFrame:
    rows = activity.filter(since("timestamp", as_of, days) & F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count(N).alias("n"))
    return rows.orderBy(F.desc("n"), "user_id").limit(limit)


def running_counts(rows: DataFrame, order: list[str], what: str, name: str) -> DataFrame:
    """rows with how many of them, in the given order, up to each fulfil what (a condition), as column name.

    Rows are dealt out by ranges of the order and counted by range; each range then counts on from what came before,
    so a stretch of time that is crowded spreads over many ranges and no task sorts more than its own. Rows that are
    equal in the order are also told apart by where they were, which the caller's order must not depend on. One count
    for each range, as many as shuffle partitions, is all that is gathered.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_on", F.expr(what).cast("long")).withColumn("_tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(ranges, *order, "_tie").sortWithinPartitions(*order, "_tie").withColumn("_range", F.spark_partition_id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = 0
        for batch in batches:
            own = np.cumsum(batch.column("_on").fill_null(0).to_numpy(zero_copy_only=False)) + so_far
            so_far = int(own[-1]) if len(own) else so_far
            yield batch.append_column(name, pa.array(own, pa.int64()))

    schema = T.StructType([*dealt.schema.fields, T.StructField(name, T.LongType())])
    counted = settle(dealt.mapInArrow(count, schema), "counted")
    sums = counted.groupBy("_range").agg(F.coalesce(F.sum("_on"), F.lit(0)).alias("n"))
    before = sums.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"))
    return counted.join(F.broadcast(before), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before", "_on", "_tie")


def document_usage(documents: DataFrame, queries: DataFrame, newest: int = 3, lagged: bool = False) -> DataFrame:
    """(document_id, query_count, total_similarity_score, last_queried, avg_similarity_score).

    Each query with a score credits the documents uploaded last before it. A document is among them from
    its upload to that of the third later document, so the join is on the number of uploads so far: the
    queries' own is found by one sort of uploads and queries together (running_counts), and equals a document's
    place or one of the two after it. lagged leaves the last query out of the average, null for the first.
    """
    up = documents.select(F.col("upload_timestamp").alias("ts"), F.col("document_id").cast("string").alias("document_id"), F.lit(None).cast("double").alias("score"), F.lit(0).alias("q"))
    asked = queries.filter("score is not null").select(F.col("timestamp").alias("ts"), F.lit(None).cast("string").alias("document_id"), F.col("score").cast("double").alias("score"), F.lit(1).alias("q"))
    placed = running_counts(up.unionByName(asked).filter("ts is not null"), ["ts", "q", "document_id"], "q = 0", "place")
    by_place = placed.filter("q = 1").groupBy("place").agg(F.count(N).alias("n"), F.sum("score").alias("s"), F.max("ts").alias("last"), F.max_by("score", "ts").alias("last_score"))
    credits = placed.filter("q = 0").select("document_id", F.explode(F.sequence(F.col("place"), F.col("place") + newest - 1)).alias("place"))
    total = credits.join(by_place, "place").groupBy("document_id").agg(
        F.sum("n").alias("query_count"), F.sum("s").alias("total_similarity_score"), F.max("last").alias("last_queried"), F.max_by("last_score", "last").alias("last_score")
    )
    average = F.col("total_similarity_score") / F.col("query_count")
    if lagged:
        average = F.when(F.col("query_count") > 1, (F.col("total_similarity_score") - F.col("last_score")) / (F.col("query_count") - 1))
    return total.select("document_id", "query_count", "total_similarity_score", "last_queried", average.alias("avg_similarity_score"))


def health(performance: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """One row: average cpu, memory and error rate, and healthy or warning."""
    row = performance.filter(since("timestamp", as_of, hours / 24)).agg(F.avg("cpu_usage").alias("c"), F.avg("memory_usage").alias("m"), F.avg("error_rate").alias("e"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return row.select(
        F.bround(zero("c"), 2).alias("avg_cpu_usage"), F.bround(zero("m"), 2).alias("avg_memory_usage"), F.bround(zero("e"), 4).alias("avg_error_rate"),
        F.when((zero("c") < 80) & (zero("e") < 0.05), "healthy").otherwise("warning").alias("status"),
    )


def retain(log: DataFrame, as_of: datetime, days: int = 365) -> DataFrame:
    return log.filter(since("timestamp", as_of, days))


def retired_counts(logs: dict[str, DataFrame], as_of: datetime, days: int = 365) -> DataFrame:
    """(table, deleted): how many rows of each log are older than retention keeps."""
    parts = [log.agg(F.count_if(~since("timestamp", as_of, days)).alias("deleted")).select(F.lit(name).alias("table"), "deleted") for name, log in logs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def user_summary(activity: DataFrame, query_types: tuple[str, ...], upload_types: tuple[str, ...]) -> DataFrame:
    return activity.groupBy("user_id").agg(
        F.count_if(F.col("activity_type").isin(*query_types)).alias("queries"), F.count_if(F.col("activity_type").isin(*upload_types)).alias("documents_uploaded"),
        F.max("timestamp").alias("last_active"),
    )


def engagement(activity: DataFrame, query_types: tuple[str, ...]) -> DataFrame:
    """One row: sessions, their mean length in minutes and mean number of queries."""
    per = activity.filter("session_id is not null").groupBy("session_id").agg(
        ((F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 60e6).alias("minutes"), F.count_if(F.col("activity_type").isin(*query_types)).alias("q")
    )
    return per.agg(F.count(N).alias("sessions"), mean("minutes", 2).alias("avg_session_minutes"), mean("q", 3).alias("avg_queries_per_session"))


def engagement_by_gap(activity: DataFrame, query_types: tuple[str, ...], gap: str = "30 minutes") -> DataFrame:
    """One row: sessions, their mean length in minutes and mean number of queries, where no session id is known: a
    user's activities at most gap apart are one session. Activities without a user or a time are left out."""
    rows = activity.filter("user_id is not null AND timestamp is not null").groupBy("user_id", F.session_window("timestamp", gap).alias("session"))
    per = rows.agg(
        ((F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 60e6).alias("minutes"), F.count_if(F.col("activity_type").isin(*query_types)).alias("q")
    )
    return per.agg(F.count(N).alias("sessions"), mean("minutes", 2).alias("avg_session_minutes"), mean("q", 3).alias("avg_queries_per_session"))


#: Size of the daily sketches: users by a HyperLogLog sketch of 2 ** SKETCH_BITS registers, whose estimate lies within
#: USERS_ERROR of the true number with a chance of over 99 % (three standard errors), types by the KINDS most frequent ones.
SKETCH_BITS, KINDS = 14, 1000
USERS_ERROR = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)


def daily_sketches(queries: DataFrame) -> DataFrame:
    """(day, n, time_sum, time_n, score_sum, score_n, users, types): what a day's queries add to any window of days.
    Sums and counts are exact, users and types are sketches. Rows without a time are left out."""
    return queries.filter("timestamp is not null").groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count(N).alias("n"), F.sum("processing_time").alias("time_sum"), F.count("processing_time").alias("time_n"),
        F.sum("avg_similarity_score").alias("score_sum"), F.count("avg_similarity_score").alias("score_n"),
        F.hll_sketch_agg("user_id", F.lit(SKETCH_BITS)).alias("users"), F.expr(f"approx_top_k_accumulate(query_type, {KINDS * 10})").alias("types"),
    )


def sketched_stats(sketches: DataFrame, first: date, last: date) -> DataFrame:
    """query_stats of the days first to last from daily_sketches, without the log; unique_users within USERS_ERROR."""
    days = sketches.filter(F.col("day").between(F.lit(first), F.lit(last)))
    share = lambda total, n: F.bround(F.coalesce(F.try_divide(F.sum(total), F.sum(n)), F.lit(0.0)), 3)
    return days.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_queries"), share("time_sum", "time_n").alias("avg_processing_time"),
        share("score_sum", "score_n").alias("avg_similarity_score"), F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("users")), F.lit(0)).alias("unique_users"),
    )


def sketched_types(sketches: DataFrame, first: date, last: date, limit: int = 10) -> DataFrame:
    """top_query_types of the days first to last from daily_sketches; exact as long as there are fewer types than the
    sketches hold (7,500 of KINDS * 10)."""
    days = sketches.filter(F.col("day").between(F.lit(first), F.lit(last)))
    found = days.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(types, {KINDS * 10}), {KINDS})").alias("k"))
    rows = found.select(F.explode("k").alias("k")).select(F.col("k.item").alias("query_type"), F.col("k.count").alias("n"))
    return rows.orderBy(F.desc("n"), "query_type").limit(limit)


def peak_times(activity: DataFrame, hours: int = 3, weekdays: int = 3) -> DataFrame:
    """(kind, rank, label, n): the busiest hours and weekdays."""
    def top(label: Column, kind: str, k: int) -> DataFrame:
        rows = activity.groupBy(label.alias("label")).agg(F.count(N).alias("n"))
        ranked = rows.orderBy(F.desc("n"), "label").limit(k)
        return ranked.select(F.lit(kind).alias("kind"), F.row_number().over(Window.orderBy(F.desc("n"), "label")).alias("rank"), "label", "n")

    return top(F.format_string("%02d:00", F.hour("timestamp")), "hour", hours).unionByName(top(F.date_format("timestamp", "EEEE"), "weekday", weekdays))


def slots(queries: DataFrame, hours: int = 6) -> DataFrame:
    """(slot, n, avg_time) by stretches of the day."""
    slot = F.format_string("%02d:00", (F.floor(F.hour("timestamp") / hours) * hours).cast("int"))
    return queries.groupBy(slot.alias("slot")).agg(F.count(N).alias("n"), F.bround(F.avg("processing_time"), 3).alias("avg_time"))


def corpus_totals(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.countDistinct("doc_id").alias("documents"), F.count(N).alias("chunks"), F.bround(F.count(N) / F.greatest(F.countDistinct("doc_id"), F.lit(1)), 2).alias("chunks_per_document"))


def report(queries: DataFrame, documents: DataFrame, activity: DataFrame, performance: DataFrame, centroids: DataFrame, pairs: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """One row of JSON texts by part of the report. All parts are rows or short lists, joined last.

    centroids: doc_id, embedding; pairs: their similar pairs."""

    def row(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.to_json(F.struct(*df.columns)).alias(name))

    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*df.columns)))).alias(name))

    parts = [
        row(query_stats(queries, as_of, days), "query_stats"), row(document_stats(documents, as_of, days), "document_stats"),
        rows(daily_queries(queries, as_of, days), "daily_queries"), rows(top_query_types(queries, as_of, days), "query_types"),
        row(system_averages(performance, as_of, days), "system"), rows(latency_distribution(queries), "latency"),
        rows(slowest_queries(queries), "slowest"), rows(quality_distribution(queries), "quality"), row(suggestions(queries), "suggestions"),
        row(similarity_totals(centroids, pairs), "similarity"), rows(top_pairs(pairs), "similar_pairs"), row(active_users(activity, as_of, days), "active_users"),
        rows(activity_types(activity, as_of, days), "activity_types"), rows(hourly_profile(activity, as_of, days), "hours"),
        rows(top_users(activity, as_of, days), "top_users"), row(health(performance, as_of), "health"),
    ]
    out = parts[0].withColumn("generated_at", F.lit(as_of).cast("timestamp"))
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out
