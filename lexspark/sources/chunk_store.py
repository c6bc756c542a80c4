"""A stored chunk table in hash buckets of ids, with a Bloom filter for each bucket, and logs kept current by bucket."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.operators.lineage import exists, forget, settle
from lexspark.operators.sieve import sieved


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class ChunkStore:
    """Chunks under root/batch=N/bucket=B, each id once, and the filters of each batch under root/_filters/batch=N.

    buckets, bits (of a bucket's filter) and hashes stay as they are for the life of a store. A filter of bits bits and
    hashes probes admits about (1 - exp(-hashes * ids / bits)) ** hashes of the ids that a bucket does not have.
    """

    root: str
    buckets: int = 256
    bits: int = 1 << 22
    hashes: int = 4

    @property
    def filters(self) -> str:
        return f"{self.root}/_filters"

    def _probes(self, ids: DataFrame) -> DataFrame:
        """(id, bucket, word, mask): the bits of each id, as masks on words of 64 bits."""
        at = F.explode(F.array(*[F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(self.bits)) for seed in range(1, self.hashes + 1)])).alias("bit")
        rows = ids.select("id", bucket_of("id", self.buckets).alias("bucket"), at)
        return rows.select("id", "bucket", F.shiftright("bit", 6).cast("int").alias("word"), F.expr("shiftleft(1L, CAST(bit % 64 AS INT))").alias("mask"))

    def suspects(self, ids: DataFrame, before: int | None = None) -> DataFrame:
        """The ids that their bucket's filter admits, of batches before the given one: all that are stored are among
        them. Only ids and words of filters are read and shuffled."""
        spark = ids.sparkSession
        if not exists(spark, self.filters):
            return ids.select("id").limit(0)
        words = spark.read.schema("bucket int, word int, bits long, batch long").parquet(self.filters)
        words = words.filter(F.col("batch") < before) if before is not None else words
        words = words.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
        probes = self._probes(ids.select("id").distinct())
        hit = probes.join(words, ["bucket", "word"], "left").withColumn("hit", F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) != 0, F.lit(False)))
        return hit.groupBy("id").agg(F.min("hit").alias("hit")).filter("hit").select("id")

    def read(self, spark: SparkSession, schema: T.StructType | None = None) -> DataFrame:
        """All chunks, with their batch and bucket."""
        return (spark.read.schema(schema) if schema else spark.read).parquet(self.root)

    def stored(self, ids: DataFrame, before: int | None = None) -> tuple[DataFrame, list[int]]:
        """(the ids that the store has, the buckets that were read for it): those of suspects only."""
        found = settle(self.suspects(ids, before).withColumn("bucket", bucket_of("id", self.buckets)), "suspects")
        opened = sorted(r["bucket"] for r in found.select("bucket").distinct().collect())
        if not opened:
            return found.select("id"), []
        kept = self.read(ids.sparkSession, T.StructType().add("id", "string").add("batch", "long").add("bucket", "integer")).filter(F.col("bucket").isin(opened))
        kept = kept.filter(F.col("batch") < before) if before is not None else kept
        return found.select("id").join(kept.select("id"), "id", "left_semi"), opened

    def add(self, chunks: DataFrame, batch: int) -> list[int]:
        """Add the chunks whose id neither the store nor an earlier row of chunks has; returns the buckets read.

        A batch that is added again replaces itself: only earlier batches count as stored. Chunks with a null id are
        left out, of several chunks with one id the first by all columns stays. Only buckets whose filter admits
        an id of the batch are read, and of these the ids alone.
        """
        rest = [c for c, kind in chunks.dtypes if c not in ("id", "bucket", "batch") and not kind.startswith("map")]
        kept = [c for c in chunks.columns if c not in ("bucket", "batch")]
        rows = settle(chunks.select(*kept).filter("id is not null").withColumn("id", F.col("id").cast("string")), "batch")
        known, opened = self.stored(rows, batch)
        known = settle(known, "known")
        # Stored rows go first, then the others are shuffled once, to their buckets, where equal ids meet
        maybe, fresh = sieved(rows, F.xxhash64("id"), known.select(F.xxhash64("id").alias("key")), "key")
        fresh = fresh.unionByName(maybe.join(known.hint("shuffle_hash"), "id", "left_anti")).withColumn("bucket", bucket_of("id", self.buckets)).repartition("bucket")
        first = F.min_by(F.struct(*kept), F.struct(*rest) if rest else F.lit(0)).alias("row")
        fresh.groupBy("bucket", "id").agg(first).select("row.*", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/batch={batch}")
        forget(rows, known)
        written = chunks.sparkSession.read.schema("id string, bucket int").parquet(f"{self.root}/batch={batch}")
        words = self._probes(written.select("id")).groupBy("bucket", "word").agg(F.bit_or("mask").alias("bits"))
        words.coalesce(1).write.mode("overwrite").parquet(f"{self.filters}/batch={batch}")
        return opened


@dataclass(frozen=True)
class KeyedLog:
    """A log under root/bucket=B, by hash of its key, that keeps the last row of each key."""

    root: str
    key: str
    order: str
    buckets: int = 64

    def read(self, spark: SparkSession, schema: T.StructType | str | None = None) -> DataFrame:
        return (spark.read.schema(schema) if schema else spark.read).parquet(self.root)

    def merge(self, new: DataFrame) -> list[int]:
        """Keep the last row of each key, by order then by all columns, of the log and new; returns the buckets written.

        Only buckets of new's keys are read and rewritten, by dynamic partition overwrite, so the files of others stay.
        The order of a row may change with its other columns, its bucket cannot. Merging the same rows again
        changes nothing. The merged rows are written beside the log first, so a job that fails leaves the log as it was.
        """
        spark = new.sparkSession
        rows = settle(new.filter(F.col(self.key).isNotNull()).withColumn("bucket", bucket_of(self.key, self.buckets)), "new")
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())
        if not touched:
            return []
        every = rows
        if exists(spark, self.root):
            every = self.read(spark, rows.schema).filter(F.col("bucket").isin(touched)).unionByName(rows)
        rest = [c for c in rows.columns if c not in (self.key, self.order, "bucket")]
        last = every.groupBy(self.key, "bucket").agg(F.max(F.struct(self.order, *rest)).alias("last"))
        merged = settle(last.select(self.key, "last.*", "bucket").select(*rows.columns), "merged")
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.root)
        return touched
