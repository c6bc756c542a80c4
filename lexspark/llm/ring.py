"""Shards by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only."""

from __future__ import annotations

import json

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexspark.operators.lineage import settle

#: The ring has 2 ** SLOT_BITS slots; virtual nodes sit on slots, keys hash to slots.
SLOT_BITS = 12
#: Different rows of one slot that are ranked in one task, about; or one in PARTS of all, so that parts are bounded.
RANKED, PARTS = 20_000, 1 << 15
#: Equal rows that are told apart in one task.
CHUNK = 100_000


def ring_nodes(shards: int, virtual: int, slots: int) -> list[tuple[int, int]]:
    """(slot, shard) of each virtual node, clockwise. A node whose slot is taken moves to the next free one."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(virtual):
            at = xxhash.xxh64_intdigest(f"{shard}/{v}".encode(), 42) % slots
            while at in taken:
                at = (at + 1) % slots
            taken[at] = shard
    return sorted(taken.items())


def allot(loads: list[int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(slot, first rank, last rank + 1, shard, place of the first) for keys counted by slot.

    Keys go to the next node clockwise from their slot. A shard takes keys, those of the lowest slot first, until
    its room is used; the rest of them continue clockwise, node by node.
    """
    room, used = list(room), [0] * len(room)
    waiting: list[list[tuple[int, int, int]]] = [[] for _ in nodes]
    node = 0
    for slot, n in enumerate(loads):
        while node < len(nodes) and nodes[node][0] < slot:
            node += 1
        if n:
            waiting[node % len(nodes)].append((slot, 0, n))
    out = []
    while any(waiting):
        onward: list[list[tuple[int, int, int]]] = [[] for _ in nodes]
        for at, (_, shard) in enumerate(nodes):
            for slot, a, b in waiting[at]:
                take = min(b - a, room[shard])
                if take:
                    out.append((slot, a, a + take, shard, used[shard]))
                    room[shard] -= take
                    used[shard] += take
                if a + take < b:
                    onward[(at + 1) % len(nodes)].append((slot, a + take, b))
        waiting = onward
    return out


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Room of each shard: the mean and slack times more, rounded up; without slack the mean rounded up
    for as many shards as have to, and rounded down for the others."""
    if slack > 0:
        return [-(-int(rows * (1 + slack) + 0.999999) // shards)] * shards
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def ring_shards(
    docs: DataFrame,
    shards: int = 16,
    virtual: int = 64,
    slack: float = 0.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of docs.

    The key is the id (of a null id: its text's checksum and size). slack 0 lets counts differ by one at
    most; more slack moves fewer rows when the number of shards changes. size is the UTF-8 bytes of the
    text and 1, slot counts each shard's rows from 0. Only the counts of the ring's slots and of their parts, a fixed
    number, reach the driver; ranks within a slot are the only sort, and texts are never shuffled. Places depend on
    the rows alone, not on how they are dealt out. An
    empty table gives an empty result; repeated rows each get a place; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("null"), "text_crc32", "size")).otherwise(F.xxhash64("doc_id"))
    rows = rows.withColumn("at", F.shiftrightunsigned(spread, 64 - SLOT_BITS).cast("int"))
    # Rows that are alike in all three columns can change places unseen, so one row with their number stands for them.
    # Within a slot such rows come by a hash of all three: in ranges of it, which are ranked apart, and the same at any
    # number of ranges.
    keys = rows.groupBy("at", "doc_id", "text_crc32", "size").agg(F.count(F.lit(1)).alias("n"))
    keys = settle(keys.withColumn("h", F.shiftrightunsigned(F.xxhash64("text_crc32", "size", "doc_id"), 1)), "keys")
    slots = 1 << SLOT_BITS
    loads, held = [0] * slots, [0] * slots
    for r in keys.groupBy("at").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys")).collect():
        loads[r["at"]], held[r["at"]] = r["n"], r["keys"]
    parts = allot(loads, ring_nodes(shards, virtual, slots), capacities(sum(loads), shards, slack))
    kind = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("at", "first", "last", "shard", "place")]))
    given = json.dumps([dict(zip(("at", "first", "last", "shard", "place"), p, strict=True)) for p in parts])
    table = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(given), kind)))
    table = table.withColumn("at", F.col("at").cast("int"))
    few = max(RANKED, sum(held) // PARTS)
    full = {at: (n // few).bit_length() for at, n in enumerate(held) if n > few}  # bits of h that tell the ranges of a slot
    part, before = F.lit(0).cast("long"), None
    if full:
        bits = F.create_map(*[F.lit(x) for pair in full.items() for x in pair])[F.col("at")]
        part = F.coalesce(F.expr("shiftright(h, 43)") * F.pow(F.lit(2), bits) / F.lit(1 << 20), F.lit(0)).cast("long")
    parted = keys.withColumn("part", part)
    if full:
        counts, sums = {}, []
        for r in parted.filter(F.col("at").isin(list(full))).groupBy("at", "part").agg(F.sum("n").alias("n")).collect():
            counts[r["at"], r["part"]] = r["n"]
        for at, k in full.items():
            total = 0
            for p in range(1 << k):
                sums.append({"at": at, "part": p, "before": total})
                total += counts.get((at, p), 0)
        before = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(sums)), "array<struct<at:int,part:long,before:long>>")))
    own = Window.partitionBy("at", "part").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = parted.withColumn("rank", F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    if before is not None:
        ranked = ranked.join(F.broadcast(before), ["at", "part"], "left").withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    ranked = settle(ranked.select("at", "doc_id", "text_crc32", "size", "rank", "n"), "ranked")
    several = lambda df, n: df.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    few_alike = several(ranked.filter(F.col("n") <= CHUNK), F.col("n")).withColumn("rank", F.col("rank") + F.col("copy"))
    chunks = several(ranked.filter(F.col("n") > CHUNK), F.ceil(F.col("n") / CHUNK)).withColumn("rank", F.col("rank") + F.col("copy") * CHUNK)
    chunks = chunks.withColumn("n", F.least(F.lit(CHUNK), F.col("n") - F.col("copy") * CHUNK)).repartition("doc_id", "text_crc32", "size", "copy")
    every = few_alike.unionByName(several(chunks, F.col("n")).withColumn("rank", F.col("rank") + F.col("copy")))
    ranked = every.drop("n", "copy")
    placed = ranked.join(F.broadcast(table), (ranked["at"] == table["at"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    return placed.select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("place") + F.col("rank") - F.col("first")).alias("slot")
    )


def document_shards(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of all documents, under the law of rows."""
    return ring_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
