"""Nearest neighbours by a forest of sorted hash prefixes over blocks of a common prefix."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.operators.lineage import settle

#: Trees, bits of each hash string, rows of a block, queries of a group.
TREES, BITS, BLOCK, QUERIES = 96, 24, 4096, 2048
#: Rows to be gathered from the trees of a block, repeats included, before a query stops ascending.
GATHER = 2048
#: Rows that are hashed at once.
SLICE = 4096
#: Bits of the common prefix of a block, at most; queries of the sample that tells how far queries go; and the share of
#: the sample's nearest neighbours that must lie within.
PREFIX, SAMPLE_QUERIES, REACHED = 16, 256, 0.98


def usable(vector: str) -> Column:
    """Whether a vector has components, all finite, and is not zero."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, good) & F.exists(vector, lambda x: x != 0), F.lit(False))


def planes(width: int, seed: int = 7, n: int = TREES * BITS) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, n)).astype(np.float32)


def prefixes(vectors: np.ndarray, bits: int) -> np.ndarray:
    """The common prefix of each vector's block: the signs of its products with bits planes of their own."""
    if not bits:
        return np.zeros(len(vectors), dtype=np.int64)
    return (vectors.astype(np.float32) @ planes(vectors.shape[1], 11, PREFIX)[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))


def reach(rows: np.ndarray, asked: np.ndarray, bits: int, k: int) -> int:
    """In how many bits of the prefix a query's block may differ from that of a neighbour, for a share of REACHED of
    the k nearest of rows."""
    if not len(rows) or not len(asked):
        return bits
    apart = np.maximum((asked**2).sum(axis=1)[:, None] - 2 * asked @ rows.T + (rows**2).sum(axis=1)[None, :], 0)
    near = np.argsort(apart, axis=1)[:, : k + 1]
    flips = np.bitwise_count(prefixes(asked, bits)[:, None] ^ prefixes(rows, bits)[near])
    others = flips[np.take_along_axis(apart, near, axis=1) > 1e-12]  # not the query itself
    return int(np.quantile(others, REACHED, method="higher")) if len(others) else bits


def hashes(vectors: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """n x TREES hash strings of BITS bits, the first bit highest."""
    powers = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    parts = [(vectors[at : at + SLICE].astype(np.float32) @ cut > 0).reshape(-1, TREES, BITS) @ powers for at in range(0, len(vectors), SLICE)]
    return np.concatenate(parts) if parts else np.zeros((0, TREES), dtype=np.int64)


def gather(rows: np.ndarray, asked: np.ndarray, least: int) -> list[np.ndarray]:
    """Positions in rows for each of asked (hash strings, n x TREES): from the longest prefixes upwards.

    Each tree is a sorted array, in which the rows that share a prefix are neighbours. All trees go up
    together, one bit a step, until they hold least rows, or the root is reached.
    """
    order = np.argsort(rows, axis=0, kind="stable")
    inside = np.take_along_axis(rows, order, axis=0)
    n = len(asked)
    low, high = np.zeros((n, TREES), dtype=np.int64), np.full((n, TREES), len(rows), dtype=np.int64)
    open_, depth = np.ones(n, dtype=bool), BITS
    while depth > 0 and open_.any():
        at = np.flatnonzero(open_)
        prefix = asked[at] >> (BITS - depth)
        for t in range(TREES):
            low[at, t] = np.searchsorted(inside[:, t], prefix[:, t] << (BITS - depth))
            high[at, t] = np.searchsorted(inside[:, t], (prefix[:, t] + 1) << (BITS - depth))
        open_[at] = (high[at] - low[at]).sum(axis=1) < least
        depth -= 1
    low[open_], high[open_] = 0, len(rows)
    out = []
    for q in range(n):
        mark = np.zeros(len(rows), dtype=bool)
        if open_[q]:
            mark[:] = True
        else:
            for t in np.flatnonzero(high[q] > low[q]):
                mark[order[low[q, t] : high[q, t], t]] = True
        out.append(np.flatnonzero(mark))
    return out


def search_block(asked: pd.DataFrame, rows: pd.DataFrame, k: int, far: int) -> pd.DataFrame:
    """The k nearest of a block's rows for each query whose prefix differs from the block's in far bits at most; rows:
    vector and the ids that have it. An id that has several vectors counts by its nearest."""
    if len(asked) and len(rows):
        asked = asked[np.bitwise_count(asked["prefix"].to_numpy(np.int64) ^ rows["prefix"].iloc[0]) <= far]
    if not len(asked) or not len(rows):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    v = np.array(rows["vector"].tolist(), dtype=np.float64)
    q = np.array(asked["vector"].tolist(), dtype=np.float64)
    cut = planes(v.shape[1])
    found = gather(hashes(v, cut), hashes(q, cut), GATHER)
    ids = [np.asarray(i, dtype=np.int64) for i in rows["ids"]]
    out = []
    for query, own, near in zip(asked["query_id"].tolist(), q, found, strict=True):
        d = np.sqrt(((v[near] - own) ** 2).sum(axis=1))
        most = k
        while True:  # more rows where ids are repeated
            bound = np.partition(d, most)[most] if len(d) > most + 1 else np.inf
            best: dict[int, float] = {}
            for s, i in sorted((s, i) for s, r in zip(d[d <= bound].tolist(), near[d <= bound].tolist(), strict=True) for i in ids[r].tolist() if i != query):
                best.setdefault(i, s)
            if len(best) >= k or bound == np.inf:
                break
            most *= 2
        out += [(query, i, s) for i, s in list(best.items())[:k]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def nearest_rows(rows: DataFrame, asked: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of each of a few vectors, itself left out, all in one array. The few go to all tasks, which
    scan their rows once and hand on k + 1 for each."""
    width = asked.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        few = shared.value
        best, who = np.full((len(few), k + 1), np.inf), np.zeros((len(few), k + 1, width))
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                v = np.array(batch["vector"].iloc[at : at + SLICE].tolist(), dtype=float)
                d = np.maximum((few**2).sum(axis=1)[:, None] - 2 * few @ v.T + (v**2).sum(axis=1)[None, :], 0)
                every = np.concatenate([best, d], axis=1)
                first = np.argpartition(every, k, axis=1)[:, : k + 1]
                best, old = np.take_along_axis(every, first, axis=1), first <= k
                kept = np.take_along_axis(who, np.where(old, first, 0)[:, :, None], axis=1)
                who = np.where(old[:, :, None], kept, v[np.where(old, 0, first - k - 1)])
        q, place = np.nonzero(best < np.inf)
        yield pd.DataFrame({"q": q, "d": best[q, place], "vector": list(who[q, place])})

    shared = rows.sparkSession.sparkContext.broadcast(asked)
    found = rows.select("vector").mapInPandas(run, "q long, d double, vector array<double>")
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("d"))).filter((F.col("n") <= k + 1) & (F.col("d") > 1e-12))
    return np.array([r["vector"] for r in found.select("vector").distinct().collect()], dtype=float).reshape(-1, width)


def forest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest rows found, itself left out.

    Both inputs have id_col and vector_col. Rows of one vector are folded first: each map task keeps the
    k + 1 least ids of a vector, which is all that ties let through. Distinct vectors of one length fall into blocks
    by a common prefix of up to PREFIX hash bits, and those of a full prefix by hash into blocks of about BLOCK
    rows, each with a forest of its own. A query descends to the block of its prefix and ascends to those that
    differ in as many bits as the neighbours, among all rows, of a bounded sample of queries do (reach): few where vectors cluster, nearly
    all where they are spread evenly, as no hashing helps there. Queries meet blocks in groups of up to QUERIES of one
    prefix or neighbouring ones; the table of meetings names groups and blocks only, and k rows a query of each
    meeting go on. So memory is bounded, and no pair of rows is ever written.

    Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of another
    length are never compared. Rows with a null id are left out; an id with several vectors is one candidate, by its nearest. Queries of
    one id and vector are one; those of one id and different vectors are searched each, and the k nearest ids of
    all are ranked. Other columns are not read.
    """
    pick = lambda df: df.filter(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    own = Window.partitionBy("vector").orderBy("id")
    few = pick(vectors).withColumn("n", F.row_number().over(own)).filter(F.col("n") <= k + 1)
    rows = settle(few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("w", F.size("vector")), "vectors")
    asked = settle(pick(queries).distinct().withColumn("w", F.size("vector")), "queries")
    bits, far = {}, {}
    for r in rows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect():  # one row for each length of vectors
        w, n = r["w"], r["n"]
        bits[w] = min(PREFIX, max(0, (n - 1) // BLOCK).bit_length())
        if bits[w]:
            some = asked.filter(F.col("w") == w).orderBy(F.xxhash64("vector")).limit(SAMPLE_QUERIES).select("vector").collect()
            some = np.array([x["vector"] for x in some], dtype=float).reshape(-1, w)
            far[w] = reach(nearest_rows(rows.filter(F.col("w") == w), some, k), some, bits[w], k) if len(some) else 0
    if not bits:
        return rows.select(F.lit(0).cast("long").alias("query_id"), F.lit(1).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)

    def prefixed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros(len(batch), dtype=np.int64)
            for w in batch["w"].unique():
                at = np.flatnonzero(batch["w"] == w)
                out[at] = prefixes(np.array(batch["vector"].iloc[at].tolist(), dtype=float), bits[w])
            yield batch.assign(prefix=out)

    held = F.col("w").isin(list(bits))
    rows = settle(rows.mapInPandas(prefixed, "vector array<double>, ids array<long>, w int, prefix long"), "prefixed")
    asked = settle(asked.filter(held).mapInPandas(prefixed, "id long, vector array<double>, w int, prefix long").withColumnRenamed("id", "query_id"), "asked")
    # Blocks: a prefix, or a part of one. Groups: the queries of one prefix, or of neighbouring ones where they are few.
    n_asked = {r["w"]: r["count"] for r in asked.groupBy("w").count().collect()}
    coarse = {w: max(0, b - max(0, (n_asked.get(w, 0) - 1) // QUERIES).bit_length()) for w, b in bits.items()}
    shift = F.create_map(*[F.lit(x) for pair in coarse.items() for x in pair])[F.col("w")]
    asked = asked.withColumn("lot", F.floor(F.col("prefix") / F.pow(F.lit(2.0), shift)).cast("long"))
    lots = asked.groupBy("w", "lot").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("groups"))
    asked = asked.join(F.broadcast(lots), ["w", "lot"]).withColumn("g", F.pmod(F.xxhash64("query_id", "vector"), F.col("groups"))).drop("groups")
    sizes = rows.groupBy("w", "prefix").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    rows = rows.join(F.broadcast(sizes), ["w", "prefix"]).withColumn("part", F.pmod(F.xxhash64("vector"), F.col("parts"))).drop("parts")
    # Meetings of groups and blocks, without vectors: each prefix of a group and the prefixes in reach of it.
    flips = [(w, sum(1 << x for x in c)) for w, b in bits.items() for f in range(far.get(w, 0) + 1) for c in combinations(range(b), f)]
    met = asked.select("w", "prefix", "lot", "g").distinct().join(flip_table(rows, flips), "w")
    met = met.select("w", "lot", "g", F.col("prefix").bitwiseXOR(F.col("flip")).alias("prefix")).distinct().join(sizes, ["w", "prefix"])
    met = met.select("w", "lot", "g", "prefix", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    met = settle(met, "meetings")
    group, block = ["w", "lot", "g"], ["w", "prefix", "part"]
    keys = [*group, "prefix_b", "part"]
    told = met.withColumnRenamed("prefix", "prefix_b")
    left = asked.join(told, group)
    right = rows.join(met, block).withColumn("prefix_b", F.col("prefix"))

    def meet(key: tuple, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return search_block(asked, rows, k, far.get(key[0], 0))

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def flip_table(df: DataFrame, flips: list[tuple[int, int]]) -> DataFrame:
    """(w, flip) as a table."""
    return df.sparkSession.createDataFrame(pd.DataFrame(flips, columns=["w", "flip"]).astype({"w": "int32", "flip": "int64"}), "w int, flip long")
