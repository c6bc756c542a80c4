"""Similarity between documents: centroids, pairs above a threshold, bands, clusters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.functions.vectors import norm
from lexspark.operators.components import connected_components
from lexspark.operators.lineage import settle, spread

#: Documents of a block; a task compares two blocks. Pivots that documents are grouped around, at most.
BLOCK, PIVOTS = 2000, 2048
#: Vectors of one value of a band that bits_for takes for a copy; parts that meet may be larger (part_size).
PART = 8000
#: Bytes of vectors of a part, of which two meet in one task where a band's value is shared by many, BLOCK vectors at least;
#: vectors of a tile, of which two are multiplied at once; pairs whose cosine is worked out in full at once.
PART_BYTES, TILE, CHECKED = 8 << 20, 1024, 1 << 14
#: Tasks to a core, at most, that pairs of parts are dealt to.
TASKS = 64



def centroids(chunks: DataFrame, dimension: int) -> DataFrame:
    """(doc_id, embedding): the mean of each document's chunk vectors, combined before the shuffle."""
    means = [F.avg(F.get("embedding", F.lit(i)).cast("double")).alias(f"m{i}") for i in range(dimension)]
    every = chunks.filter("embedding is not null").groupBy("doc_id").agg(*means)
    return every.select("doc_id", F.array(*[F.col(f"m{i}") for i in range(dimension)]).alias("embedding"))


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows at length one; rows without length stay."""
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def _rows(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def near_blocks(pivots: np.ndarray, reach: np.ndarray, least: float) -> np.ndarray:
    """i <= j (n x 2) of groups that may hold a pair of cosine least: pivots at length one, reach the greatest
    angle of a group's members to its pivot. Angles between vectors obey the triangle inequality, so no pair
    is lost."""
    apart = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    near = apart <= np.arccos(np.clip(least, -1, 1)) + reach[:, None] + reach[None, :] + 1e-9
    return np.argwhere(np.triu(near))


def similar_documents(docs: DataFrame, least: float = 0.7, new: Column | None = None) -> DataFrame:
    """(doc1_id, doc2_id, similarity_score) of pairs doc1_id < doc2_id at least that similar by cosine.

    docs: doc_id, embedding. Documents are grouped around the nearest of at most PIVOTS of their own vectors,
    groups in blocks of about BLOCK. Two blocks meet in one task only if the angles of their groups allow a
    similar pair, so clustered vectors meet few others, and every pair is found all the same. A task multiplies
    two matrices and returns the pairs above the threshold only. Vectors without length are similar to
    nothing (to all, if least is not above 0). Repeated rows are compared like others.

    new, a condition on docs, limits the pairs to those that it holds for one document of at least: what new documents
    add to the pairs of a collection. Documents that it does not hold for lie in blocks of their own, which do not
    meet each other.
    """
    fresh = F.lit(True) if new is None else F.coalesce(new, F.lit(False))
    held = docs.filter("embedding is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"), fresh.alias("new"))
    rows = settle(held, "documents")
    n = rows.count()
    wanted = min(PIVOTS, max(1, n // BLOCK))
    chosen = rows.filter(F.exists("embedding", lambda x: x != 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(wanted).toPandas()
    spark, empty = docs.sparkSession, not len(chosen)
    shared = spark.sparkContext.broadcast(np.zeros((1, 1)) if empty else _unit(_rows(chosen["embedding"])))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots = shared.value
        for batch in batches:
            if len(batch):
                v = _unit(_rows(batch["embedding"]))
                score = v @ pivots.T if v.shape[1] == pivots.shape[1] else np.zeros((len(v), 1))
                own = score.argmax(axis=1)
                yield batch.assign(own=own, angle=np.arccos(np.clip(score[np.arange(len(v)), own], -1, 1)))

    reach, parts = np.full(len(shared.value), -1.0), np.ones(len(shared.value), dtype=int)
    if wanted == 1:  # one group meets itself, whatever its angles
        grouped, reach[0], parts[0] = rows.withColumns({"own": F.lit(0), "angle": F.lit(np.pi)}), np.pi, -(-n // BLOCK) or 1
    else:
        grouped = settle(rows.mapInPandas(assign, "doc_id long, embedding array<double>, new boolean, own int, angle double"), "groups")
        for r in grouped.groupBy("own").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n")).collect():  # one row a pivot
            reach[r["own"]], parts[r["own"]] = r["angle"], -(-r["n"] // BLOCK)
    held = np.flatnonzero(reach >= 0)
    pairs = held[near_blocks(shared.value[held], reach[held], least)]
    meets = spark.createDataFrame(pd.DataFrame(pairs, columns=["i", "j"]).astype("int32"), "i int, j int")
    sizes = F.array(*[F.lit(int(k)) for k in parts])
    # Blocks of new documents have even numbers, those of others odd ones; two odd blocks do not meet.
    block = F.pmod(F.xxhash64("doc_id"), sizes[F.col("own")]).cast("int") * 2 + F.when(F.col("new"), 0).otherwise(1)
    placed = grouped.withColumn("block", block)
    step = 2 if new is None else 1
    every = lambda end: F.explode(F.sequence(F.lit(0), sizes[F.col(end)] * 2 - 1, F.lit(step)))
    one = placed.join(meets, placed["own"] == meets["i"]).select("doc_id", "embedding", "i", "j", F.col("block").alias("a"), every("j").alias("b"), F.lit(0).alias("side"))
    two = placed.join(meets, placed["own"] == meets["j"]).select("doc_id", "embedding", "i", "j", every("i").alias("a"), F.col("block").alias("b"), F.lit(1).alias("side"))
    met = one.unionByName(two).filter((F.col("i") != F.col("j")) | (F.col("a") <= F.col("b"))).filter((F.col("a") % 2 == 0) | (F.col("b") % 2 == 0))

    def meet(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        i, j, a, b = key
        left, right = part[part["side"] == 0], part[part["side"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"doc1_id": [], "doc2_id": [], "similarity_score": []})
        score = _unit(_rows(left["embedding"])) @ _unit(_rows(right["embedding"])).T
        ids, others = left["doc_id"].to_numpy(), right["doc_id"].to_numpy()
        x, y = np.nonzero((score >= least) & ((ids[:, None] < others[None, :]) if (i, a) == (j, b) else (ids[:, None] != others[None, :])))
        return pd.DataFrame({"doc1_id": np.minimum(ids[x], others[y]), "doc2_id": np.maximum(ids[x], others[y]), "similarity_score": score[x, y]})

    return met.groupBy("i", "j", "a", "b").applyInPandas(meet, "doc1_id long, doc2_id long, similarity_score double")


def bands_for(least: float, bits: int, recall: float) -> int:
    """How many bands of bits signs each two vectors of cosine least need to share one with a chance of recall."""
    same = (1 - np.arccos(np.clip(least, -1, 1)) / np.pi) ** bits
    return max(1, int(np.ceil(np.log(1 - recall) / np.log1p(-same)))) if same < 1 else 1


def bits_for(n: int, least: float, recall: float) -> int:
    """How many signs to a band send the fewest copies of n vectors to tasks: a vector goes to each band, and in it to
    each part of the vectors that share its value. Without signs (0) one band holds all vectors, so all are compared."""
    spare = int(np.clip(np.ceil(np.log2(max(n, 2) / 32)), 4, 24))  # some tens of unlike vectors to a value
    return min((0, *range(4, spare + 1)), key=lambda k: (bands_for(least, k, recall) * max(1.0, n / 2**k / PART), -k))


def part_size(n: int, row_bytes: int, cores: int) -> int:
    """How many of n vectors make a part: so few that pairs of parts, four to a core, keep all cores busy, and no more
    than PART_BYTES, but a BLOCK at least. Each part meets each other, so fewer parts send fewer copies."""
    return int(np.clip(np.ceil(n / np.sqrt(8 * cores)), BLOCK, max(BLOCK, PART_BYTES // row_bytes)))


def _frame(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    one, two, score = map(np.concatenate, zip(*found, strict=True))
    return pd.DataFrame({"doc1_id": np.minimum(one, two), "doc2_id": np.maximum(one, two), "similarity_score": score})


def pairs_within(one: np.ndarray, two: np.ndarray | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of one, rows of two, cosines) at least that similar, CHECKED pairs at a time at most; without two, each two
    rows of one once. one and two have rows at length one.

    Tiles are multiplied in single precision; what could reach least by the error bound of that is worked out in
    double precision, which decides."""
    other = one if two is None else two
    left = one.astype(np.float32)
    right = left if two is None else two.astype(np.float32)
    bound = np.float32(least - (one.shape[1] + 8) * 2.0**-24)
    room = min(TILE, len(left)) * min(TILE, len(right))
    product, near = np.empty(room, np.float32), np.empty(room, bool)
    for i in range(0, len(left), TILE):
        for j in range(i if two is None else 0, len(right), TILE):
            a, b = left[i : i + TILE], right[j : j + TILE]
            size = len(a) * len(b)
            np.matmul(a, b.T, out=product[:size].reshape(len(a), len(b)))
            at = np.flatnonzero(np.greater_equal(product[:size], bound, out=near[:size]))
            for k in range(0, len(at), CHECKED):
                x, y = np.divmod(at[k : k + CHECKED], len(b))
                x, y = x + i, y + j
                if two is None and i == j:
                    x, y = x[x < y], y[x < y]
                score = np.einsum("ij,ij->i", one[x], other[y])
                kept = score >= least
                yield x[kept], y[kept], score[kept]


def similar_documents_banded(docs: DataFrame, least: float = 0.7, bits: int | None = None, recall: float = 0.95, seed: int = 7) -> DataFrame:
    """(doc1_id, doc2_id, similarity_score) of pairs doc1_id < doc2_id at least that similar by cosine: each with a
    chance of recall or more, and no others.

    docs: doc_id, embedding. A vector's signs on random directions are cut into bands of bits each; vectors that agree
    in a whole band meet, and their exact cosine decides. Two vectors of cosine least agree in enough bands
    (bands_for). More bits keep unlike vectors apart, at the price of more bands, each of which gets a copy of every
    vector; by default as many as send the fewest copies (bits_for). Where a low threshold or a high recall asks for
    more bands than there are parts of all vectors, that is none: all parts meet, and no pair is left out. Values that
    many vectors share are met in parts (part_size), each two of which are a task's work, and a pair is given by the
    first band that it shares only, so nothing is deduplicated. Vectors without length and rows without doc_id are left out;
    repeated rows are compared like others; an empty table gives no rows.
    """
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))
    kind = "float" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "double"  # floats travel as such
    number = np.dtype(np.float32 if kind == "float" else np.float64)
    rows = settle(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding")), "documents")
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    bits = bits_for(n, least, recall) if bits is None else bits
    bands = bands_for(least, bits, recall)
    cores = docs.sparkSession.sparkContext.defaultParallelism

    def signs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.iloc[at : at + BLOCK]
                v = _rows(part["embedding"])
                cut = np.random.default_rng(seed).standard_normal((v.shape[1], bands * bits))
                keys = (v @ cut > 0).reshape(len(v), bands, bits) @ powers  # all 0 without signs
                yield pd.DataFrame({"doc_id": part["doc_id"], "vector": [x.tobytes() for x in v.astype(number)], "keys": list(keys)})

    keyed = settle(spread(rows).mapInPandas(signs, "doc_id long, vector binary, keys array<long>"), "signs")
    sizes = keyed.select(F.posexplode("keys").alias("band", "key")).groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / part_size(n, width * number.itemsize, cores)).cast("long")
    sizes = settle(sizes.select("band", "key", parts.alias("parts")), "sizes")
    meetings, lone = sizes.agg(F.sum(F.when(F.col("parts") > 1, F.expr("parts * (parts + 1) div 2"))), F.count_if(F.col("parts") == 1)).first()

    def meet(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        band, _, a, b, _ = key
        read = []
        for part in batches:
            v, keys = np.frombuffer(b"".join(part["vector"]), dtype=number).reshape(len(part), -1), np.array(part["keys"].tolist(), dtype=np.int64)
            read.append((part["own"].to_numpy(), part["doc_id"].to_numpy(), v, keys[:, :band]))
        own, ids, v, keys = map(np.concatenate, zip(*read, strict=True))
        sides = [np.flatnonzero(own == k) for k in ((a,) if a == b else (a, b))]
        units = [_unit(v[side].astype(np.float64)) for side in sides]
        del read, v
        found, held = [], 0
        for x, y, score in pairs_within(units[0], None if a == b else units[1], least):
            x, y = sides[0][x], sides[-1][y]
            kept = ids[x] != ids[y]
            if band:
                kept &= ~(keys[x] == keys[y]).any(axis=1)
            found.append((ids[x[kept]], ids[y[kept]], score[kept]))
            held += len(found[-1][0])
            if held >= CHECKED:
                yield _frame(found)
                found, held = [], 0
        if held:
            yield _frame(found)

    def met(placed: DataFrame) -> DataFrame:
        return placed.groupBy("band", "key", "a", "b", "meeting").applyInPandas(meet, "doc1_id long, doc2_id long, similarity_score double")

    placed, none, every = keyed.select("*", F.posexplode("keys").alias("band", "key")), F.lit(0), []
    if lone or not meetings:
        every.append(met(placed.join(sizes.filter("parts = 1"), ["band", "key"]).drop("parts").withColumns({"own": none, "a": none, "b": none, "meeting": none})))
    if meetings:
        # A part meets itself and the others: its rows go to each such pair of parts. Dealt by value alone, all pairs of a value would be one task's.
        many = placed.join(F.broadcast(sizes.filter("parts > 1")), ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
        many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")})
        tasks = min(meetings, TASKS * cores)
        meeting = F.pmod(F.pmod(F.xxhash64("band", "key"), F.lit(tasks)) + F.expr("b * (b + 1) div 2 + a"), F.lit(tasks)).cast("int")
        every.append(met(many.drop("parts", "other").withColumn("meeting", meeting).repartitionById(tasks, "meeting")))
    return reduce(DataFrame.unionByName, every)


def most_similar(pairs: DataFrame, k: int = 10) -> DataFrame:
    """(doc_id, rank, other_id, similarity_score): each document's k most similar, ties to the lesser id."""
    both = pairs.select(F.col("doc1_id").alias("doc_id"), F.col("doc2_id").alias("other_id"), "similarity_score").unionByName(
        pairs.select(F.col("doc2_id").alias("doc_id"), F.col("doc1_id").alias("other_id"), "similarity_score")
    )
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("similarity_score"), "other_id"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k).select("doc_id", "rank", "other_id", "similarity_score")


def highest_similarity(docs: DataFrame, pairs: DataFrame | None = None, start: float = 0.7) -> float:
    """The highest cosine of any two of docs; 0 if there are fewer than two.

    pairs, of similar_documents, tell it if there are any. Else the threshold is halved until some pair reaches it,
    then dropped to the least cosine there is: the higher the maximum, the fewer documents have to meet."""
    most = pairs.agg(F.max("similarity_score")).first()[0] if pairs is not None else None
    for least in (start, start / 2, start / 4, 0.0, -1.0) if most is None else ():
        most = similar_documents(docs, least).agg(F.max("similarity_score")).first()[0]
        if most is not None:
            break
    return float(most or 0.0)


def similarity_totals(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row over all comparisons of docs (doc_id, embedding): avg_similarity, max_similarity, total_comparisons.

    The sum of all cosines is linear in the documents: half of the squared length of the sum of their unit
    vectors, less half of the sum of their own squares. Vectors without length are at 0 to all others. pairs,
    of similar_documents at any threshold, tell the maximum; where they are none, lower thresholds are tried.
    """
    size = norm(F.col("embedding"))
    unit = docs.select("doc_id", F.posexplode(F.transform("embedding", lambda x: F.when(size == 0, 0.0).otherwise(x.cast("double") / size))).alias("at", "x"))
    per = unit.groupBy("at").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("own"))
    total = per.agg(F.coalesce((F.sum(F.col("s") * F.col("s")) - F.sum("own")) / 2, F.lit(0.0)).alias("total"))
    n = docs.filter("embedding is not null").agg(F.count(F.lit(1)).alias("n")).select((F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n"))
    row = total.crossJoin(n).withColumn("max_similarity", F.lit(highest_similarity(docs, pairs)))  # one row each
    return row.select((F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0)).alias("avg_similarity"), "max_similarity", F.col("n").alias("total_comparisons"))


def top_pairs(pairs: DataFrame, above: float = 0.7, limit: int = 20) -> DataFrame:
    return pairs.filter(F.col("similarity_score") > above).orderBy(F.desc("similarity_score"), "doc1_id", "doc2_id").limit(limit)


def band(score: Column, of_pairs: bool = True) -> Column:
    """high, medium or low; pairs are held to stricter bounds than the matches of one document."""
    high, medium = (0.9, 0.8) if of_pairs else (0.8, 0.6)
    return F.when(score > high, "high").when(score > medium, "medium").otherwise("low")


def grown_clusters(found: DataFrame, pairs: DataFrame, above: float = 0.8) -> DataFrame:
    """clusters of old and new pairs, from the clusters found (doc_id, cluster_id) of the old and the new pairs alone.

    New pairs are taken between clusters, so what is connected anew is as large as the new pairs."""
    edges = settle(pairs.filter(F.col("similarity_score") > above).select(F.col("doc1_id").alias("src"), F.col("doc2_id").alias("dst")), "edges")
    known = found.select("doc_id", "cluster_id")
    lone = edges.select(F.explode(F.array("src", "dst")).alias("doc_id")).distinct().join(known, "doc_id", "left_anti")
    for end in ("src", "dst"):
        own = known.select(F.col("doc_id").alias(end), F.col("cluster_id").alias("own"))
        edges = edges.join(own, end, "left").withColumn(end, F.coalesce("own", end)).drop("own")
    joined = settle(connected_components(edges), "joined")
    every = known.unionByName(lone.select("doc_id", F.col("doc_id").alias("cluster_id")))
    every = every.join(joined.select(F.col("node").alias("cluster_id"), "component"), "cluster_id", "left")
    every = every.select("doc_id", F.coalesce("component", "cluster_id").alias("cluster_id"))
    sizes = every.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    return every.join(sizes, "cluster_id").select("doc_id", "cluster_id", "cluster_size")


def clusters(pairs: DataFrame, above: float = 0.8) -> DataFrame:
    """(doc_id, cluster_id, cluster_size) of documents linked by pairs above the threshold."""
    edges = pairs.filter(F.col("similarity_score") > above).select(F.col("doc1_id").alias("src"), F.col("doc2_id").alias("dst"))
    found = connected_components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster_id"))
    sizes = found.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    return found.join(sizes, "cluster_id").select("doc_id", "cluster_id", "cluster_size")
