"""Hard negatives by inner product: clusters of anchors walk shared lists of candidates, sorted by angular bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexspark.operators.lineage import forget, settle

#: Rows by cell, cells of vectors of one length at most, and rows of the sample that the cells' centres are fitted on.
CELL, CELLS, SAMPLE = 16384, 256, 20_000
#: Candidates of a block and anchors of a cluster, at most about; first candidates of a list that are met at once (then
#: twice as many each time, as long as scores of all anchors stay within MATRIX).
BLOCK, CLUSTER, STEP, MATRIX = 16384, 2048, 64, 1 << 21
#: What rounding may take from an angle or add to a bound.
SLACK = 1e-6
NONE = np.iinfo(np.int64).max
KEY = ["w", "cell", "part"]


def finite(vector: Column) -> Column:
    """Whether a vector is not null and all its components are finite."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, good), F.lit(False))


def packed(vectors: np.ndarray) -> list[bytes]:
    """Each row's integers in 2 bytes if they fit, else in 8."""
    small = (vectors == vectors.astype("<i2")).all(axis=1) if vectors.shape[1] else np.ones(len(vectors), dtype=bool)
    return [v.astype("<i2" if s else "<i8").tobytes() for v, s in zip(vectors, small.tolist(), strict=True)]


def unpacked(sources: list[bytes], width: int) -> np.ndarray:
    """The rows of packed vectors of width components."""
    out = np.zeros((len(sources), width), dtype=np.int64)
    short = np.fromiter((len(s) == 2 * width for s in sources), dtype=bool, count=len(sources))
    for kind, mine in (("<i2", short), ("<i8", ~short)):
        if width and mine.any():
            out[mine] = np.frombuffer(b"".join([s for s, m in zip(sources, mine.tolist(), strict=True) if m]), dtype=kind).reshape(-1, width)
    return out


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, norms); zero vectors stay zero."""
    norms = np.linalg.norm(vectors.astype(float), axis=1)
    return vectors / np.where(norms > 0, norms, 1)[:, None], norms


def angles(units: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The angle of each unit vector to a unit centre; 0 for zero vectors."""
    return np.where(units.any(axis=1), np.arccos(np.clip(units @ centre, -1, 1)), 0.0)


def centres(sample: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """n unit centres of a sample's directions (spherical k-means)."""
    units, _ = unit(sample)
    now = units[np.linspace(0, len(units) - 1, n).astype(int)]
    for _ in range(rounds):
        near = (units @ now.T).argmax(axis=1)
        sums = np.zeros_like(now)
        np.add.at(sums, near, units)
        fresh, norms = unit(sums)
        now = np.where(norms[:, None] > 0, fresh, now)
    return now


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: by floating point where every sum is exact there."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2**53 else a @ b.T


def bounds(asked: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, bound): the list's order by falling bound. No member of asked has a larger product with a row than its
    own norm times the row's bound, the row's norm times the cosine of the least angle that the row's angle to the
    cluster's centre and the widest member's allow."""
    units, _ = unit(asked)
    centre = unit(units.sum(axis=0, keepdims=True))[0][0]
    wide = angles(units, centre).max(initial=0)
    rows, norms = unit(listed)
    least = np.maximum(0, angles(rows, centre) - wide - SLACK)
    bound = norms * np.where(rows.any(axis=1) & (centre.any()), np.cos(least), 1.0)
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


def walk(asked: np.ndarray, listed: np.ndarray, need: np.ndarray, take: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> int:
    """Every member of asked walks the list, which is sorted for all of them once, until the bound of what follows is
    under its need. take(member, row, score) gets what reaches the needs as arrays, and returns the needs anew.
    Returns how many products were formed."""
    order, bound = bounds(asked, listed)
    _, norms = unit(asked)
    at, step, met = 0, STEP, 0
    while at < len(order):
        going = np.flatnonzero(norms * bound[at] * (1 + SLACK) + SLACK >= need)
        if not len(going):
            break
        part = order[at : at + min(step, max(1, MATRIX // len(going)))]
        scores = products(asked[going], listed[part])
        met += scores.size
        row, column = np.nonzero(scores >= need[going][:, None])
        need = take(going[row], part[column], scores[row, column])
        at, step = at + len(part), 2 * step
    return met


def first_of(member: np.ndarray, score: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each member, by falling score, then rising first; in that order."""
    order = np.lexsort((first, -score, member))
    who = member[order]
    begin = np.flatnonzero(np.append(True, who[1:] != who[:-1])[: len(who)])
    place = np.arange(len(who)) - np.repeat(begin, np.diff(np.append(begin, len(who))))
    return order[place < k]


def kth(member: np.ndarray, score: np.ndarray, k: int, need: np.ndarray) -> np.ndarray:
    """The k-th best score of each member, from what first_of has left; need where there are fewer."""
    begin = np.flatnonzero(np.append(True, member[1:] != member[:-1])[: len(member)])
    full = np.diff(np.append(begin, len(member))) >= k
    out = need.copy()
    at = begin[full]
    out[member[at]] = np.maximum(out[member[at]], score[at + k - 1])
    return out


class Block:
    """Candidates of a block: vectors, labels, and up to a few least ids of each (those that follow are NONE)."""

    def __init__(self, rows: pd.DataFrame, width: int) -> None:
        self.vectors = unpacked(rows["v"].tolist(), width)
        self.labels = rows["label"].to_numpy(np.int64)
        counts = rows["ids"].map(len).to_numpy() // 8
        self.ids = np.full((len(rows), int(counts.max(initial=1))), NONE)
        self.ids[np.arange(self.ids.shape[1]) < counts[:, None]] = np.frombuffer(b"".join(rows["ids"]), dtype="<i8")


def positives(asked: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """(a, score, id): the k first rows of an anchor's label and another id, of those of a block that reach its need."""
    found: list[pd.DataFrame] = []
    width = int(asked["w"].iloc[0]) if len(asked) else 0
    block = Block(rows, width)
    for label, mine in asked.groupby("label"):
        at = np.flatnonzero(block.labels == label)
        own, vectors = mine["id"].to_numpy(np.int64), unpacked(mine["v"].tolist(), width)
        floor = mine["need"].to_numpy(np.int64)
        held = (np.zeros(0, np.int64),) * 3

        def take(member: np.ndarray, row: np.ndarray, score: np.ndarray, own=own, at=at, floor=floor) -> np.ndarray:
            nonlocal held
            ids = block.ids[at[row]]
            first = np.where(ids[:, 0] == own[member], ids[:, 1] if ids.shape[1] > 1 else NONE, ids[:, 0])
            fine = first != NONE  # else the anchor's own row alone
            pool = [np.concatenate([x, y[fine]]) for x, y in zip(held, (member, row, score), strict=True)]
            ids = block.ids[at[pool[1]]]
            first = np.where(ids[:, 0] == own[pool[0]], ids[:, 1] if ids.shape[1] > 1 else NONE, ids[:, 0])
            best = first_of(pool[0], pool[2], first, k)
            held = tuple(x[best] for x in pool)
            return kth(held[0], held[2], k, floor)

        walk(vectors, block.vectors[at], floor, take)
        member, row, score = held
        ids = block.ids[at[row]]
        entry, place = np.nonzero((ids != NONE) & (ids != own[member][:, None]))
        best = first_of(member[entry], score[entry], ids[entry, place], k)
        found.append(pd.DataFrame({"a": mine["a"].to_numpy(np.int64)[member[entry][best]], "score": score[entry][best], "id": ids[entry, place][best]}))
    return pd.concat(found) if found else pd.DataFrame({"a": [], "score": [], "id": []}, dtype=np.int64)


def within(score: np.ndarray, positive: np.ndarray, low: int, high: int) -> np.ndarray:
    """Whether low percent of the positive's score are reached, and high percent not exceeded."""
    return (low * positive <= 100 * score) & (100 * score <= high * positive)


def negatives(asked: pd.DataFrame, rows: pd.DataFrame, k: int, low: int, high: int) -> pd.DataFrame:
    """(a, place, score, id): for each positive of an anchor, told by its place among the scores p, the k first rows of
    another label within its limits, of those of a block that reach the positive's need."""
    width = int(asked["w"].iloc[0]) if len(asked) else 0
    block = Block(rows, width)
    labels, vectors = asked["label"].to_numpy(np.int64), unpacked(asked["v"].tolist(), width)
    most = int(asked["p"].map(len).max()) if len(asked) else 0
    scores, floor = np.zeros((len(asked), most), dtype=np.int64), np.full((len(asked), most), NONE)
    for x, (p, need) in enumerate(zip(asked["p"], asked["needs"], strict=True)):
        scores[x, : len(p)], floor[x, : len(p)] = p, need
    held = [(np.zeros(0, np.int64),) * 3 for _ in range(most)]
    needs = floor.copy()

    def take(member: np.ndarray, row: np.ndarray, score: np.ndarray) -> np.ndarray:
        other = block.labels[row] != labels[member]
        member, row, score = member[other], row[other], score[other]
        for j in range(most):
            fine = (score >= needs[member, j]) & within(score, scores[member, j], low, high)
            pool = [np.concatenate([x, y[fine]]) for x, y in zip(held[j], (member, row, score), strict=True)]
            best = first_of(pool[0], pool[2], block.ids[pool[1], 0], k)
            held[j] = tuple(x[best] for x in pool)
            needs[:, j] = kth(held[j][0], held[j][2], k, floor[:, j])
        return needs.min(axis=1, initial=NONE)

    walk(vectors, block.vectors, needs.min(axis=1, initial=NONE), take)
    found = []
    for j, (member, row, score) in enumerate(held):
        ids = block.ids[row]
        entry, place = np.nonzero(ids != NONE)
        best = first_of(member[entry], score[entry], ids[entry, place], k)
        found.append(pd.DataFrame({"a": asked["a"].to_numpy(np.int64)[member[entry][best]], "place": j, "score": score[entry][best], "id": ids[entry, place][best]}))
    return pd.concat(found) if found else pd.DataFrame({"a": [], "place": [], "score": [], "id": []}, dtype=np.int64)


def _placed(rows: DataFrame, cells: dict[int, np.ndarray], most: int) -> DataFrame:
    """rows, settled, with their cell, norm, angle to the cell's centre, and part of the cell, one for each most rows of
    it. The parts by cell are broadcast: CELLS for each length of vectors, at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, norm, angle = np.zeros(len(batch), np.int64), np.zeros(len(batch)), np.zeros(len(batch))
            for w in batch["w"].unique().tolist():
                at = np.flatnonzero(batch["w"] == w)
                units, norm[at] = unit(unpacked(batch["v"].iloc[at].tolist(), w))
                cell[at] = (units @ shared.value[w].T).argmax(axis=1)
                angle[at] = np.arccos(np.clip((units * shared.value[w][cell[at]]).sum(axis=1), -1, 1))
            yield batch.assign(cell=cell, norm=norm, angle=angle)

    shared = rows.sparkSession.sparkContext.broadcast(cells)
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.LongType()), T.StructField("norm", T.DoubleType()), T.StructField("angle", T.DoubleType())])
    found = rows.mapInPandas(run, schema)
    found = settle(found.withColumn("a", F.monotonically_increasing_id()), "placed")
    parts = found.groupBy("w", "cell").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
    return found.join(F.broadcast(parts), ["w", "cell"]).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts"))).drop("parts")


def _reach(placed: DataFrame, *more: Column) -> DataFrame:
    """The parts of cells: widest angle to the centre and largest norm."""
    return placed.groupBy(*KEY).agg(F.max("angle").alias("wide"), F.max("norm").alias("long"), *more)


def _meetings(clusters: DataFrame, blocks: DataFrame, apart: DataFrame, own: bool) -> DataFrame:
    """(w, cell, part, cell_b, part_b): clusters with the blocks of their own cell, or with those of other cells that may
    hold a product of their least need. An angle between centres less the two widths bounds it."""
    met = clusters.join(F.broadcast(apart.filter(F.col("own") == own)), ["w", "cell"])
    met = met.join(blocks.select("w", F.col("cell").alias("cell_b"), F.col("part").alias("part_b"), F.col("wide").alias("wide_b"), F.col("long").alias("long_b")), ["w", "cell_b"])
    near = F.greatest(F.lit(0.0), F.cos(F.greatest(F.lit(0.0), F.col("apart") - F.col("wide") - F.col("wide_b") - SLACK)))
    return met.filter(F.lit(own) | (F.col("long") * F.col("long_b") * near * (1 + SLACK) + SLACK >= F.col("need"))).select(*KEY, "cell_b", "part_b")


def _meet(asked: DataFrame, rows: DataFrame, meetings: DataFrame, f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    keys = [*KEY, "cell_b", "part_b"]
    met = settle(meetings, "meetings")
    left = asked.drop("norm", "angle").join(met, KEY)
    right = rows.select("w", F.col("cell").alias("cell_b"), F.col("part").alias("part_b"), "label", "v", "ids").join(met, ["w", "cell_b", "part_b"])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(f, schema)


def hard_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    n_positives: int = 5,
    n_negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A component x counts as floor(scale * x); the score of a row for an anchor is their inner product in integers, and
    rows come by falling score, then rising id. An anchor's positives are its first n_positives rows of its label and
    another id; for each of them the first n_negatives rows of other labels are returned, whose score is at
    least low and at most high percent of the positive's.

    Rows of one label and vector are folded first, to the few least ids that can be asked for, before anything is
    shuffled. Vectors fall into cells around centres that are fitted on a bounded sample; cells are cut into blocks
    of candidates and clusters of anchors. A cluster sorts a block once by an angular upper bound, and each member
    walks that list until the bound certifies that nothing better follows; it starts with what the blocks of its own
    cell have shown, and blocks that the bound excludes for the whole cluster are never met. That spares most where
    vectors cluster; where they are spread evenly every cluster meets every block, in groups of thousands by
    thousands, so that a row is copied once for each CLUSTER anchors. No pair is ever written, and memory is bounded.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part, as candidates or
    anchors. Repeated rows are one row; rows of one id and different labels or vectors are several. Vectors of
    different lengths never meet. Ids, labels, products and hundredfold scores must fit a long. Zero and empty vectors
    score zero. Empty tables give no rows; other columns are not read.
    """
    quantised = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * scale))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = np.empty(len(batch), dtype=object)
            for w in batch["w"].unique().tolist():
                at = np.flatnonzero(batch["w"] == w)
                v[at] = packed(np.array([np.asarray(x, dtype=np.int64) for x in batch["v"].iloc[at]], dtype=np.int64).reshape(len(at), w))
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "w": batch["w"], "v": v})

    def read(df: DataFrame) -> DataFrame:
        held = df.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & finite(F.col(vector_col)))
        held = held.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.size(vector_col).alias("w"), quantised.alias("v"))
        return held.mapInPandas(pack, "id long, label long, w int, v binary").distinct()

    few = Window.partitionBy("label", "w", "v").orderBy("id")
    folded = read(vectors).withColumn("n", F.row_number().over(few)).filter(F.col("n") <= max(n_positives + 1, n_negatives))
    folded = folded.groupBy("label", "w", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(ids=[np.asarray(i, dtype="<i8").tobytes() for i in batch["ids"]])

    rows = settle(folded.mapInPandas(listed, "label long, w int, v binary, ids binary"), "folded")
    asked = read(anchors).withColumn("need", F.lit(np.iinfo(np.int64).min).cast("long"))
    cells, apart = {}, []
    for w, n in rows.groupBy("w").count().collect():  # one row for each length of vectors
        k = min(CELLS, -(-n // CELL))
        sample = rows.filter(F.col("w") == w).orderBy(F.xxhash64("v")).limit(SAMPLE).select("v").collect() if k > 1 else []
        cells[w] = centres(unpacked([bytes(r["v"]) for r in sample], w), k) if k > 1 else np.zeros((1, w))
        between = np.arccos(np.clip(cells[w] @ cells[w].T, -1, 1)) if k > 1 else np.zeros((1, 1))
        apart += [(w, i, j, float(between[i, j]), i == j) for i in range(k) for j in range(k)]
    spark = vectors.sparkSession
    out = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if not cells:
        return spark.range(0).select(*[F.col("id").cast("int" if c == "rank" else "long").alias(c) for c in out])
    apart = spark.createDataFrame(apart, "w int, cell long, cell_b long, apart double, own boolean")
    folded, rows = rows, _placed(rows, cells, BLOCK)
    forget(folded)
    asked = _placed(asked.filter(F.col("w").isin(list(cells))), cells, CLUSTER)
    blocks = settle(_reach(rows), "blocks")

    def best(found: DataFrame, by: list[str], k: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", place).filter(F.col("rank") <= k)

    # Positives: in the own cell, then wherever the bound allows better ones.
    search = partial(positives, k=n_positives)
    told = settle(best(_meet(asked, rows, _meetings(_reach(asked, F.min("need").alias("need")), blocks, apart, True), search, "a long, score long, id long"), ["a"], n_positives), "positives")
    if any(len(c) > 1 for c in cells.values()):
        least = told.filter(F.col("rank") == n_positives).select("a", F.col("score").alias("least"))
        again = settle(asked.join(least, "a", "left").withColumn("need", F.coalesce("least", "need")).drop("least"), "asked")
        more = _meet(again, rows, _meetings(_reach(again, F.min("need").alias("need")), blocks, apart, False), search, "a long, score long, id long")
        told = settle(best(told.drop("rank").unionByName(more), ["a"], n_positives), "positives")
    # Negatives: the least score that counts for a positive is its lower limit, then its last negative so far.
    lists = told.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("list"))
    lists = lists.select("a", F.col("list.score").alias("p"), F.col("list.id").alias("pid"))
    lists = settle(lists.withColumn("needs", F.transform("p", lambda s: F.when(s >= 0, F.ceil(s * low / 100).cast("long") - 1).otherwise(NONE))), "lists")
    asked = asked.drop("need").join(lists.drop("pid"), "a")
    search, schema = partial(negatives, k=n_negatives, low=low, high=high), "a long, place int, score long, id long"
    reach = lambda df: _reach(df, F.min(F.array_min("needs")).alias("need"))
    found = settle(best(_meet(asked, rows, _meetings(reach(asked), blocks, apart, True), search, schema), ["a", "place"], n_negatives), "negatives")
    if any(len(c) > 1 for c in cells.values()):
        least = found.filter(F.col("rank") == n_negatives).groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("least"))
        raised = F.transform("needs", lambda s, j: F.greatest(s, F.try_element_at("least", j.cast("long"))))
        again = asked.join(least, "a", "left").withColumn("needs", F.when(F.col("least").isNotNull(), raised).otherwise(F.col("needs"))).drop("least")
        again = settle(again, "asked")
        more = _meet(again, rows, _meetings(reach(again), blocks, apart, False), search, schema)
        found = best(found.drop("rank").unionByName(more), ["a", "place"], n_negatives)
    names = asked.select("a", F.col("id").alias("anchor_id")).join(lists.select("a", "p", "pid"), "a")
    return found.join(names, "a").select(
        "anchor_id",
        F.element_at("pid", F.col("place") + 1).alias("positive_id"),
        "rank",
        F.col("id").alias("negative_id"),
        F.element_at("p", F.col("place") + 1).alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
