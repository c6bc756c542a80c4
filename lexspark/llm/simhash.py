"""SimHash fingerprints, pigeonring search of near fingerprints, near-copy classes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm.memory import trim
from lexspark.operators.components import connected_components
from lexspark.operators.lineage import forget, settle, settled_by
from lexspark.operators.sieve import sieved

#: Bits of a plain fingerprint.
WIDTH = 64
#: Hashes whose bits are counted at once.
BLOCK = 1 << 15
#: Bytes kept of a shingle's hash, and bits of a text's parity map.
HASH_BYTES, PARITY = 5, 512
#: Ranges of hashes whose least member is a key for stars.
RANGES = 8
#: Chance that two texts of the similarity asked for share none of the keys picked for them, at most.
MISS = 1e-12
#: One text in SAMPLE tells which shingles are common: those of COMMON of them outside a class, MOST_COMMON at most.
#: They only go last in the order of shingles, whatever they are; no result depends on them.
SAMPLE, COMMON, MOST_COMMON = 16, 3, 1_000_000
#: Texts whose shingles are held at once.
SLICE = 200


def words(text: str | None) -> list[bytes]:
    """Words between ASCII blanks of the text with A-Z lowered, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(found: list[bytes], size: int) -> list[int]:
    """XXH64 (seed 42) of each run of size words, repeats included; of the whole sequence if it is shorter."""
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= size:
        return [xxhash.xxh64_intdigest(joined, 42)]
    begin = np.cumsum([0, *(len(w) + 1 for w in found)]).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], 42) for a, b in zip(begin, begin[size:], strict=False)]


def majority(rows: np.ndarray) -> np.ndarray:
    """rows: n x bytes. The packed bits that are set in over half the rows."""
    total = np.zeros(rows.shape[1] * 8, dtype=np.int64)
    for at in range(0, len(rows), BLOCK):
        total += np.unpackbits(rows[at : at + BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(rows))


def fingerprint(text: str | None, size: int = 3) -> int:
    """The signed 64-bit SimHash of a text; 0 without words."""
    hashes = shingle_hashes(words(text), size)
    if not hashes:
        return 0
    rows = np.array(hashes, dtype=np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    return int(majority(rows).view(">i8")[0])


def _fingerprints(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"id": batch["id"], "fp": [fingerprint(t, size) for t in batch["text"]]})


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp) of every row. Null and wordless texts get 0."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(partial(_fingerprints, size=size), "id string, fp long").withColumn("id", F.col("id").cast("long"))


def _bounds(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment of a fingerprint."""
    cuts = [WIDTH * k // segments for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _segment(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def ring_viable(diff: Column, max_bits: int) -> Column:
    """The pigeonring filter on the xor of two fingerprints.

    With m segments on a ring, some start has all its chains of l consecutive segments within
    l * max_bits / m differing bits, if the whole differs in max_bits at most.
    """
    m = max_bits + 2
    per = [F.bit_count(_segment(diff, *b)) for b in _bounds(m)]
    viable = F.lit(False)
    for start in range(m):
        total, chain = F.lit(0), F.lit(True)
        for length in range(1, m + 1):
            total = total + per[(start + length - 1) % m]
            chain = chain & (total <= length * max_bits // m)
        viable = viable | chain
    return viable


def link_fingerprints(fps: DataFrame, max_bits: int = 2, bucket_limit: int = 32) -> DataFrame:
    """Edges (src, dst) among distinct fingerprints (column fp) that connect exactly those that chains of
    pairs of max_bits differing bits at most connect.

    Pigeonring with max_bits + 2 segments: the chain of all segments but one has a budget of under
    max_bits, so two of its segments are equal. Each pair of segments is a key (32 bits for 2 bits);
    pairs that share a key pass the chain test, then the full Hamming test. A bucket of more than
    bucket_limit fingerprints makes no pairs: its members list all values within max_bits / 2 flipped
    bits instead; two fingerprints within max_bits share such a value, and at most 65 fingerprints lie
    around one value at one bit. That is linear in the bucket and loses no link.
    """
    if max_bits != 2:
        raise ValueError("the exact way for overfull buckets is built for 2 bits")
    fps = fps.select("fp")
    fp, bounds = F.col("fp"), _bounds(max_bits + 2)
    keys = [
        F.shiftleft(F.lit(k).cast("long"), 58)
        .bitwiseOR(F.shiftleft(_segment(fp, *bounds[i]), 32))
        .bitwiseOR(_segment(fp, *bounds[j]))
        for k, (i, j) in enumerate(combinations(range(max_bits + 2), 2))
    ]
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = settle(keyed.join(sizes, "key"), "buckets")
    few = members.filter(F.col("n") <= bucket_limit)
    diff = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    pairs = (
        few.alias("a")
        .join(few.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")))
        .filter(ring_viable(diff, max_bits))
        .filter(F.bit_count(diff) <= max_bits)
        .select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
    )
    near = F.array(fp, *[fp.bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(WIDTH)])
    hubs = (
        members.filter(F.col("n") > bucket_limit)
        .select("fp")
        .distinct()
        .select("fp", F.explode(near).alias("value"))
        .groupBy("value")
        .agg(F.collect_list("fp").alias("around"))
        .filter(F.size("around") > 1)
        .select(F.array_min("around").alias("src"), F.explode("around").alias("dst"))
        .filter("src <> dst")
    )
    return pairs.unionByName(hubs).distinct()


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, max_bits: int = 2
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    fingerprint has 16 lowercase hexadecimal digits; component_id is the least id of the rows reachable
    over pairs of fingerprints at max_bits differing bits at most. Null and wordless texts have
    fingerprint zero and link like any other. Repeated rows each get a row. A null id stays null and
    is nobody's component_id, unless no row of a component has an id. Other columns are not read.
    """
    rows = settle(simhash_fingerprints(docs, id_col, text_col, size), "fingerprints")
    first = settle(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    found = connected_components(link_fingerprints(first, max_bits))
    linked = found.join(first, found.node == first.fp).select("fp", "component", "first")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    classes = first.join(linked.join(least, "component").select("fp", "least"), "fp", "left")
    classes = settle(classes.select(F.col("fp").alias("key"), F.coalesce("least", "first").alias("component_id")), "classes")
    return rows.join(classes, rows.fp == classes.key).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def packed(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def unpacked(source: bytes) -> np.ndarray:
    wide = np.zeros((len(source) // HASH_BYTES, 8), dtype=np.uint8)
    wide[:, :HASH_BYTES] = np.frombuffer(source, dtype=np.uint8).reshape(-1, HASH_BYTES)
    return wide.view("<u8").ravel()


def parity(hashes: np.ndarray) -> bytes:
    """One bit for each residue of hashes: whether it occurs an odd number of times. Two maps differ in no
    more bits than their sets differ in members."""
    return np.packbits(np.bincount((hashes % PARITY).astype(np.int64), minlength=PARITY) & 1).tobytes()


def jaccard(one: bytes, two: bytes) -> float:
    """Jaccard similarity of two packed shingle sets."""
    a, b = unpacked(one), unpacked(two)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def segments_viable(diff: np.ndarray, budget: np.ndarray | float) -> np.ndarray:
    """The pigeonring filter on differing bits by segment (n x m): some start has all its chains of l consecutive
    segments within l * budget / m bits, the budget being that of the whole row."""
    m = diff.shape[1]
    room = np.broadcast_to(np.asarray(budget, dtype=float), len(diff))[:, None] * np.arange(1, m + 1) / m + 1e-9
    viable = np.zeros(len(diff), dtype=bool)
    for start in range(m):
        viable |= (np.cumsum(np.roll(diff, -start, axis=1), axis=1) <= room).all(axis=1)
    return viable


def pick_keys(hashes: np.ndarray, common: np.ndarray, similarity: float) -> tuple[np.ndarray, int, int, int]:
    """(keys, how many of them are common, group, how many members are rare) of a sorted set of n shingle hashes.

    Exact keys: the first members, rare ones before common ones, as many as leave fewer out than two sets of
    this similarity share, so that such sets share one (prefix filtering). Where rare members abound, fewer
    are as good: two similar sets differ in a share q = n (1 - s) / s / rare of their rare members at most, and
    of the k least in random order one is shared but for a chance of q^k; k is such that this is under MISS.
    group tells sets with common keys apart by their common members; 0 for others.
    """
    often = np.zeros(len(hashes), dtype=bool)
    if len(common) and len(hashes):
        often = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
    rare, n = hashes[~often], len(hashes)
    exact = n - math.ceil(similarity * n - 1e-9) + 1
    q = n * (1 - similarity) / similarity / max(len(rare), 1)
    if q < 1 and (k := math.ceil(math.log(MISS) / math.log(q))) < exact and k <= len(rare):
        return rare[:k], 0, 0, len(rare)
    keys = np.concatenate([rare, hashes[often]])[:exact]
    mine = max(0, len(keys) - len(rare))
    return keys, mine, xxhash.xxh3_64_intdigest(hashes[often].tobytes()) >> 1 | 1 if mine else 0, len(rare)


def _shingles(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Rows of near_copy_classes; hashes only at the first row of a text in each task."""
    seen: set[int] = set()
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            part, rows = batch[at : at + SLICE], []
            for doc, mark, text in zip(part["id"], part["mark"], part["text"], strict=True):
                found = words(text)
                node = xxhash.xxh3_64_intdigest(b" ".join(found)) - (1 << 63)
                if node in seen:
                    rows.append((doc, mark, node, None, None, None, None))
                    continue
                seen.add(node)
                every = np.array(shingle_hashes(found, size), dtype=np.uint64)
                own = np.unique(every >> np.uint64(64 - 8 * HASH_BYTES))
                bits = int(majority(every.astype(">u8").view(np.uint8).reshape(-1, 8)).view(">i8")[0]) if found else 0
                rows.append((doc, mark, node, len(own), bits, parity(own), packed(own)))
            yield pd.DataFrame(rows, columns=["id", "mark", "node", "n", "fp", "parity", "hashes"]).astype({"n": "Int64", "fp": "Int64"})
    trim()


def _range_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, key): the least hash of each range."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            part, keys = batch[at : at + SLICE], []
            for source in part["hashes"]:
                own = unpacked(source)
                _, first = np.unique(own >> np.uint64(8 * HASH_BYTES - RANGES.bit_length() + 1), return_index=True)
                keys.append(own[first])
            yield pd.DataFrame({"node": np.repeat(part["node"].to_numpy(np.int64), [len(k) for k in keys]), "key": np.concatenate(keys).astype(np.int64)})


def _picked_keys(rows: DataFrame, similarity: float, common: np.ndarray) -> DataFrame:
    """(node, key, group, rare): the keys of each row's set; group is 0 for rare keys, else that of the set, whose rare
    members are counted."""
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch[at : at + SLICE]
                names = ("node", "key", "group", "rare")
                found = {name: [] for name in names}
                for node, source in zip(part["node"], part["hashes"], strict=True):
                    own, mine, group, rare = pick_keys(unpacked(source), shared.value, similarity)
                    for name, x in zip(names, (np.full(len(own), node), own, np.where(np.arange(len(own)) < len(own) - mine, 0, group), np.full(len(own), rare)), strict=True):
                        found[name].append(x)
                yield pd.DataFrame({name: np.concatenate(x).astype(np.int64) for name, x in found.items()})

    return rows.filter("n > 0").select("node", "hashes").mapInPandas(run, "node long, key long, group long, rare long")


def _classes_of(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """keyed and the class of each node: that of classes, or the node where it has none."""
    return keyed.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))


def star_pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs (src, dst) of each node and the least nodes with which it shares the least hash of a range."""
    keyed = rows.filter("n > 0").select("node", "hashes").mapInPandas(_range_keys, "node long, key long")
    least = keyed.groupBy("key").agg(F.min("node").alias("src"))
    return keyed.join(least, "key").filter("src <> node").select("src", F.col("node").alias("dst")).distinct()


def fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (src, dst) of nodes whose fingerprints link_fingerprints finds within 2 differing bits, by the least
    node of each fingerprint, and of each node with the least of its own fingerprint."""
    known = texts.filter("n > 0")
    first = settle(known.groupBy("fp").agg(F.min("node").alias("first")), "firsts")
    own = known.join(first, "fp").filter("node <> first").select(F.col("first").alias("src"), F.col("node").alias("dst"))
    links = link_fingerprints(first)
    for end in ("src", "dst"):
        links = links.join(first.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_node")), end).drop(end)
    return own.unionByName(links.select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst")))


def common_shingles(rows: DataFrame, classes: DataFrame) -> np.ndarray:
    """Shingles that COMMON texts of a sample, not counting those of the class that has it most, have; sorted.

    So a passage of two large classes is common, what one class has alone is not."""
    some = rows.filter((F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0) & (F.col("n") > 0)).select("node", "hashes")
    some = _classes_of(some.dropDuplicates(["node"]), classes).select("class", "hashes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch[at : at + SLICE]
                sets = [unpacked(source) for source in part["hashes"]]
                yield pd.DataFrame({"key": np.concatenate(sets).astype(np.int64), "class": np.repeat(part["class"].to_numpy(np.int64), list(map(len, sets)))})

    often = some.mapInPandas(run, "key long, class long").groupBy("key", "class").count()
    often = often.groupBy("key").agg((F.sum("count") - F.max("count")).alias("others")).filter(F.col("others") >= COMMON)
    often = often.orderBy(F.desc("others")).limit(MOST_COMMON).select("key")
    return np.sort(often.toPandas()["key"].to_numpy(np.int64).astype(np.uint64))


def _mixed(members: DataFrame) -> DataFrame:
    """The members (node, key, group, rare, class, n) of keys that several classes have."""
    mixed = members.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a < b").select("key")
    return members.join(mixed, "key")


def shared_keys(rows: DataFrame, texts: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Picked keys that several classes have, by node: node, key, group, rare, class, n."""
    keyed = _picked_keys(rows, similarity, common_shingles(rows, classes))
    shared = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("key")
    members = settle(_classes_of(keyed.join(shared, "key").distinct(), classes).join(texts.select("node", "n"), "node"), "members")
    found = settle(_mixed(members), "mixed")
    forget(members)
    return found


def central_pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs (src, dst) of each node and the most central node of each of its keys, of different classes.

    That is the one with the fewest rare members where the key is common, and with the most members of its keys in
    all elsewhere: an original that all its copies are near, however far they are from each other. A linear number of
    pairs, as of stars."""
    crowd = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    weight = members.join(crowd, "key").groupBy("node").agg(F.sum("m").alias("weight"))
    order = F.struct(F.when(F.col("group") != 0, -F.col("rare")).otherwise(0).alias("rare"), "weight", "node", "class")
    centre = members.join(weight, "node").groupBy("key").agg(F.max(order).alias("c")).select("key", F.col("c.node").alias("centre"), F.col("c.class").alias("own"))
    pairs = members.join(centre, "key").filter(F.col("class") != F.col("own"))
    return pairs.select(F.least("node", "centre").alias("src"), F.greatest("node", "centre").alias("dst")).distinct()


def key_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (src, dst) of nodes of different classes that share a picked key (shared_keys), at sizes that
    allow the similarity; with links among them, they connect all nodes that pairs of that similarity connect.

    Rare keys pair all nodes that have them. A common key, such as one of a passage that many texts share,
    pairs its nodes with the smallest set of each group of equal common members only: where two sets reach
    the similarity by common members alone, the smaller of either's group reaches it with the other as well, so
    both hang on the groups' smallest. Such sets share common members only, so each must have as many of these as the
    similarity asks of both; sets with more rare members, as of heavily edited copies, meet nobody. Nor do members of
    a key's largest class meet each other.
    """
    rare, often = members.filter("group = 0"), members.filter("group <> 0")
    smallest = often.groupBy("group").agg(F.min(F.struct("n", "node")).alias("m")).select("m.node").distinct()
    fits = (F.col("a.key") == F.col("b.key")) & (F.col("a.class") != F.col("b.class"))
    fits = fits & (F.col("a.n") >= similarity * F.col("b.n") - 1e-6) & (F.col("b.n") >= similarity * F.col("a.n") - 1e-6)
    pairs = rare.alias("a").join(rare.alias("b"), fits & (F.col("a.node") < F.col("b.node")))
    asked = similarity / (1 + similarity) * (F.col("a.n") + F.col("b.n")) - 1e-6
    shares = fits & (F.col("a.n") - F.col("a.rare") >= asked) & (F.col("b.n") - F.col("b.rare") >= asked)
    able = often.filter(F.col("n") - F.col("rare") >= similarity * F.col("n") - 1e-6)  # no partner is under similarity of its size
    ends = [F.least("a.node", "b.node").alias("src"), F.greatest("a.node", "b.node").alias("dst")]
    counts = able.groupBy("key", "class").agg(F.count(F.lit(1)).alias("m"))
    able = able.join(counts.groupBy("key").agg(F.max(F.struct("m", "class")).alias("most")).select("key", F.col("most.class").alias("major")), "key")
    hubs, minor = able.join(smallest, "node", "left_semi"), F.col("class") != F.col("major")
    hung = able.alias("a").join(hubs.filter(minor).alias("b"), shares).select(*ends)
    hung = hung.unionByName(able.filter(minor).alias("a").join(hubs.filter(~minor).alias("b"), shares).select(*ends))
    return pairs.select(*ends).unionByName(hung).distinct()


def alike_pairs(pairs: DataFrame, sets: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) whose shingle sets reach the similarity: those whose parity maps differ in more
    bits than the sets may in members go first, by the pigeonring filter and then by the whole Hamming
    distance; the sets of the rest are compared whole.

    sets (bucketed by node) are not shuffled; those of one end of the remaining pairs go to the other end's, in a join
    that splits where many pairs have one end in common.
    """

    def ends(table: DataFrame, *told: str) -> tuple[DataFrame, DataFrame]:
        return tuple(table.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{x}") for c in told]) for end, x in (("src", "a"), ("dst", "b")))

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch[c]), dtype="<u8").reshape(len(batch), -1) for c in ("parity_a", "parity_b"))
                apart = np.bitwise_count(a ^ b).astype(np.int64)
                budget = (batch["n_a"] + batch["n_b"]).to_numpy(float) * (1 - similarity) / (1 + similarity)
                at = np.flatnonzero(segments_viable(apart, budget))
                yield batch.iloc[at[apart[at].sum(axis=1) <= budget[at] + 1e-6]][["src", "dst"]]

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = [jaccard(x, y) >= similarity for x, y in zip(batch["hashes_a"], batch["hashes_b"], strict=True)]
            yield batch.loc[near, ["src", "dst"]]
        trim()

    pairs = settle(pairs, "candidates")
    a, b = ends(texts, "n", "parity")
    met = settle(pairs.join(a, "src").join(b, "dst").mapInPandas(close, "src long, dst long").distinct(), "met")
    # The end with more pairs comes first: the sets of second ends are taken in their buckets.
    degree = met.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    a, b = ends(degree, "n")
    less = F.col("n_a") < F.col("n_b")
    near = met.join(a, "src").join(b, "dst").select(F.when(less, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(less, F.col("src")).otherwise(F.col("dst")).alias("dst"))
    near = settle(near, "near")
    a, b = (sets.join(near.select(F.col(end).alias("node")).distinct(), "node", "left_semi").dropDuplicates(["node"]).select(F.col("node").alias(end), F.col("hashes").alias(name)) for end, name in (("src", "hashes_a"), ("dst", "hashes_b")))
    a = settle(a, "compared")
    found = settle(near.join(b, "dst").join(a, "src").mapInPandas(alike, "src long, dst long"), "alike")
    forget(pairs, met, near, a)
    return found


def _class_links(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct pairs (src, dst) of the classes of pairs of nodes."""
    for end in ("src", "dst"):
        pairs = _classes_of(pairs.withColumnRenamed(end, "node"), classes).withColumnRenamed("class", f"{end}_class").drop("node")
    return settle(pairs.select(F.col("src_class").alias("src"), F.col("dst_class").alias("dst")).distinct(), "links")


def _raised(df: DataFrame, links: DataFrame) -> DataFrame:
    """df with each class replaced by the least of those that links connect it with."""
    more = connected_components(links).select(F.col("node").alias("class"), F.col("component").alias("whole"))
    return df.join(more, "class", "left").withColumn("class", F.coalesce("whole", "class")).drop("whole")


def _copy_classes(docs: DataFrame, size: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, class) of every row with an id; see near_copy_classes."""
    key, text = F.col(id_col).cast("long"), F.col(text_col)
    read = docs.filter(key.isNotNull()).select(key.alias("id"), F.when(text.isNotNull(), F.xxhash64(text)).cast("string").alias("mark"), text.alias("text"))
    every = read.mapInPandas(partial(_shingles, size=size), "id long, mark string, node long, n long, fp long, parity binary, hashes binary")
    # Rows without a set lie anywhere, so a text that many rows have fills no bucket.
    every = every.withColumn("place", F.when(F.col("hashes").isNotNull(), F.col("node")).otherwise(F.xxhash64("id", "mark")))
    with settled_by(every, "place", "shingles") as every:
        rows = every.filter("hashes is not null")
        sets = rows.select(F.col("place").alias("node"), "hashes")
        texts = settle(rows.select("node", "n", "fp", "parity").distinct(), "texts")
        first = alike_pairs(star_pairs(rows).unionByName(fingerprint_pairs(texts)).distinct(), sets, texts, similarity)
        classes = settle(connected_components(first).select("node", F.col("component").alias("class")), "classes")
        members = shared_keys(rows, texts, classes, similarity)
        central = _class_links(alike_pairs(central_pairs(members), sets, texts, similarity), classes)
        left = settle(_mixed(_raised(members, central)), "left")
        forget(members)
        links = _class_links(alike_pairs(key_pairs(left, similarity), sets, texts, similarity), classes)
        told = _classes_of(every.select("id", F.col("mark").cast("long").alias("mark"), "node"), classes)
        found = settle(_raised(told, central.unionByName(links)).select("id", "mark", "class"), "near-copies")
    forget(texts, first, classes, central, left, links)
    return found


def near_copy_classes(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, class_id) of every row with an id: class_id is the least id among near copies, chains of them
    included; mark is the xxhash64 of the text, null for a null one.

    Nodes are distinct sequences of words, so texts of equal words are copies, whatever their ids, and texts
    without words are copies of each other. Nodes are near copies if the Jaccard similarity of their shingles of
    size words reaches similarity. Fingerprints within 2 bits (link_fingerprints) and stars around least nodes
    join most copies in a linear number of pairs; picked keys then give the pairs between the classes so found
    (key_pairs). Every pair is compared by its whole shingle sets. A pair of the similarity is missed with a
    chance of MISS, or if hashes collide: node and mark have 64 bits, shingles 8 * HASH_BYTES. Repeated rows
    each get their row; an empty table gives none; other columns are not read.
    """
    classes = _copy_classes(docs, size, similarity, id_col, text_col)
    least = classes.groupBy("class").agg(F.min("id").alias("class_id"))
    return classes.join(least, "class").select("id", "mark", "class_id")


def drop_near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each class of near copies, all columns kept: that of the least doc_id.

    Of rows of one class and id the one of the least xxhash64 of its text stays (a null text first), of equal
    texts too the least by the other columns. Rows of one id and different texts are judged each by its own
    text. Rows with a null doc_id stay.
    """
    classes = _copy_classes(docs, size, similarity, "doc_id", "text")
    best = classes.groupBy("class").agg(F.min(F.struct("id", "mark")).alias("best"), F.count(F.lit(1)).alias("members"))
    copies = classes.join(best.filter("members > 1"), "class")
    lesser = (F.col("id") != F.col("best.id")) | ~F.col("mark").eqNullSafe(F.col("best.mark"))
    gone = settle(copies.filter(lesser).select(F.col("id").alias("gone"), F.col("mark").alias("gone_mark")).distinct(), "gone")
    key, text = F.col("doc_id").cast("long"), F.col("text")
    mark = F.when(text.isNotNull(), F.xxhash64(text))
    maybe, rest = sieved(docs, F.xxhash64(key, mark), gone.select(F.xxhash64("gone", "gone_mark").alias("key")), "key")
    # Shuffled whatever the number of copies
    kept = rest.unionByName(maybe.join(gone.hint("shuffle_hash"), (key == gone["gone"]) & mark.eqNullSafe(gone["gone_mark"]), "left_anti"))
    again = settle(classes.groupBy("id", "mark").count().filter("count > 1").select(F.col("id").alias("again"), F.col("mark").alias("again_mark")), "again")
    forget(classes)
    if again.isEmpty():
        return kept
    repeated = (key == again["again"]) & mark.eqNullSafe(again["again_mark"])
    other = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and not kind.startswith("map")]
    maybe, rest = sieved(kept, F.xxhash64(key, mark), again.select(F.xxhash64("again", "again_mark").alias("key")), "key")
    once = maybe.join(again, repeated, "left_semi").groupBy(key.alias("_id"), mark.alias("_mark"))
    once = once.agg(F.min_by(F.struct(*docs.columns), F.struct(*other) if other else F.lit(0)).alias("_row")).select("_row.*")
    return rest.unionByName(maybe.join(again, repeated, "left_anti")).unionByName(once)
