"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.operators.lineage import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every neighbour of u is linked to the least of u and its neighbours.

    large: of the larger neighbours only. Otherwise u's smaller neighbours and u itself move.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    else:
        both = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    moved = both.join(least, "src")
    if large:
        out = moved.filter(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    else:
        out = moved.select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(
            least.select("src", F.col("m").alias("dst"))
        )
    return out.filter("src <> dst").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node that can be reached, for every node of an edge.

    edges has long columns src and dst; direction, repeats and loops do not matter, edges with a null
    end are ignored. The number of rounds grows with the logarithm of the longest path. Every round is
    joins and partially aggregated group-bys on edges, and is written to the shared folder, so that a
    lost executor costs one round at most.
    """
    loops = edges.filter("src = dst").select(F.col("src").alias("node")).distinct()
    now = settle(edges.filter("src <> dst").select("src", "dst").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")
        ).first()
        if mark == seen or not mark["n"]:
            break
        seen = mark
        now = settle(_star(_star(now, large=True), large=False), "edges")
    else:
        raise RuntimeError("components did not settle")
    found = now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(
        now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    )
    return found.unionByName(
        loops.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    )
