"""How work grows with the input, where it once grew with its square."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import forest


def nearest(v, ids, q, k=10):
    """The k nearest ids of row q, each by its nearest vector."""
    best = {}
    for s, i in sorted(zip(np.sqrt(((v - v[q]) ** 2).sum(axis=1)).tolist(), ids, strict=True)):
        if i != ids[q]:
            best.setdefault(i, s)
    return [i for i, _ in sorted(best.items(), key=lambda x: (x[1], x[0]))[:k]]


def some_vectors(n, spread):
    rng = np.random.default_rng(9)
    return rng.normal(size=(n // 40, 24))[rng.integers(0, n // 40, n)] + spread * 3 * rng.normal(size=(n, 24))


@pytest.mark.parametrize("spread,most", [(0.05, 8), (1.0, 17)])
def test_blocks_that_queries_visit(spread, most):
    """Clustered vectors: four times the rows make half of sixteen times the visits of queries to blocks, and most rows
    are never met. Evenly spread ones make sixteen times as many and more, as no prefix tells them apart."""
    visits, met = [], []
    for n in (4000, 16000):
        v = some_vectors(n, spread)
        bits = ((n - 1) // 64).bit_length()
        far = forest.reach(v, v[::50][:256], bits, 10)
        prefix, rows = np.unique(forest.prefixes(v, bits), return_counts=True)
        near = np.bitwise_count(forest.prefixes(v[::50], bits)[:, None] ^ prefix[None, :]) <= far
        visits.append((near * -(-rows // 64)).sum())
        met.append((near * rows).sum() / (n * len(v[::50])))
    assert visits[1] <= most * visits[0] and (met[1] < 0.2) == (spread < 1)


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_meetings_of_groups_and_blocks(spark, monkeypatch, spread):
    """Small groups and blocks lose no neighbours, and their meetings are written without vectors."""
    for name, value in (("BLOCK", 64), ("GATHER", 256), ("QUERIES", 8)):
        monkeypatch.setattr(forest, name, value)
    settle, seen = forest.settle, []

    def named(df, name):
        seen.extend([df.columns] if name == "meetings" else [])
        return settle(df, name)

    monkeypatch.setattr(forest, "settle", named)
    v = some_vectors(2000, spread)
    df = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>").repartition(4)
    got = forest.forest_neighbours(df, df.filter("vec_id % 50 = 0")).toPandas()
    hits = sum(len(set(own["vec_id"]) & set(nearest(v, list(range(len(v))), q))) for q, own in got.groupby("query_id"))
    assert hits >= 0.9 * 10 * 40 and seen and "vector" not in seen[0]


def test_true_neighbours_of_a_few(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 8))
    rows = spark.createDataFrame([(x,) for x in v.tolist()], "vector array<double>").repartition(3)
    found = forest.nearest_rows(rows, v[:5], 4)
    want = {tuple(v[i]) for q in range(5) for i in np.argsort(((v - v[q]) ** 2).sum(axis=1))[1:5]}
    assert {tuple(x) for x in found} == want
    assert forest.nearest_rows(rows.limit(2), v[:1], 4).shape[1] == 8


def test_ids_with_several_vectors_are_one_candidate(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0])] + [(k % 30, [1.0, k / 90]) for k in range(90)] + [(40, [0.0, 1.1]), (40, [0.1, 1.1]), (40, [0.2, 1.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = forest.forest_neighbours(df, df.filter(F.col("vec_id") == 100)).orderBy("rank").collect()
    best = {}
    for q in rows[:2]:
        for i, v in rows[2:]:
            s = float(np.sqrt(((np.array(v) - np.array(q[1])) ** 2).sum()))
            best[i] = min(s, best.get(i, np.inf))
    assert [(r["vec_id"], pytest.approx(r["score"])) for r in got] == [(i, s) for i, s in sorted(best.items(), key=lambda x: (x[1], x[0]))[:10]]
