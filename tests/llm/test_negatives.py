"""Hard negatives against brute force and SQL."""

import numpy as np
import pytest

from lexspark.llm import negatives, queries
from tests.compare import same
from tests.conftest import SF


def brute(rows, anchors, low=50, high=95):
    """All products, by the definition; rows: (id, label, vector of floats), usable ones only."""
    rows = {(i, label, tuple(np.floor(256 * np.array(v, dtype=float)).astype(int).tolist())) for i, label, v in rows}
    anchors = {(i, label, tuple(np.floor(256 * np.array(v, dtype=float)).astype(int).tolist())) for i, label, v in anchors}
    out = []
    for i, label, v in anchors:
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, m) for j, m, w in rows if len(w) == len(v))
        for p, j in [(-s, j) for s, j, m in scored if m == label and j != i][:5]:
            fits = [(j2, -s) for s, j2, m in scored if m != label and low * p <= -100 * s <= high * p][:3]
            out += [(i, j, n, j2, p, s) for n, (j2, s) in enumerate(fits, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, score int, a string, cell int").repartition(4)


def got(spark, rows, asked):
    return sorted(tuple(r) for r in negatives.hard_negatives(frame(spark, rows), frame(spark, asked)).collect())


def test_op13_equals_sql(spark, duck):
    same(queries.op13_negatives(spark, SF).toPandas(), duck.execute(queries.ORACLE_SQL["op13_negatives"]).df())


@pytest.mark.parametrize("spread", [0.15, 3.0])
def test_cells_blocks_and_clusters(spark, monkeypatch, spread):
    """Many cells, cut into several blocks and clusters: clustered vectors and spread ones of very different norms."""
    for name, value in (("CELL", 60), ("BLOCK", 25), ("CLUSTER", 7), ("STEP", 4)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(5)
    middles = rng.standard_normal((6, 8))
    rows = [(k, int(rng.integers(0, 3)), ((middles[k % 6] + spread * rng.standard_normal(8)) * (0.2 if k % 3 else 1)).tolist()) for k in range(420)]
    asked = [r for r in rows if r[0] % 10 == 0]
    assert got(spark, rows, asked) == brute(rows, asked)


def test_edge_cases(spark):
    """Nulls, odd components, ties of equal vectors, repeated rows and ids, zero and empty vectors, other lengths."""
    nan, inf = float("nan"), float("inf")
    held = [(k, k % 2, [1.0, 0.5, k % 5 / 8]) for k in range(40)]  # many equal vectors
    held += [(k, 2, [0.7, 0.4, 0.1]) for k in (-5, 2**60, 60, 61, 62, 63, 64, 65, 66)] + [(60, 2, [0.7, 0.4, 0.1])] * 3
    held += [(60, 0, [0.9, 0.4, 0.1]), (60, 2, [0.8, 0.4, 0.1]), (70, 0, [0.0] * 3), (71, 1, [0.0] * 3), (72, 0, []), (73, 1, []), (80, 0, [1.0, 2.0]), (81, 0, [1.0, 1.5]), (82, 1, [0.9, 1.1])]
    held += [(90, 1, [200.0, -300.0, 1e4]), (91, 0, [150.0, -200.0, 9e3])]
    odd = [(None, 1, [1.0] * 3), (1, None, [1.0] * 3), (2, 1, None), (3, 1, [1.0, None, 0.0]), (4, 1, [nan, 1.0, 0.0]), (5, 1, [inf, 1.0, 0.0])]
    asked = [r for r in held if r[0] % 5 == 0] + odd
    assert got(spark, held + odd, asked) == brute(held, [r for r in held if r[0] % 5 == 0])
    assert got(spark, held, held[:0]) == [] and got(spark, held[:0], held) == []


def test_lists_end_early_where_vectors_cluster():
    """The walk forms few of the products of a list that the bound can close, and all where every need is open."""
    rng = np.random.default_rng(1)
    middles = rng.standard_normal((2, 16)) * 300
    listed = np.concatenate([middles[0] + rng.standard_normal((500, 16)) * 3, middles[1] + rng.standard_normal((4000, 16)) * 3]).astype(np.int64)
    asked = (middles[0] + rng.standard_normal((20, 16)) * 3).astype(np.int64)
    best, low = np.sort(asked @ listed.T)[:, -5], np.iinfo(np.int64).min
    seen = []
    met = negatives.walk(asked, listed, best, lambda m, r, s: (seen.append((m, s)), best)[1])
    assert sum(len(m) for m, _ in seen) >= 100 and met < 20 * 1000
    assert negatives.walk(asked, listed, np.full(20, low), lambda m, r, s: np.full(20, low)) == 20 * 4500
    order, bound = negatives.bounds(asked, listed)
    assert ((asked @ listed[order].T) <= np.linalg.norm(asked, axis=1)[:, None] * bound * (1 + 1e-6) + 1e-6).all()
