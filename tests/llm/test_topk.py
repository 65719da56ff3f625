import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import topk
from tests.llm.cases import clashing

VECTORS = "vec_id long, embedding array<float>, label int"
LONG = (-2**63, 2**63 - 1)


def brute(rows, every, k, scale=1024):
    """Scores of all pairs, sorted."""
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    def whole(x):
        x = float(np.float32(x))
        return math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale

    kept = [(i, r[0], [whole(x) for x in r[1]]) for i, r in enumerate(rows) if usable(r[1])]
    out = []
    for i, qid, q in kept:
        if qid is None or qid % every:
            continue
        found = [(min(max(sum(a * b for a, b in zip(q, v)), LONG[0]), LONG[1]), vid) for j, vid, v in kept if j != i]
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(qid, n + 1, vid, s) for n, (s, vid) in enumerate(found[:k])]
    return sorted(out, key=str)


def search(df, every, k, **sizes):
    found = topk.search_top_k(df, F.col("vec_id") % every == 0, k, **sizes)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def vectors(kind: str, n: int = 300):
    rng = random.Random(kind)
    if kind == "clustered":
        middles = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(6)]
        return [(i, [m + rng.gauss(0, 0.3) for m in rng.choice(middles)], 0) for i in range(n)]
    if kind == "sparse":
        return [(i, [rng.choice([0.0, 0.0, 0.0, 0.0, rng.uniform(-1, 1)]) for _ in range(40)], 0) for i in range(n)]
    if kind == "ties":
        return [(i, [float(rng.randrange(2)) for _ in range(5)], 0) for i in range(n)]
    if kind == "negative":
        return [(i, [-rng.random() if i % 10 else rng.random() for _ in range(8)], 0) for i in range(n)]
    return [(i, [rng.gauss(0, 0.125) for _ in range(64)], 0) for i in range(n)]


@pytest.mark.parametrize("kind", ["clustered", "sparse", "ties", "negative", "normal"])
def test_equals_all_pairs(make, kind):
    rows = vectors(kind)
    assert search(make(VECTORS, rows), 20, 10, shard_rows=64, block_rows=5) == brute(rows, 20, 10)


def test_odd_vectors(make):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0], 0), (0, [1.0, 2.0], 0), (0, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (1, None, 0), (2, [], 0),
            (3, [None, 1.0], 0), (4, [nan, 1.0], 0), (5, [1.0, -inf], 0), (6, [0.0, 0.0], None), (7, [-1.0, -2.0], 0),
            (8, [0.00097, -0.00097], 0), (10, [3.0], 0), (20, [1.0, 2.0, 3.0, 4.0], 0), (30, [], 0), (40, None, 0),
            (None, None, None)]
    df = make(VECTORS, rows)
    for table in (df, clashing(df).withColumn("row", F.lit("x")).withColumn("id", F.lit("x")).withColumn("vec", F.lit(1))):
        assert search(table, 10, 4) == brute(rows, 10, 4)
        assert search(table, 10, 40, shard_rows=2, block_rows=2) == brute(rows, 10, 40)


def test_scores_beyond_a_long(make):
    rows = [(0, [3e38, 1.0], 0), (1, [3e38, 1.0], 0), (2, [-3e38, 1.0], 0), (3, [-2e38, 5.0], 0), (10, [1e10, 2.5], 0),
            (11, [-1e12, 0.0], 0), (20, [0.5, 1e-3], 0), (21, [1e18, 0.0], 0)]
    for k in (3, 7, 20):
        assert search(make(VECTORS, rows), 10, k) == brute(rows, 10, k)


def test_empty_tables(make):
    assert search(make(VECTORS, []), 20, 10) == []
    assert search(make(VECTORS, [(1, [1.0], 0), (3, [1.0], 0)]), 20, 10) == []
    assert search(make(VECTORS, [(20, [1.0], 0)]), 20, 10) == []


def test_bounds_spare_work(monkeypatch):
    """In a shard of clustered vectors most documents are not probed to the end, and a far shard is not traversed."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    near = rng.normal(0, 0.05, (1000, 32)) + np.repeat(rng.normal(0, 1, (20, 32)), 50, axis=0)
    table = pa.table({"row": np.arange(1000), "id": np.arange(1000), "vec": list(near)})
    shard = topk.Shard(topk.Sparse(table, 1024))
    probed = []
    real = shard.component
    monkeypatch.setattr(shard, "component", lambda d, c: probed.append(len(c)) or real(d, c))
    q = topk.Sparse(table.slice(0, 1), 1024)
    found, scores = shard.search(q.dims, q.values, 0, 10)
    exact = (np.floor(near * 1024) @ np.floor(near[0] * 1024)).astype(int)
    exact[0] = -10**18
    assert scores.tolist() == sorted(exact.tolist(), reverse=True)[:10]
    assert sum(probed) < 0.5 * 1000 * 32
