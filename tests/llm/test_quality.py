import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import quality
from pathloom.llm.common import table
from tests.llm.cases import DOCS, clashing, odd_rows

SF = "/root/testdata/sf0.01"


def test_held_out_documents_are_scored_right(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).join(labels, "doc_id").select("doc_id", "score", "quality").collect()
    out = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum((r.score >= quality.THRESHOLD) == bool(r.quality) for r in out)
    assert len(out) > 40 and right / len(out) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    high = np.mean([r.score for r in out if r.quality])
    low = np.mean([r.score for r in out if not r.quality])
    assert high > 0.9 and low < 0.2


def test_held_out_fifth(make):
    ids = make("doc_id long", [(i,) for i in [0, 1, 17, 123456789]] + [(None,)])
    for r in ids.withColumn("h", quality.held_out(F.col("doc_id"))).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def pooled_by_force(y, w):
    """The non-decreasing fit of least squares: of every block that ends here the largest least mean over later ends."""
    n = len(y)
    mean = [[np.average(y[i:j + 1], weights=w[i:j + 1]) if j >= i else None for j in range(n)] for i in range(n)]
    return np.array([max(min(mean[i][j] for j in range(k, n)) for i in range(k + 1)) for k in range(n)])


def test_pooled_is_the_least_squares_fit():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 50):
        for ties in (False, True):
            x, w = np.arange(float(n)), rng.integers(1, 9, n)
            y = rng.integers(0, 3, n) / 2 if ties else rng.random(n)
            grid, level = quality.pooled(x, y, w)
            assert (np.diff(level) > 0).all() and (np.diff(grid) > 0).all()
            want = pooled_by_force(y, w)
            steps, first = np.unique(np.round(want, 12), return_index=True)
            assert level == pytest.approx(want[first])
            ends = [*first[1:], n]
            assert grid == pytest.approx([np.average(x[a:b], weights=w[a:b]) for a, b in zip(first, ends)])
            assert np.average(want, weights=w) == pytest.approx(np.average(y, weights=w))


def test_weights_are_the_ridge_solution(spark):
    """Against one least-squares problem over the whole matrix, the penalty as further rows."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.fit(docs, labels)
    known = labels.where("quality IS NOT NULL").where(~quality.held_out(F.col("doc_id")))
    rows = quality.described(docs, ("doc_id",)).join(known, "doc_id").select("stats", "quality").collect()
    stats, y = np.array([r.stats for r in rows]), np.array([float(r.quality > 0) for r in rows])
    assert model.mean == pytest.approx(stats.mean(0)) and len(y) > 50
    z = quality.lifted(stats, model.mean, model.scale)
    penalty = np.sqrt(quality.RIDGE * len(y) + 1e-3) * np.eye(z.shape[1])
    want = np.linalg.lstsq(np.vstack([z, penalty]), np.concatenate([y, np.zeros(len(penalty))]), rcond=None)[0]
    assert model.weights == pytest.approx(want, abs=1e-6)


def test_waves_approximate_the_kernel():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(40, quality.STATISTICS)) * 0.5
    z = quality.lifted(a, np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))[:, :-1]
    kernel = np.exp(-((a[:, None] - a[None]) ** 2).sum(-1) / (2 * quality.STATISTICS))
    assert np.abs(z @ z.T - kernel).mean() < 0.08


def test_bounded_training_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    assert quality.fit(docs, labels, max_train=100).weights is not None


def test_odd_rows(make):
    docs = make(DOCS, odd_rows())
    labels = make("doc_id long, quality int, toxic int", [(i, None if i == 3 else i % 2, None) for i in range(12)] * 2)
    empty, nobody = make(DOCS, []), make("doc_id long, quality int, toxic int", [])
    for t in (docs, clashing(docs)):
        model = quality.fit(t, labels)
        rows = quality.score(t, model).collect()
        assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    blank = quality.fit(docs, nobody)
    assert {r.score for r in quality.score(docs, blank).collect()} == {0.5}
    assert quality.score(empty, quality.fit(empty, labels)).count() == 0
