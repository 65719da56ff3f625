"""Quality score of documents: random Fourier features, ridge regression and isotonic calibration.

Statistics of a text (never its language, source or id) are standardised and lifted by random cosine waves, whose
inner products approximate a Gaussian kernel. Each bucket of training rows sums its part of the normal equations; the
driver adds up a fixed number of small matrices and solves for ridge scores. Scores of rows by models that have not
seen their fold are binned, and pooling adjacent violators over the bins gives the calibration.

Training rows are the labelled ones outside the held-out fifth. Up to ``MAX_TRAIN`` of them are used, taken by hash if
there are more; everything else runs over all rows. Defined results: an empty or null text gets the score of its
statistics (all zero); without any training row every score is 0.5; rows come back one for one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import map_texts, staged

MAX_TRAIN = 200_000  # bound on the labelled rows that the model is fitted on
WAVES, BUCKETS, FOLDS, BINS, RIDGE = 192, 20, 5, 1000, 1e-4
THRESHOLD = 0.3

_CLASSES = (  # bytes whose share of the text is a statistic
    b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" ", b"\n\r", b".", b",;:", b"!?", b"|", b"#$%&*@^~",
    b"<>{}[]()=/\\_+", b"'\"-`",
)
STATISTICS = len(_CLASSES) + 7


def statistics(texts: list[str]) -> np.ndarray:
    """One row of ``STATISTICS`` numbers per text."""
    table = np.zeros((256, len(_CLASSES)))
    for i, c in enumerate(_CLASSES):
        table[list(c), i] = 1
    counts = np.zeros((len(texts), 256))
    more = np.zeros((len(texts), 7))
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        if not len(raw):
            continue
        counts[i] = np.bincount(raw, minlength=256)
        words, lines = t.split(), t.split("\n")
        n = max(1, len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
        more[i] = (np.log1p(len(raw)), np.log1p(len(words)), len(set(words)) / n, sizes.mean(), np.log1p(sizes.max()),
                   len(set(lines)) / len(lines), np.log1p(len(words) / len(lines)))
    shares = np.sqrt(counts @ table / np.maximum(1, counts.sum(1, keepdims=True)))
    return np.hstack([shares, more])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def described(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and ``stats`` of each whole text."""

    def make():
        import pyarrow as pa

        def run(texts):
            flat = statistics([t.as_py() for t in texts]).ravel()
            at = np.arange(0, len(flat) + 1, STATISTICS, dtype=np.int32)
            return [pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]

        return run

    return map_texts(docs, text_col, "stats array<double>", make, keep)


@dataclass(frozen=True)
class Model:
    """Everything a score needs; a few kilobytes. ``weights`` is None if there was nothing to learn from."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    grid: np.ndarray
    level: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(lifted(stats, self.mean, self.scale) @ self.weights, self.grid, self.level), 0, 1)


def lifted(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, with a constant; the waves are fixed by their seed."""
    rng = np.random.default_rng(11)
    waves = rng.normal(size=(STATISTICS, WAVES)) / np.sqrt(STATISTICS)
    phase = rng.uniform(0, 2 * np.pi, WAVES)
    x = np.clip((stats - mean) / scale, -6, 6)
    return np.hstack([np.sqrt(2 / WAVES) * np.cos(x @ waves + phase), np.ones((len(x), 1))])


def pooled(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit by pooling adjacent violators: where each block's middle is, and its level."""
    blocks: list[list[float]] = []  # sum of weight * x, sum of weight * y, weight
    for a, b, w in zip(x, y, weight):
        blocks.append([w * a, w * b, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """Fit on the labelled rows outside the held-out fifth."""
    ids = F.col("doc_id")
    known = labels.where(F.col(label).isNotNull() & ids.isNotNull() & ~held_out(ids)) \
        .select("doc_id", (F.col(label) > 0).cast("double").alias("y"))
    n = known.count()
    if n > max_train:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) < (max_train << 30) // n)
    bucket = F.pmod(F.xxhash64("doc_id", F.lit("bucket")), F.lit(BUCKETS)).cast("int")
    rows = staged(described(docs, ("doc_id",)).join(known, "doc_id").select("y", "stats", bucket.alias("bucket")),
                  "quality_train")
    moments = rows.agg(F.count(F.lit(1)), *[f(F.col("stats")[i]) for i in range(STATISTICS)
                                            for f in (F.avg, F.stddev_pop)]).first()
    nothing = np.zeros(1)
    if not moments[0]:
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), None, nothing, nothing)
    mean, scale = np.array(moments[1::2]), np.array(moments[2::2])
    scale = np.where(scale > 1e-9, scale, 1)

    def part(pdf):
        import pandas as pd

        z, y = lifted(np.stack(pdf["stats"]), mean, scale), pdf["y"].to_numpy()
        return pd.DataFrame({"fold": [int(pdf["bucket"].iloc[0]) % FOLDS], "gram": [(z.T @ z).tobytes()],
                             "moment": [(z.T @ y).tobytes()], "n": [len(y)]})

    parts = rows.groupBy("bucket").applyInPandas(part, "fold int, gram binary, moment binary, n long").collect()
    d = WAVES + 1
    gram, moment, count = np.zeros((FOLDS, d, d)), np.zeros((FOLDS, d)), np.zeros(FOLDS)
    for p in parts:  # at most BUCKETS of them
        gram[p.fold] += np.frombuffer(p.gram).reshape(d, d)
        moment[p.fold] += np.frombuffer(p.moment)
        count[p.fold] += p.n

    def solved(g, m, k):
        return np.linalg.solve(g + (RIDGE * k + 1e-3) * np.eye(d), m)

    weights = solved(gram.sum(0), moment.sum(0), count.sum())
    others = np.stack([solved(gram.sum(0) - gram[f], moment.sum(0) - moment[f], count.sum() - count[f])
                       for f in range(FOLDS)])

    def binned(batches):
        import pyarrow as pa

        for batch in batches:
            stats = batch.column("stats").flatten().to_numpy().reshape(-1, STATISTICS)
            fold = batch.column("bucket").to_numpy() % FOLDS
            raw = np.einsum("ij,ij->i", lifted(stats, mean, scale), others[fold])
            place = np.clip(((raw + 0.5) * BINS / 2).astype(np.int32), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), batch.column("y")], names=["bin", "y"])

    bins = (rows.mapInArrow(binned, "bin int, y double").groupBy("bin")
            .agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect())  # at most BINS rows
    grid, level = pooled(np.array([(b.bin + 0.5) * 2 / BINS - 0.5 for b in bins]), np.array([b.y for b in bins]),
                         np.array([b.n for b in bins]))
    return Model(mean, scale, weights, grid, level)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
          score_col: str = "score") -> DataFrame:
    """Columns ``keep`` and the score, from 0 to 1, of each whole text."""

    def make():
        import pyarrow as pa

        return lambda texts: [pa.array(model.score(statistics([t.as_py() for t in texts])), pa.float64())]

    return map_texts(docs, text_col, f"{score_col} double", make, keep)
