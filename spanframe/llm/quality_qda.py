"""Operator 1: quality score by a regularised quadratic discriminant.

Each class of labelled texts is a Gaussian over transformed document statistics. Its covariance is shrunk towards the pooled one and
towards a scaled identity; the Cholesky factors are made once and sent to the tasks, which score blocks of texts: the score is
a logistic function, fitted on the same sample, of the difference of the two log densities (Mahalanobis term and log determinant).

Defined results: null and empty texts are scored like any other, by the statistics of an empty text; rows with a null or repeated
doc_id are scored each; label rows that contradict each other or have nulls are not learnt from; with fewer than two rows of a class every score
is the share of label 1 (0.5 without labels); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.llm import arrays as A
from spanframe.llm import linear, stats
from spanframe.llm.calibrate import platt
from spanframe.llm.common import fold, labelled, text_blocks

#: Labelled rows of each class that the fit takes at most, about.
PER_CLASS = 8000
#: Shares of the class's own, the pooled and the scaled identity covariance.
OWN, POOLED, ROUND = 0.80, 0.15, 0.05


@dataclass
class Discriminant:
    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    logdets: list[float]
    slope: float
    base: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0, compressed so that far texts don't overflow the calibration."""
        z = (x - self.centre) / self.scale
        out = []
        for mean, inverse, logdet in zip(self.means, self.factors, self.logdets):
            out.append(-0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) - 0.5 * logdet)
        d = (out[1] - out[0]) / len(self.centre)
        return np.sign(d) * np.log1p(np.abs(d))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.factors:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.base, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Discriminant:
    """Fit on rows of statistics, labels and weights (rows each stands for)."""
    total = w.sum()
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        share = float((w * y).sum() / total) if total else 0.5
        return Discriminant(np.zeros(0), np.ones(0), [], [], [], 0.0, share)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / scale
    means = [z[y == k].mean(0) for k in (0, 1)]
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).sum() * own[k] for k in (0, 1)) / len(y)
    factors, logdets = [], []
    for k in (0, 1):
        n = (y == k).sum()
        keep = OWN * n / (n + len(centre))  # few rows: closer to the pooled covariance
        cov = keep * own[k] + (1 - keep - ROUND) * pooled + ROUND * np.eye(len(centre)) * np.trace(pooled) / len(centre) + 1e-6 * np.eye(len(centre))
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        logdets.append(2 * float(np.log(np.diag(lower)).sum()))
    model = Discriminant(centre, scale, means, factors, logdets, 1.0, 0.0)
    model.slope, model.base = platt(model.difference(x), y, w)
    return model


def _features(block: pa.RecordBatch) -> np.ndarray:
    return stats.features(stats.counts(*A.raw(block.column("text"))))


def learn(documents: DataFrame, labels: DataFrame, folds: int, held: int, per_class: int = PER_CLASS) -> Discriminant:
    """Fit on a bounded sample of labelled rows outside the held fold; the driver gets their statistics only."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(list(_features(block)), pa.list_(pa.float64())), block.column("label"), block.column("weight")], names=["x", "label", "weight"])

    sample = labelled(documents, labels, "quality", folds, held, per_class).select("text", "label", "weight")
    got = sample.mapInArrow(rows, "x array<double>, label int, weight double").toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(got.num_rows, -1) if got.num_rows else np.zeros((0, 1))
    return fit(x, got["label"].to_numpy(), got["weight"].to_numpy())


def score(documents: DataFrame, model: Discriminant, *keep: str, name: str = "score") -> DataFrame:
    """The kept columns and the score, under ``name``, of every row."""
    return linear.apply_blocks(documents, "text", keep, lambda _, data, ends: {name: model.score(stats.features(stats.counts(data, ends)))}, f"`{name}` double")


def verdicts(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(folds: int, held: int) -> Column:
    """Whether the row's fold is the held one; false for a null id, which is never learnt from."""
    return F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out")
