"""Operator 2: quality rules with a hashed word and character n-gram logistic regression.

Base rules count words, symbols, repeated lines and repeated five-word windows of the whole text. Texts that pass them are kept if the
calibrated probability of the regression reaches a fixed threshold. The regression is trained on a bounded sample of labelled rows in
shards and calibrated (Platt) on rows of the sample that training did not see; tasks score Arrow batches in blocks.

Defined results: a null text has no words, so it fails the base rules, as an empty one does; rows with a null or repeated doc_id are judged
each; contradicting and null labels are not learnt from; without labels of both classes the base rules decide alone; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm import arrays as A
from spanframe.llm import linear, stats
from spanframe.llm.common import labelled
from spanframe.llm.calibrate import platt

#: Labelled rows of each class that training and calibration take at most, about.
PER_CLASS = 4000
#: Kinds of n-grams, by words and by bytes.
WORDS, CHARS = (1, 2), (3, 4)
#: Fixed thresholds: least words, most percent of words in repeated windows, least probability.
LEAST_WORDS, MOST_REPEATED, LEAST_PROBABILITY = 10, 20, 0.5


def _margins(df: DataFrame, model: linear.Linear, *keep: str) -> DataFrame:
    return linear.apply_blocks(df, "text", keep, lambda _, data, ends: {"margin": model.margins(data, ends)[:, 0]}, "margin double")


def learn(documents: DataFrame, labels: DataFrame, folds: int, held: int, per_class: int = PER_CLASS) -> tuple[linear.Linear, float, float] | None:
    """The regression, and slope and base of its calibration."""
    sample = labelled(documents, labels, "quality", folds, held, per_class)
    fits = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(5)) > 0
    model = linear.train(sample.where(fits), lambda y: y[:, None].astype(float), WORDS, CHARS)
    if model is None:
        return None
    got = _margins(sample.where(~fits), model, "label", "weight").toArrow()
    y = got["label"].to_numpy()
    if len(set(y.tolist())) < 2:
        return (model, 1.0, 0.0)
    return (model, *platt(got["margin"].to_numpy(), y, got["weight"].to_numpy()))


def judge(documents: DataFrame, model: tuple[linear.Linear, float, float] | None, *keep: str) -> DataFrame:
    """The kept columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability of every row."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def rules(_: pa.Array, data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
        c = stats.counts(data, ends)
        failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])
        if model is None:
            probability = np.ones(len(failed))
        else:
            regression, slope, base = model
            probability = 1 / (1 + np.exp(-np.clip(slope * regression.margins(data, ends)[:, 0] + base, -500, 500)))
        return {n: c[n].astype(np.int64) for n in names} | {"base_failed": failed, "kept": ~failed & (probability >= LEAST_PROBABILITY), "probability": probability}

    return linear.apply_blocks(documents, "text", keep, rules, ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, probability double")
