"""Operator 5: language identification by error-correcting output codes.

Every language has a codeword; a binary regression on byte n-grams predicts each bit. A text gets the language whose codeword has
the least loss, each bit's loss weighted by how well that bit was predicted for that language on sample rows left out of training.
A text whose best two languages are close is flagged ambiguous.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and for all texts where no language could be learnt;
rows with a null or repeated doc_id are predicted each; null languages are not learnt from; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm import linear
from spanframe.llm.common import fold

#: Rows of each language that training and calibration take at most, about.
PER_LANGUAGE = 1000
CHARS = (2, 3, 4)
#: Least lead of the best language's probability over the second's.
LEAST_LEAD = 0.2
_ASCII = np.zeros(256, bool)
_ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _least_apart(words: np.ndarray, block: int = 1024) -> int:
    """Least number of differing bits of two words, by blocks of words against all."""
    least = words.shape[1]
    for first in range(0, len(words), block):
        own = words[first : first + block].astype(float)
        apart = own @ (1.0 - words.T) + (1.0 - own) @ words.T
        apart[np.arange(len(own)), first + np.arange(len(own))] = least
        least = min(least, int(apart.min()))
    return least


def codewords(k: int) -> np.ndarray:
    """k rows of 0/1: all ways to part up to five languages in two, else random words with the largest least distance of 50 draws."""
    if k < 2:
        return np.zeros((k, 0), int)
    if k <= 5:
        return np.array([[1 if i == 0 else (b >> (i - 1)) & 1 for b in range(2 ** (k - 1) - 1)] for i in range(k)])
    rng, bits, best, most = np.random.default_rng(11), int(np.ceil(6 * np.log2(k))), None, -1
    for _ in range(50):
        words = rng.integers(0, 2, (k, bits))
        least = _least_apart(words)
        if least > most and all(0 < s < k for s in words.sum(0)):
            best, most = words, least
    return best if best is not None else words


@dataclass
class Codes:
    languages: list[str]
    words: np.ndarray
    trust: np.ndarray
    bits: linear.Linear | None
    heat: float = 1.0

    def losses(self, margins: np.ndarray) -> np.ndarray:
        sign = 2 * self.words - 1
        return np.stack([(np.logaddexp(0, -margins * sign[i]) * self.trust[i]).sum(1) for i in range(len(self.languages))], 1)

    def probabilities(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones((len(ends) - 1, len(self.languages)))
        loss = self.losses(self.bits.margins(data, ends)) * self.heat
        p = np.exp(loss.min(1, keepdims=True) - loss)
        return p / p.sum(1, keepdims=True)


def learn(documents: DataFrame, folds: int, held: int, per_language: int = PER_LANGUAGE) -> Codes:
    """Learn from a bounded sample of documents (doc_id, text, lang) outside the held fold."""
    rows = documents.select("doc_id", "text", "lang").where("text is not null and lang is not null").where(fold("doc_id", folds) != held)
    found = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # every language: the model has a codeword for each
    languages = sorted(found)
    words = codewords(len(languages))
    if len(languages) < 2:
        return Codes(languages, words, np.ones(words.shape), None)
    number = F.array_position(F.lit(languages), F.col("lang")).cast("int") - 1
    share = F.get(F.lit([min(1.0, per_language / found[name]) for name in languages]), number)
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("doc_id", "text", number.alias("label"), F.lit(1.0).alias("weight"))
    fits = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(5)) > 0
    bits = linear.train(sample.where(fits), lambda y: words[y].astype(float), (), CHARS, epochs=4)
    if bits is None:
        return Codes(languages, words, np.ones(words.shape), None)
    names = [f"m{b}" for b in range(words.shape[1])]
    got = linear.apply_blocks(
        sample.where(~fits), "text", ("label",), lambda _, data, ends: dict(zip(names, bits.margins(data, ends).T.copy())), ", ".join(f"{n} double" for n in names)
    ).toArrow()
    y, margins = got["label"].to_numpy(), np.stack([got[n].to_numpy() for n in names], 1)
    right = (margins > 0) == words[y]
    trust = np.stack([(right[y == i].sum(0) + 1) / ((y == i).sum() + 1.25) for i in range(len(languages))])
    codes = Codes(languages, words, trust / trust.sum(1, keepdims=True), bits)
    if len(y):
        loss = codes.losses(margins)

        def surprise(heat: float) -> float:
            low = loss.min(1, keepdims=True)
            return float((heat * (loss[np.arange(len(y)), y] - low[:, 0]) + np.log(np.exp(heat * (low - loss)).sum(1))).mean())

        codes.heat = min((1.0, 2.0, 4.0, 8.0, 16.0), key=surprise)
    return codes


def _lettered(texts: pa.Array, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.diff(np.concatenate([[0], np.cumsum(_ASCII[data])])[ends]) > 0
    for i in np.flatnonzero(~out & (np.diff(ends) > 0)):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return out


def identify(documents: DataFrame, codes: Codes, *keep: str) -> DataFrame:
    """The kept columns, lang_pred, score and ambiguous of every row."""

    def predict(texts: pa.Array, data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray | pa.Array]:
        known = _lettered(texts, data, ends) & (len(codes.languages) > 0)
        if not codes.languages:
            return {"lang_pred": pa.array(["und"] * len(known)), "score": np.zeros(len(known)), "ambiguous": np.ones(len(known), bool)}
        p = codes.probabilities(data, ends)
        best, top = p.argmax(1), np.sort(p, 1)
        lead = top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)
        return {
            "lang_pred": pa.array([codes.languages[b] if k else "und" for b, k in zip(best, known)], pa.string()),
            "score": np.where(known, np.clip(top[:, -1], 0, 1), 0.0), "ambiguous": ~known | (lead < LEAST_LEAD),
        }

    return linear.apply_blocks(documents, "text", keep, predict, "lang_pred string, score double, ambiguous boolean")
