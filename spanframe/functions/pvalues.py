"""P-values for aggregated rows, as Arrow-batched functions.

These run on one row per tested pair (or probe), after all aggregation; the
heavy part of every test stays in built-in aggregates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray, terms: int = 300) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) on arrays, by its continued fraction."""
    x, a, b = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float), np.asarray(b, float))
    flip = x > (a + 1.0) / (a + b + 2.0)
    u, p, q = np.where(flip, 1.0 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    inside = (u > 0.0) & (u < 1.0)
    safe = np.where(inside, u, 0.5)
    lgamma = np.frompyfunc(math.lgamma, 1, 1)
    log_front = (
        p * np.log(safe)
        + q * np.log1p(-safe)
        - (lgamma(p) + lgamma(q) - lgamma(p + q)).astype(float)
    )
    # Evaluate the fraction backwards from a fixed depth; converges for u below the switch point.
    tail = np.ones_like(safe)
    for m in range(terms, 0, -1):
        odd = -(p + m - 1) * (p + q + m - 1) * safe / ((p + 2 * m - 2) * (p + 2 * m - 1))
        even = m * (q - m) * safe / ((p + 2 * m - 1) * (p + 2 * m))
        tail = 1.0 + odd / (1.0 + even / tail)
    value = np.where(inside, np.exp(log_front) / (p * tail), np.where(u >= 1.0, 1.0, 0.0))
    return np.where(flip, 1.0 - value, value)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    p = incomplete_beta(df / (df + t * t), df / 2.0, np.full_like(df, 0.5))
    return np.where(df > 0, p, 1.0)


_SMALL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 256)))])


def log_factorial(n: np.ndarray) -> np.ndarray:
    """ln n! on arrays: a table below 256, Stirling's series from there."""
    n = np.asarray(n, float)
    x = np.maximum(n, 255.0) + 1.0
    inverse = 1.0 / x
    square = inverse * inverse
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + inverse * (1 / 12 - square * (1 / 360 - square / 1260))
    return np.where(n < 256, _SMALL[np.minimum(n, 255).astype(int)], series)


def _walk(term: np.ndarray, k: np.ndarray, end: np.ndarray, step: int, row: np.ndarray, column: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Sums of hypergeometric terms from cell ``k`` outward to ``end``, for all tables at once: each term is the one before times a ratio.

    Terms fall from cell to cell there, so a table leaves the walk once its terms no longer change its sum.
    """
    out = term.copy()
    at = np.flatnonzero((term > 0) & (k != end))
    t, k, end, row, column, total = (x[at].astype(float) for x in (term, k, end, row, column, total))
    sums = t.copy()
    while len(at):
        for _ in range(16):
            t = t * _ratio(k, step, row, column, total)
            k = k + step
            sums += t
        live = (t > 1e-18 * sums) & ((end - k) * step > 0)
        if not live.all():
            out[at[~live]] = sums[~live]
            at, t, k, end, row, column, total, sums = (x[live] for x in (at, t, k, end, row, column, total, sums))
    return out


def _ratio(k: np.ndarray, step: int, row: np.ndarray, column: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Probability of the next cell over that of cell ``k``."""
    if step > 0:
        return (row - k) * (column - k) / ((k + 1) * (total - row - column + k + 1))
    return k * (total - row - column + k) / ((row - k + 1) * (column - k + 1))


def _between(term: np.ndarray, k: np.ndarray, count: np.ndarray, step: int, row: np.ndarray, column: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Sums of the ``count`` terms after cell ``k``."""
    order = np.argsort(-count, kind="stable")
    t, k, row, column, total = (x[order].astype(float) for x in (term, k, row, column, total))
    count, sums = count[order], np.zeros(len(order))
    for j in range(int(count.max(initial=0))):
        n = int(np.searchsorted(-count, -j, "left"))  # tables with more than j terms come first
        t[:n] *= _ratio(k[:n], step, row[:n], column[:n], total[:n])
        k[:n] += step
        sums[:n] += t[:n]
    out = np.empty(len(order))
    out[order] = sums
    return out


def fisher_two_sided_many(both: np.ndarray, a_only: np.ndarray, b_only: np.ndarray, neither: np.ndarray) -> np.ndarray:
    """Two-sided hypergeometric p of many tables: sums over cells no likelier than the observed one.

    Probabilities rise to one mode and fall from it, so those cells are two tails: one from the observed cell outward, and one on the other side of the mode from
    the first cell that is no likelier, found by bisection. Work follows the widths of the distributions, not the sizes of the tables.
    """
    both, a_only, b_only, neither = (np.asarray(v, np.int64) for v in (both, a_only, b_only, neither))
    total, row, column = both + a_only + b_only + neither, both + a_only, both + b_only
    low, high = np.maximum(0, row + column - total), np.minimum(row, column)

    margins = log_factorial(row) + log_factorial(total - row) + log_factorial(column) + log_factorial(total - column) - log_factorial(total)

    def log_p(k: np.ndarray, i=slice(None)) -> np.ndarray:
        r, c, n = row[i], column[i], total[i]
        return margins[i] - (log_factorial(k) + log_factorial(r - k) + log_factorial(c - k) + log_factorial(n - r - c + k))

    mode = np.clip(((row + 1) * (column + 1)) // (total + 2), low, high)
    observed = log_p(both)
    # Equal up to rounding, whose size follows that of the logarithms.
    limit = observed + np.maximum(1e-10, 1e-15 * log_factorial(total))
    lower = both <= mode
    # The other tail's first cell: between the mode and the far end probabilities fall, so the first no likelier than observed is found by halving, around
    # the observed cell's mirror image where that helps.
    inner, outer = mode.copy(), np.where(lower, high, low)
    none = log_p(outer) > limit
    away = np.where(lower, 1, -1)
    width = 8 + np.abs(mode - both) // 8
    for offset in (-width, width):
        guess = np.clip(2 * mode - both + away * offset, low, high)
        guess = np.where(lower, np.clip(guess, inner, outer), np.clip(guess, outer, inner))
        fits = log_p(guess) <= limit
        outer, inner = np.where(fits & ~none, guess, outer), np.where(fits, inner, guess)
    at = np.flatnonzero(~none & (inner != outer))
    while len(at):
        up, i, o = lower[at], inner[at], outer[at]
        middle = np.where(up, (i + o) // 2, -((-i - o) // 2))
        fits = log_p(middle, at) <= limit[at]
        outer[at] = np.where(fits, middle, o)
        inner[at] = np.where(fits, i, np.where(up, np.minimum(middle + 1, o), np.maximum(middle - 1, o)))
        at = at[inner[at] != outer[at]]
    far = np.where(none, 0.0, np.exp(log_p(outer)))
    near = np.exp(observed)
    same = ~none & (outer == both)
    p = np.empty(len(total))
    # Few likelier cells between the tails: one less their sum, which is then no small difference of large numbers.
    inside = np.abs(np.where(none, np.where(lower, high, low), outer) - both) - np.where(none, 0, 1)
    spread = np.sqrt(np.maximum(1.0, row.astype(float) * column * (total - row) * (total - column)) / np.maximum(1.0, total.astype(float)) ** 3)
    short = ~same & ~none & (inside < spread)
    for side, step in ((short & lower, 1), (short & ~lower, -1)):
        i = np.flatnonzero(side & (inside > 0))
        p[short & (inside <= 0)] = 1.0
        p[i] = 1.0 - _between(near[i], both[i], inside[i], step, row[i], column[i], total[i])
    for side, step, end in ((~short & lower, -1, low), (~short & ~lower, 1, high)):
        i = np.flatnonzero(side)
        args = (row[i], column[i], total[i])
        p[i] = _walk(near[i], both[i], end[i], step, *args) + _walk(np.where(same[i], 0.0, far[i]), outer[i], (high if step < 0 else low)[i], -step, *args)
    p[same] = 1.0  # the observed cell is the mode
    return np.where(total > 0, np.minimum(1.0, p), 1.0)


def fisher_two_sided(both: int, a_only: int, b_only: int, neither: int) -> float:
    """The same for one table."""
    return float(fisher_two_sided_many(*(np.array([v]) for v in (both, a_only, b_only, neither)))[0])


@F.pandas_udf(DoubleType())
def p_value_t(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of a t statistic; null in, null out."""
    known = t.notna() & df.notna()
    out = pd.Series(np.nan, index=t.index, dtype=float)
    out[known] = t_two_sided(t[known].to_numpy(float), df[known].to_numpy(float))
    return out.astype(object).where(known, None)


@F.pandas_udf(DoubleType())
def p_value_fisher(both: pd.Series, a_only: pd.Series, b_only: pd.Series, neither: pd.Series) -> pd.Series:
    return pd.Series(fisher_two_sided_many(both, a_only, b_only, neither), dtype=float)
