"""Turning margins into probabilities."""

from __future__ import annotations

import numpy as np


def platt(d: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope (not negative) and base of a weighted logistic regression of y on d, by Newton steps with a small ridge."""
    a, b = 0.0, float(np.log((w[y == 1].sum() + 1) / (w[y == 0].sum() + 1)))
    w = w / w.sum() * len(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -50, 50)))
        g = np.array([(w * (p - y) * d).sum() + 1e-3 * a, (w * (p - y)).sum()])
        v = w * p * (1 - p) + 1e-9
        h = np.array([[(v * d * d).sum() + 1e-3, (v * d).sum()], [(v * d).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    return max(a, 0.0), b
