"""Regression on lags whose weights follow a curve of two parameters: exponential Almon or beta. No Spark here.

y = a + b sum_k w_k(theta) x_k + e, with w the normalised exponentials of features(k) theta: (k, k^2) for Almon, (log z, log(1 - z)), z
the place of the lag between 0 and 1, for beta. Least squares by damped Gauss-Newton steps with the analytic gradient; as the sum of
squares has several valleys, fits start from several points and the best is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Where the weights of a start peak, as a share of the lags, and how sharply.
PEAKS, SHARP = (0.1, 0.3, 0.5, 0.7, 0.9), (0.05, 0.4)


def starts(kind: str, n: int) -> list[tuple[float, float]]:
    """Flat weights, and a hump at each of the peaks, wide and narrow."""
    if kind == "almon":
        return [(0.0, 0.0), *((2 * c * (1 + m * (n - 1)), -c) for c in SHARP for m in PEAKS)]
    return [(0.0, 0.0), *((60 * c * m, 60 * c * (1 - m)) for c in SHARP for m in PEAKS)]


def features(kind: str, n: int) -> np.ndarray:
    """n x 2."""
    k = np.arange(1, n + 1.0)
    if kind == "almon":
        return np.column_stack([k, k * k])
    z = np.clip((k - 1) / max(n - 1, 1), 1e-6, 1 - 1e-6)
    return np.column_stack([np.log(z), np.log(1 - z)])


def weights(theta: np.ndarray, phi: np.ndarray) -> np.ndarray:
    s = phi @ theta
    w = np.exp(s - s.max())
    return w / w.sum()


def gradient(theta: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """Derivatives of the weights by theta, n x 2."""
    w = weights(theta, phi)
    return w[:, None] * (phi - w @ phi)


@dataclass
class Fit:
    a: float
    b: float
    theta: np.ndarray
    weights: np.ndarray
    sse: float
    steps: int


def fitted(y: np.ndarray, x: np.ndarray, kind: str, start: tuple[float, float], most: int = 200, tolerance: float = 1e-10) -> Fit:
    """x: rows x lags, newest first. Stops when a step gains less than the tolerance of the sum of squares, or none can be made."""
    phi, theta = features(kind, x.shape[1]), np.array(start, float)

    def linear(t: np.ndarray) -> tuple[np.ndarray, float]:
        z = np.column_stack([np.ones(len(y)), x @ weights(t, phi)])
        c = np.linalg.lstsq(z, y, rcond=None)[0]
        return c, float(((y - z @ c) ** 2).sum())

    c, sse = linear(theta)
    damp, step = 1e-2, 0
    for step in range(1, most + 1):
        w = weights(theta, phi)
        e = y - c[0] - c[1] * (x @ w)
        j = np.column_stack([np.ones(len(y)), x @ w, c[1] * (x @ gradient(theta, phi))])
        normal, slope = j.T @ j, j.T @ e
        for _ in range(30):
            move = np.linalg.lstsq(normal + damp * np.diag(np.diag(normal) + 1e-12), slope, rcond=None)[0][2:]
            trial = theta + np.clip(move, -2, 2)
            c_new, new = linear(trial)  # the linear part is solved anew for each theta
            if new < sse:
                break
            damp *= 4
        else:
            break
        gain, theta, c, sse, damp = sse - new, trial, c_new, new, max(damp / 9, 1e-9)
        if gain <= tolerance * (sse + 1e-300):
            break
    return Fit(float(c[0]), float(c[1]), theta, weights(theta, phi), sse, step)


def best(fits: list[Fit]) -> Fit:
    return min(fits, key=lambda f: f.sse)
