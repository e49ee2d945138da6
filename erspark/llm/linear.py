"""Small linear models, trained on the driver from bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 20, seed: int = 7) -> np.ndarray:
    """Weights (bias last) of a linear support vector machine with squared hinge loss, by dual coordinate descent.
    ``y`` is +1 or -1; classes are weighted to equal mass."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    n = len(y)
    each = np.where(y > 0, n / max(1, 2 * (y > 0).sum()), n / max(1, 2 * (y < 0).sum()))
    slack = 1 / (2 * c * each)
    norm = (x * x).sum(axis=1) + slack
    alpha, w, order = np.zeros(n), np.zeros(x.shape[1]), np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(n):
            gradient = y[i] * (x[i] @ w) - 1 + slack[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / norm[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression by Newton's method with conjugate gradients."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w.astype(x.dtype))
        gradient = (p - y).astype(x.dtype) @ x + penalty * w
        weight = np.maximum(p * (1 - p), 1e-6)
        step, r = np.zeros_like(w), -gradient
        d, rr = r.copy(), r @ r
        for _ in range(15):
            if rr < 1e-8:
                break
            hd = (weight * (x @ d.astype(x.dtype))).astype(x.dtype) @ x + penalty * d
            a = rr / (d @ hd)
            step += a * d
            r = r - a * hd
            new = r @ r
            d, rr = r + new / rr * d, new
        w = w + step
        if np.abs(step).max() < 1e-3:
            break
    return w
