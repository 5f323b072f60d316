"""Small linear models that are trained on the driver from bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of an L2-penalised logistic regression by Newton steps; the last column is the free constant."""
    x = np.hstack([np.asarray(x, float), np.ones((len(x), 1))])
    y = np.asarray(y, float)
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(curve, slope)
        size = np.abs(step).max(initial=0)
        w -= step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-6:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(np.asarray(x, float) @ w[:-1] + w[-1])
