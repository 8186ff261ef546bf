"""Logistic regression for a few features, fitted by Newton's method on the driver."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, weights with the constant last) of a ridge fit on standardised columns; weight: rows that each row stands for."""
    weight = np.ones(len(x)) if weight is None else weight
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    a = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    keep = np.full(a.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(keep), a.T @ (weight * (y - p)) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def logits(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    mean, scale, w = model
    return np.clip((x - mean) / scale @ w[:-1] + w[-1], -30, 30)
