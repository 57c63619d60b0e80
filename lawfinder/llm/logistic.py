"""Logistic regression on a few features, by penalised Newton steps."""

from __future__ import annotations

import numpy as np


def fit(features: np.ndarray, label: np.ndarray, penalty: float = 1.0, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, weights with the intercept first); one class only: a constant near that class."""
    means, scales = features.mean(axis=0), features.std(axis=0)
    scales = np.where(scales > 1e-9, scales, 1.0)
    x = np.hstack([np.ones((len(features), 1)), (features - means) / scales])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [penalty] * features.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge, x.T @ (label - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return means, scales, w


def apply(model: tuple[np.ndarray, np.ndarray, np.ndarray], features: np.ndarray) -> np.ndarray:
    means, scales, w = model
    z = w[0] + ((features - means) / scales) @ w[1:]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
