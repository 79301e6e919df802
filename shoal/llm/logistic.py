"""Calibration: a small logistic regression on a bounded sample, by Newton's method."""

from __future__ import annotations

import numpy as np


def fit_logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-3, rounds: int = 100) -> np.ndarray:
    """Weights with the intercept last; zero weights and the log odds alone for one class or none."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    if len(labels) == 0:
        return w
    rate = (labels.sum() + 1) / (len(labels) + 2)
    w[-1] = np.log(rate / (1 - rate))
    if labels.min() == labels.max():
        return w
    keep = ridge * np.append(np.ones(features.shape[1]), 0.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - labels) / len(labels) + keep * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(labels) + np.diag(keep + 1e-12)
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def probabilities(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = features @ weights[:-1] + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
