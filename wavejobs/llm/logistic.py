"""A small ridge-regularised logistic curve, fitted by Newton's method."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float | None = None, steps: int = 30) -> Logistic:
        """``weight`` says how many rows each stands for; ``penalty`` of squared weights is a hundredth of the root of the rows by default."""
        weight = np.ones(len(x)) if weight is None else weight * (len(x) / weight.sum())
        mean = np.average(x, axis=0, weights=weight)
        scale = np.average((x - mean) ** 2, axis=0, weights=weight) ** 0.5 + 1e-9
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        w = np.zeros(z.shape[1])
        penalty = np.diag([0.01 * len(x) ** 0.5 if penalty is None else penalty] * x.shape[1] + [1e-9])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (weight * (p - y)) + penalty @ w
            hess = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + penalty
            step = np.linalg.solve(hess, grad)
            w -= np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break
        return cls(mean, scale, w)

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)))
