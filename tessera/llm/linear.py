"""Small linear models that the classifiers share.  Plain numpy on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Logistic:
    """L2-regularised logistic regression on standardised dense features, by Newton steps."""

    def __init__(self, l2: float = 1.0, rounds: int = 25):
        self.l2, self.rounds = l2, rounds

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        self.mean = x.mean(axis=0)
        self.scale = x.std(axis=0)
        self.scale[self.scale < 1e-9] = 1.0
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        weight = np.ones(len(x)) if weight is None else weight
        w = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], self.l2)
        ridge[-1] = 1e-6
        for _ in range(self.rounds):
            p = sigmoid(z @ w)
            grad = z.T @ (weight * (p - y)) + ridge * w
            h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(h, grad)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.w, self.b = w[:-1], w[-1]
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w + self.b

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x))


class SparseLogistic:
    """Logistic regression on sparse binary features, by Adagrad; rows are arrays of feature numbers."""

    def __init__(self, size: int, l2: float = 1e-5, epochs: int = 8, rate: float = 0.2, seed: int = 7):
        self.size, self.l2, self.epochs, self.rate, self.seed = size, l2, epochs, rate, seed

    def fit(self, rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray) -> SparseLogistic:
        rng = np.random.default_rng(self.seed)
        self.w = np.zeros(self.size)
        self.d = np.zeros(dense.shape[1])
        self.b = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        g_w, g_d, g_b = np.full(self.size, 1e-2), np.full(dense.shape[1], 1e-2), 1e-2
        for _ in range(self.epochs):
            for i in rng.permutation(len(rows)):
                f = rows[i]
                e = float(sigmoid(self.w[f].sum() + dense[i] @ self.d + self.b) - y[i])
                g = e + self.l2 * self.w[f]
                g_w[f] += g * g
                self.w[f] -= self.rate * g / np.sqrt(g_w[f])
                g = e * dense[i]
                g_d += g * g
                self.d -= self.rate * g / np.sqrt(g_d)
                g_b += e * e
                self.b -= self.rate * e / np.sqrt(g_b)
        return self

    def predict(self, rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        return sigmoid(np.array([self.w[f].sum() for f in rows]) + dense @ self.d + self.b)


def folds(n: int, k: int, seed: int = 11) -> np.ndarray:
    """The fold of each of n rows."""
    return np.random.default_rng(seed).permutation(n) % k
