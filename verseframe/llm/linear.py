"""Linear classifiers on hashed features, trained in numpy on a bounded sample and applied in Arrow batches."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np


def hash_ids(features: list[str] | np.ndarray, size: int) -> np.ndarray:
    """Places of features given by name, or by number."""
    if isinstance(features, np.ndarray):
        return features % size
    return np.fromiter((zlib.crc32(f.encode("utf-8", "surrogatepass")) for f in features), dtype=np.int64, count=len(features)) % size


@dataclass
class LinearModel:
    """One row of weights per label; log-odds of a row are the sum of its features' weights plus the bias."""

    weights: np.ndarray
    bias: np.ndarray

    @cached_property
    def by_feature(self) -> np.ndarray:
        """The weights with one row per feature, laid out for gathering many features at once."""
        return np.ascontiguousarray(self.weights.T)

    def log_odds(self, features: list[str] | np.ndarray) -> np.ndarray:
        ids = hash_ids(features, self.weights.shape[1])
        return self.bias + self.weights[:, ids].sum(axis=1)

    def many(self, ids: np.ndarray, sizes: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        """Log-odds of many rows at once: row i has the next sizes[i] of the places `ids`."""
        w = self.by_feature[ids]
        return self.bias + row_sums(w if values is None else w * values[:, None].astype(w.dtype), sizes)


def row_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over consecutive stretches of so many values (of their first axis); a stretch of none sums to 0."""
    out = np.zeros((len(sizes), *values.shape[1:]))
    some = np.flatnonzero(sizes)
    if len(some):
        starts = np.cumsum(sizes) - sizes
        out[some] = np.add.reduceat(values, starts[some], axis=0)
    return out


def fit(ids: np.ndarray, sizes: np.ndarray, labels: np.ndarray, size: int, values: np.ndarray | None = None, bears: np.ndarray | None = None, epochs: int = 5, rate: float = 0.3, l2: float = 1e-6, seed: int = 7, batch: int = 256) -> LinearModel:
    """Independent logistic regressions by AdaGrad over shuffled batches; labels has one column per label.

    Row i has the next sizes[i] of the places `ids`, with values (1 where not given). bears: how fast each place (row) is
    learnt for each label (column), 1 where not given; at 0 it keeps weight 0.
    """
    n, k = labels.shape
    w, b = np.zeros((size, k)), np.zeros(k)
    gw, gb = np.full((size, k), 1e-2), np.full(k, 1e-2)
    starts = np.cumsum(sizes) - sizes
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            part = order[lo : lo + batch]
            m = sizes[part]
            at = np.repeat(starts[part] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            flat, owner = ids[at], np.repeat(np.arange(len(part)), m)
            x = np.ones(len(at)) if values is None else values[at].astype(float)
            z = row_sums(w[flat] * x[:, None], m) + b
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]
            touched, inverse = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(inverse, weights=err[owner, j] * x, minlength=len(touched)) for j in range(k)], axis=1) + l2 * w[touched]
            gw[touched] += grad * grad
            w[touched] -= rate * grad / np.sqrt(gw[touched]) * (1.0 if bears is None else bears[touched])
            gb += err.sum(axis=0) ** 2
            b -= rate * err.sum(axis=0) / np.sqrt(gb)
    return LinearModel(np.ascontiguousarray(w.T.astype(np.float32)), b)


def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of places as one array and the size of each."""
    return (np.concatenate(rows) if rows else np.zeros(0, np.int64)), np.array([len(r) for r in rows], dtype=np.int64)
