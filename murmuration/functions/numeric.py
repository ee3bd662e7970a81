"""Small dense numerics used inside tasks and for model-sized solves."""

from __future__ import annotations

import numpy as np


def digamma(x):
    """psi(x) for x > 0: the recurrence eight steps up, terms paired by x (x + 7), then the asymptotic series."""
    x = np.asarray(x, dtype=float)
    u = x * (x + 7)
    steps = (2 * x + 7) * (1 / u + 1 / (u + 6) + 1 / (u + 10) + 1 / (u + 12))
    x = x + 8
    r = 1 / (x * x)
    series = r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r * (1 / 132 - r * (691 / 32760 - r / 12))))))
    return np.log(x) - 0.5 / x - series - steps


def gammaln(x):
    """ln Gamma(x) for x > 0: recurrence up to 12, then Stirling's series."""
    x = np.array(x, dtype=float)
    shift = np.zeros_like(x)
    for _ in range(12):
        small = x < 12
        shift = np.where(small, shift + np.log(np.where(small, x, 1.0)), shift)
        x = np.where(small, x + 1, x)
    r = 1.0 / (x * x)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


def dirichlet_expectation(gamma):
    """psi(gamma) - psi(row sum), for one vector or for rows."""
    gamma = np.asarray(gamma, dtype=float)
    return digamma(gamma) - digamma(gamma.sum(axis=-1, keepdims=True))


def log_sum_exp(rows):
    top = rows.max(axis=-1, keepdims=True)
    return (top + np.log(np.exp(rows - top).sum(axis=-1, keepdims=True)))[..., 0]


def top_eigen(matrix, k: int):
    """The ``k`` largest eigenpairs of a symmetric matrix, each vector's largest entry positive."""
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values, vectors * np.where(lead < 0, -1.0, 1.0)


def triples(k: int):
    """Index arrays of the unique entries of a symmetric k x k x k tensor."""
    i, j, m = np.meshgrid(np.arange(k), np.arange(k), np.arange(k), indexing="ij")
    keep = (i <= j) & (j <= m)
    return i[keep], j[keep], m[keep]


def unpack_symmetric(packed, k: int):
    """The full symmetric tensor from its unique entries."""
    i, j, m = triples(k)
    full = np.zeros((k, k, k))
    for a, b, c in ((i, j, m), (i, m, j), (j, i, m), (j, m, i), (m, i, j), (m, j, i)):
        full[a, b, c] = packed
    return full


def cube_sum(rows):
    """Sum over rows of the outer product y x y x y."""
    k = rows.shape[1]
    pairs = (rows[:, :, None] * rows[:, None, :]).reshape(len(rows), k * k)
    return (rows.T @ pairs).reshape(k, k, k)


def symmetrize_pair(matrices, vectors):
    """Sum over n of S_n x y_n placed in all three positions, for symmetric S_n."""
    base = np.einsum("nij,nm->ijm", matrices, vectors)
    return base + base.transpose(0, 2, 1) + base.transpose(2, 1, 0)
