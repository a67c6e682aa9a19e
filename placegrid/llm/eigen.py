"""Leading eigenpairs of a symmetric matrix: tridiagonalisation, bisection on Sturm counts, inverse iteration."""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
CLUSTER = 1e-3  # eigenvalues closer than this share of the norm are made orthogonal to each other


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the Householder vectors that lead there."""
    a, n, reflectors = np.array(a, float), len(a), []
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        if size <= EPS * np.abs(a).max() * 1e-3:
            reflectors.append(None)
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1:, k] -= 2 * v * (v @ a[k + 1:, k])
        reflectors.append(v)
    return np.diag(a).copy(), np.array([a[i + 1, i] for i in range(n - 1)]), reflectors


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie below each value of `at`."""
    tiny = EPS * (np.abs(diagonal).max() + np.abs(off).max(initial=0) + np.finfo(float).tiny)
    q = diagonal[0] - at
    count = (q < 0).astype(int)
    for d, e in zip(diagonal[1:], off * off):
        q = d - at - e / np.where(np.abs(q) < tiny * EPS, -tiny * EPS - np.finfo(float).tiny, q)
        count += q < 0
    return count


def largest(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection of all at once."""
    n = len(diagonal)
    around = np.abs(np.concatenate([off, [0.0]])) + np.abs(np.concatenate([[0.0], off]))
    low, high = np.full(k, (diagonal - around).min()), np.full(k, (diagonal + around).max())
    pad = EPS * 8 * max(abs(low[0]), abs(high[0])) + np.finfo(float).tiny
    low, high, at_most = low - pad, high + pad, n - 1 - np.arange(k)
    for _ in range(200):
        middle = (low + high) / 2
        up = below(diagonal, off, middle) <= at_most  # the eigenvalue is not below the middle
        low, high = np.where(up, middle, low), np.where(up, high, middle)
        if (high - low <= EPS * np.maximum(np.abs(low), np.abs(high))).all():
            break
    return (low + high) / 2


def solved(diagonal: np.ndarray, off: np.ndarray, b: np.ndarray, floor: float) -> np.ndarray:
    """x of a tridiagonal system by elimination with row exchanges; pivots below `floor` become `floor`."""
    n = len(diagonal)
    u0, u1, u2, y = diagonal.copy(), np.append(off, 0.0), np.zeros(n), b.copy()
    for i in range(n - 1):
        below_, d, e = off[i], u0[i + 1], u1[i + 1]
        if abs(below_) > abs(u0[i]):
            u0[i], below_ = below_, u0[i]
            u1[i], d = d, u1[i]
            u2[i], e = e, 0.0
            y[i], y[i + 1] = y[i + 1], y[i]
        if abs(u0[i]) < floor:
            u0[i] = floor
        f = below_ / u0[i]
        u0[i + 1], u1[i + 1], y[i + 1] = d - f * u1[i], e - f * u2[i], y[i + 1] - f * y[i]
    if abs(u0[-1]) < floor:
        u0[-1] = floor
    x = np.zeros(n)
    for i in range(n - 1, -1, -1):
        rest = y[i] - (u1[i] * x[i + 1] if i + 1 < n else 0) - (u2[i] * x[i + 2] if i + 2 < n else 0)
        x[i] = rest / u0[i]
        if abs(x[i]) > 1e150:
            y, x = y * 1e-150, x * 1e-150
    return x


def vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """An eigenvector for each value (rows); those of a cluster are kept orthogonal while they are iterated."""
    n, norm = len(diagonal), float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0)) or 1.0
    random, out, cluster = np.random.default_rng(11), np.zeros((len(values), n)), 0
    shift = np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            cluster = j
        # equal values are told apart, or their systems would be the same
        shift = value if j == cluster else min(value, shift - 10 * EPS * norm)
        v = random.normal(size=n)
        for _ in range(6):
            v = solved(diagonal - shift, off, v / np.linalg.norm(v), EPS * norm)
            for _ in range(2):
                v /= np.linalg.norm(v)
                v -= out[cluster:j].T @ (out[cluster:j] @ v)
        out[j] = v / np.linalg.norm(v)
    return out


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as rows; the largest entry of each is positive."""
    n = len(a)
    k = min(k, n)
    scale = float(np.abs(a).max())
    if not n or not scale:
        return np.zeros(k), np.eye(n)[:k]
    diagonal, off, reflectors = tridiagonal(a / scale)
    values = largest(diagonal, off, k)
    rows = vectors(diagonal, off, values)
    for at in range(len(reflectors) - 1, -1, -1):
        if (v := reflectors[at]) is not None:
            rows[:, at + 1:] -= 2 * np.outer(rows[:, at + 1:] @ v, v)
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    top = np.abs(rows).argmax(axis=1)
    return values * scale, rows * np.sign(rows[np.arange(k), top])[:, None]
