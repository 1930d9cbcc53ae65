"""Lapped orthogonal transform matrices in closed form (Malvar and Staelin), with mirrored edges."""

from __future__ import annotations

from functools import lru_cache
from math import cos, pi, sin, sqrt

import numpy as np

#: Angles of the plane rotations, as multiples of pi.
ANGLES = {8: (0.13, 0.16, 0.13), 16: (0.145,) * 7}


@lru_cache
def functions(length: int) -> np.ndarray:
    """The basis functions of a block (length x 2 length): even ones symmetric, odd ones antisymmetric."""
    n = length
    dct = np.array([[sqrt((1 if k == 0 else 2) / n) * cos(pi * k * (2 * t + 1) / (2 * n)) for t in range(n)] for k in range(n)])
    a = (dct[0::2] - dct[1::2]) / 2
    z = np.eye(n // 2)
    for k, angle in enumerate(ANGLES[length]):
        turn = np.eye(n // 2)
        c, s = cos(angle * pi), sin(angle * pi)
        turn[k : k + 2, k : k + 2] = [[c, s], [-s, c]]
        z = z @ turn
    out = np.empty((n, 2 * n))
    out[0::2] = np.hstack([a, a[:, ::-1]])
    out[1::2] = z.T @ np.hstack([a, -a[:, ::-1]])
    return out


@lru_cache
def matrix(n: int, length: int) -> np.ndarray:
    """The orthonormal n x n transform of n samples in blocks of a length; samples beyond the edges are mirrored."""
    if n % length:
        raise ValueError("samples must fill whole blocks")
    f, out = functions(length), np.zeros((n, n))
    for block in range(n // length):
        for t in range(2 * length):
            at = block * length + t - length // 2
            at = -at - 1 if at < 0 else 2 * n - at - 1 if at >= n else at
            out[block * length : (block + 1) * length, at] += f[:, t]
    return out


def forward(x: np.ndarray, length: int) -> np.ndarray:
    """The transform of the last axis, as by matrix(), block by block."""
    n, half = x.shape[-1], length // 2
    if n % length:
        raise ValueError("samples must fill whole blocks")
    wide = np.concatenate([x[..., :half][..., ::-1], x, x[..., n - half :][..., ::-1]], -1)
    windows = np.lib.stride_tricks.sliding_window_view(wide, 2 * length, -1)[..., ::length, :]
    return (windows @ functions(length).T).reshape(x.shape)


def backward(y: np.ndarray, length: int) -> np.ndarray:
    """The inverse of forward(): blocks overlap and are summed, and what lies beyond the edges is folded back."""
    n, half = y.shape[-1], length // 2
    if n % length:
        raise ValueError("samples must fill whole blocks")
    parts = y.reshape(*y.shape[:-1], n // length, length) @ functions(length)
    wide = np.zeros((*y.shape[:-1], n + length))
    wide[..., :n] += parts[..., :length].reshape(y.shape)
    wide[..., length:] += parts[..., length:].reshape(y.shape)
    x = wide[..., half : half + n].copy()
    x[..., :half] += wide[..., :half][..., ::-1]
    x[..., n - half :] += wide[..., half + n :][..., ::-1]
    return x


def coefficients(n: int, length: int) -> list[tuple[int, int, float]]:
    """(k, i, w) of the entries that aren't zero."""
    m = matrix(n, length)
    return [(int(k), int(i), float(m[k, i])) for k, i in zip(*np.nonzero(np.abs(m) > 1e-15))]


def values_sql(n: int, length: int) -> str:
    """The coefficients as a VALUES list (k, i, w)."""
    return "(VALUES " + ", ".join(f"({k}, {i}, {w!r}e0)" if "e" not in repr(w) else f"({k}, {i}, {w!r})" for k, i, w in coefficients(n, length)) + ") AS c(k, i, w)"
