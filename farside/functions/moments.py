"""Sums of many plane waves as one polynomial in their wave vectors.

Up to a length, exp(2 pi i u s) is a product of Chebyshev polynomials of u's three components, with factors that depend on the
direction s alone (Jacobi and Anger). So what a number of baselines with values give in any direction follows from sums of those
polynomials times their values: as many sums as the greatest length needs, however many baselines there are.
"""

from __future__ import annotations

import functools
import math

import numpy as np

#: Greatest error in any direction for values whose absolute values add up to 1. Rows and places worked on at once.
TOLERANCE, ROWS = 1e-13, 1024


def count(degree: int) -> int:
    return (degree + 1) * (degree + 2) * (degree + 3) // 6


def factors(x: np.ndarray, length: float, degree: int) -> np.ndarray:
    """(n, degree + 1) of the polynomials of u / length in exp(2 pi i u x), for one component of directions."""
    a = 2 * math.pi * length
    nodes = int(a) + 60
    theta = (np.arange(nodes) + 0.5) * (math.pi / nodes)
    of = np.cos(np.outer(theta, np.arange(degree + 1))) * (2 / nodes)
    of[:, 0] /= 2
    return np.exp(1j * a * np.outer(x, np.cos(theta))) @ of


@functools.cache
def degree_for(length: float) -> int:
    """The least total degree whose left-out terms are below the tolerance for all lengths up to this one."""
    rng = np.random.default_rng(11)
    at = np.concatenate([np.eye(3), np.abs(rng.normal(size=(200, 3))), [[1.0, 1.0, 1.0], [1.0, 1.0, 0.0], [1.0, 0.0, 1.0], [0.0, 1.0, 1.0]]])
    at /= np.linalg.norm(at, axis=1)[:, None]
    most = int(2 * math.pi * length) + 50
    powers = np.cumsum(np.log(np.maximum(1, np.arange(most + 1))))
    with np.errstate(divide="ignore", invalid="ignore"):
        # Bessel functions are below (x / 2)^n / n!, where factors are nothing but rounding
        bounds = [np.nan_to_num(2 * np.exp(np.arange(most + 1) * np.log(math.pi * length * np.abs(at[:, a]))[:, None] - powers), nan=2.0) for a in range(3)]
    sizes = [np.minimum(np.abs(factors(at[:, a], length, most)), b) for a, b in enumerate(bounds)]
    tails = [np.cumsum(np.convolve(np.convolve(x, y), z)[::-1])[::-1] for x, y, z in zip(*sizes)]
    return int(next(n for n in range(3 * most) if max(t[n + 1] for t in tails) <= TOLERANCE))


@functools.cache
def _pairs(degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Degrees (i, j) with a sum up to `degree`, and which k go with each of them."""
    i, j = np.nonzero(np.add.outer(np.arange(degree + 1), np.arange(degree + 1)) <= degree)
    return i, j, (i + j)[:, None] + np.arange(degree + 1) <= degree


def moments(rows: np.ndarray, z: np.ndarray, length: float, degree: int) -> np.ndarray:
    """(count(degree), 2): sums over wave vectors (n, 3) up to a length of values z (n, 2) times polynomials."""
    i, j, kept = _pairs(degree)
    out = np.zeros((len(i), 2 * (degree + 1)))
    for at in range(0, len(rows), ROWS):
        u, v, w = (np.polynomial.chebyshev.chebvander(rows[at : at + ROWS, a] / length, degree) for a in range(3))
        own = z[at : at + ROWS]
        out += (u[:, i] * v[:, j]).T @ np.concatenate([w * own[:, :1], w * own[:, 1:]], axis=1)
    return np.stack([out[:, : degree + 1][kept], out[:, degree + 1 :][kept]], axis=1)


def values(sums: np.ndarray, at: np.ndarray, length: float, degree: int) -> np.ndarray:
    """(directions, 2) of moments."""
    i, j, kept = _pairs(degree)
    whole = np.zeros(kept.shape, complex)
    whole[kept] = sums[:, 0] + 1j * sums[:, 1]
    out = np.zeros(len(at), complex)
    for k in range(0, len(at), ROWS):
        x, y, n = (factors(at[k : k + ROWS, a], length, degree) for a in range(3))
        out[k : k + ROWS] = (x[:, i] * y[:, j] * (n @ whole.T)).sum(1)
    return np.stack([out.real, out.imag], axis=1)
