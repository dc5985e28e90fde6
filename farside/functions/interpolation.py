"""Polynomials over a square of the sky: in a small cell a plane wave is known from its values at few points.

A cell is seen in Lambert's projection about its centre, in which the sphere is smooth far beyond any cell. Points are Padua's
of a total degree; waves between them follow from products of Chebyshev polynomials. The degree is found by trial.
"""

from __future__ import annotations

import functools
import math

import numpy as np

#: Greatest error of a wave of absolute value 1, and the greatest degree.
TOLERANCE, MOST = 1e-13, 48


def count(degree: int) -> int:
    return (degree + 1) * (degree + 2) // 2


@functools.cache
def padua(degree: int) -> np.ndarray:
    """(count, 2) points of the square from -1 to 1."""
    k, j = np.meshgrid(np.arange(degree + 1), np.arange(degree + 2), indexing="ij")
    some = (k + j) % 2 == 0
    return np.stack([np.cos(k[some] * math.pi / degree), np.cos(j[some] * math.pi / (degree + 1))], axis=1)


def terms(at: np.ndarray, degree: int) -> np.ndarray:
    """Products of polynomials up to the total degree at places (n, 2)."""
    i, j = np.nonzero(np.add.outer(np.arange(degree + 1), np.arange(degree + 1)) <= degree)
    x, y = (np.polynomial.chebyshev.chebvander(at[:, a], degree) for a in (0, 1))
    return x[:, i] * y[:, j]


@functools.cache
def solved(degree: int) -> np.ndarray:
    """From values at the points to factors of terms()."""
    return np.linalg.inv(terms(padua(degree), degree))


def axes(centre: np.ndarray) -> np.ndarray:
    """(3, 3): two axes of the tangent plane, and the centre."""
    off = np.eye(3)[np.argmin(np.abs(centre))]
    first = np.cross(centre, off)
    first /= np.linalg.norm(first)
    return np.stack([first, np.cross(centre, first), centre])


def projected(directions: np.ndarray, centre: np.ndarray, side: float) -> np.ndarray:
    """Directions (n, 3) as places in the square of half a side `side` about the centre."""
    x, y, z = axes(centre) @ directions.T
    return np.stack([x, y], axis=1) * (np.sqrt(2 / (1 + z)) / side)[:, None]


def directions(at: np.ndarray, centre: np.ndarray, side: float) -> np.ndarray:
    """The other way round."""
    x, y = at.T * side
    square = x * x + y * y
    far = np.sqrt(1 - square / 4)
    return np.stack([x * far, y * far, 1 - square / 2], axis=1) @ axes(centre)


@functools.cache
def _trial() -> tuple[np.ndarray, np.ndarray]:
    """Places in the disc and directions of waves."""
    rng = np.random.default_rng(7)
    angle, far = rng.uniform(0, 2 * math.pi, 300), np.sqrt(rng.uniform(0, 1, 300))
    far[:60] = 1.0
    waves = rng.normal(size=(24, 3))
    waves[:8, 2] = 0.0
    return np.stack([far * np.cos(angle), far * np.sin(angle)], axis=1), waves / np.linalg.norm(waves, axis=1)[:, None]


def error(degree: int, side: float, length: float) -> float:
    """Of waves of this many turns a unit."""
    at, waves = _trial()
    centre = np.array([0.0, 0.0, 1.0])
    wave = lambda p: np.exp(2j * math.pi * length * (directions(p, centre, side) @ waves.T))
    return float(np.abs(terms(at, degree) @ (solved(degree) @ wave(padua(degree))) - wave(at)).max())


def degree_for(side: float, length: float, points: int) -> tuple[int, float]:
    """The least degree for waves up to a length, with that length; or, if it would take more than so many points, the greatest
    degree allowed and the length that it reaches (0: none)."""
    last = 0
    for degree in range(2, MOST + 1):
        if count(degree) > points:
            break
        if error(degree, side, length) <= TOLERANCE:
            return degree, length
        last = degree
    low, high = 0.0, length
    for _ in range(12 if last else 0):
        half = (low + high) / 2
        low, high = (half, high) if error(last, side, half) <= TOLERANCE else (low, half)
    return last, low
