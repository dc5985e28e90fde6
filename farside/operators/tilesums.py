"""What a task sums once its tile and its part of the baselines have come together (farfield.py): arrays of one tile only.

Baselines go down the cells of the tile as they do the layers above it: a cell that the Moon hides ends them, one that is wholly
seen and within their reach is met by its points, and at the rim they come down to the pixels of blocks. The phase of a cell's
centre is taken out for each baseline, so what is left for each pair is small and a short power series gives its wave.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from ..functions import interpolation as P
from .mask import BLOCK_BITS, MARGIN

#: Pairs that are worked on at once; greatest phases of each power series, with its terms.
PAIRS, PHASES = 32_768, ((0.08, 4), (0.25, 5), (1.0, 9))


@dataclass(frozen=True)
class Plan:
    """Of all tiles: bits of a tile and between layers, (degree, side, reach) of layers that points stand for, the free angle."""

    tile: int
    step: int
    spec: dict[int, tuple[int, float, float]]
    free: float
    forward: bool
    masked: bool


def waves(rows: np.ndarray, length: np.ndarray, at: np.ndarray, centre: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in rows, cosines, sines) of the turns rows (k, 3) make from the centre to directions (m, 3). How a row's are
    worked out depends on itself alone."""
    off = np.ascontiguousarray((at - centre).T) * (2 * math.pi)
    most = length * (np.sqrt((off * off).sum(0)).max() if len(at) else 0.0)
    bounds = [0.0, *(b for b, _ in PHASES), math.inf]
    for low, high, (_, n) in zip(bounds, bounds[1:], (*PHASES, (0, 0))):
        some = np.flatnonzero((most <= high) & ((most > low) | (low == 0))) if n else np.flatnonzero(~(most <= low))
        for k in range(0, len(some), chunk := max(1, PAIRS // max(1, len(at)))):
            own = some[k : k + chunk]
            x = _product(rows[own], off)
            yield own, *(_series(x, n) if n else (np.cos(x), np.sin(x)))


def _series(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosine and sine by n + 1 and n terms."""
    square, of = x * x, [(-1) ** (k // 2) / math.factorial(k) for k in range(2 * n + 1)]
    c, s = square * of[2 * n], square * of[2 * n - 1]
    for k in range(n - 1, 0, -1):
        c += of[2 * k]
        c *= square
        if k > 1:
            s += of[2 * k - 1]
            s *= square
    c += 1.0
    s += 1.0
    s *= x
    return c, s


def _product(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(k, m) of rows (k, 3) and columns (3, m), each added up in the same order."""
    x = rows[:, :1] * at[0]
    y = rows[:, 1:2] * at[1]
    x += y
    np.multiply(rows[:, 2:], at[2], out=y)
    x += y
    return x


def open_(plan: Plan, directions: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Places that the Moon leaves free for the satellites given; undefined angles are as in visibility.seen() and hidden()."""
    least, out, at = math.cos(plan.free), None, np.ascontiguousarray(at.T)
    for x in directions:
        cosine = _product(x, at)
        one = (cosine >= least) & (cosine <= 1.0) if plan.forward else ~((cosine < least) & (cosine >= -1.0))
        out = one if out is None else out & one
    return out


def _tested(a: np.ndarray, b: np.ndarray, some: np.ndarray, sure: int) -> list[np.ndarray]:
    return [x[some] for bit, x in ((1, a), (2, b)) if not sure & bit]


def sift(plan: Plan, a: np.ndarray, b: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a cell is hidden from baselines, and which satellites (1, 2 or 3) see it wholly, by its cone as in mask.py."""
    centre = own.mean(0)
    centre /= math.sqrt(centre @ centre)
    wide = float(np.arccos(np.clip(own @ centre, -1.0, 1.0)).max()) + MARGIN
    free = plan.free
    least = math.cos(free - wide) if wide < free else 2.0
    none = math.cos(wide + free) if wide + free < math.pi else -2.0
    near = math.cos(wide) if wide < math.pi else -2.0
    hidden, whole = np.zeros(len(a), bool), np.zeros(len(a), np.int8)
    for bit, x in ((1, a), (2, b)):
        cosine = x[:, 0] * centre[0] + x[:, 1] * centre[1] + x[:, 2] * centre[2]
        if plan.forward:
            hidden |= (cosine < none) | np.isnan(cosine)
            whole |= bit * ((cosine >= least) & (cosine < near))
        else:
            hidden |= (cosine < none) & (cosine > -near)
            whole |= bit * ((cosine >= least) | np.isnan(cosine))
    return hidden, whole


def middle(pixels: np.ndarray, shift: int, start: int) -> np.ndarray:
    """The direction that a cell's points lie about."""
    return pixels[start + (3 << (shift - 2))]


def down(plan: Plan, pixels: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray, some: np.ndarray, sure: np.ndarray, shift: int, start: int = 0, top: bool = True) -> Iterator:
    """(layer, shift, start, rows, sure) of what rows meet in a tile's cell: its points, or (layer 0) the pixels of a block. sure:
    bits of the satellites that see all of it, by now."""
    if not top:
        if plan.masked:
            hidden, whole = sift(plan, a[some], b[some], pixels[start : start + (1 << shift)])
            left = (sure == 3) | ~hidden
            some, sure = some[left], (sure | whole)[left]
        if shift in plan.spec:
            taken = (sure == 3) & (length[some] <= plan.spec[shift][2])
            if taken.any():
                yield shift, shift, start, some[taken], 3
                some, sure = some[~taken], sure[~taken]
    if not len(some):
        return
    if shift <= BLOCK_BITS:
        for kind in range(4):
            if len(own := some[sure == kind]):
                yield 0, shift, start, own, kind
        return
    step = min(plan.step, shift - BLOCK_BITS)
    for k in range(1 << step):
        yield from down(plan, pixels, length, a, b, some, sure, shift - step, start + (k << (shift - step)), False)


def seen_by(plan: Plan, rows: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray, at: np.ndarray, bright: np.ndarray, some: np.ndarray, sure: int, out: np.ndarray, each: int = 1) -> None:
    """Adds to out (rows, 3) the sums of brightness times waves over directions, and how many of them are seen. each: pixels
    that all the directions stand for, where these are points."""
    centre = at[len(at) // 2]
    u, found = rows[some], np.zeros((len(some), 3))
    for own, c, s in waves(u, length[some], at, centre):
        if sure == 3:
            found[own, 0], found[own, 1], found[own, 2] = np.einsum("ij,j->i", c, bright), -np.einsum("ij,j->i", s, bright), each if each > 1 else len(at)
        else:
            free = open_(plan, _tested(a, b, some[own], sure), at)
            given = free * bright
            n = np.count_nonzero(free, axis=1)
            # a row that sees none of them has no sum, whatever its waves are
            found[own, 0], found[own, 1] = np.where(n, np.einsum("ij,ij->i", c, given), 0.0), np.where(n, -np.einsum("ij,ij->i", s, given), 0.0)
            found[own, 2] = n
    turn = 2 * math.pi * (u[:, 0] * centre[0] + u[:, 1] * centre[1] + u[:, 2] * (centre[2] - 1))
    c, s = np.cos(turn), np.sin(turn)
    re, im = found[:, 0] * c + found[:, 1] * s, found[:, 1] * c - found[:, 0] * s
    none = found[:, 2] == 0
    out[some] += np.stack([np.where(none, 0.0, re), np.where(none, 0.0, im), found[:, 2]], axis=1)


def shone_on(plan: Plan, rows: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray, z: np.ndarray, at: np.ndarray, some: np.ndarray, sure: int, hermitian: bool) -> np.ndarray:
    """(directions, 2): sums over baselines of their values z (rows, 2) times waves. hermitian: without imaginary parts."""
    centre, out = at[len(at) // 2], np.zeros((2, len(at)))
    u = rows[some]
    turn = 2 * math.pi * (u[:, 0] * centre[0] + u[:, 1] * centre[1] + u[:, 2] * centre[2])
    c, s = np.cos(turn), np.sin(turn)
    re, im = z[some, 0] * c - z[some, 1] * s, z[some, 0] * s + z[some, 1] * c
    odd = ~(np.isfinite(re) & np.isfinite(im))
    for own, c, s in waves(u, length[some], at, centre):
        free = None if sure == 3 else open_(plan, _tested(a, b, some[own], sure), at)
        if odd[own].any():  # what is not finite stays out of what is hidden
            free = np.ones_like(c, dtype=bool) if free is None else free
            x, y = re[own, None], im[own, None]
            out[0] += np.where(free, x * c - y * s, 0.0).sum(0)
            if not hermitian:
                out[1] += np.where(free, x * s + y * c, 0.0).sum(0)
            continue
        if free is not None:
            c *= free
            s *= free
        out[0] += re[own] @ c - im[own] @ s
        if not hermitian:
            out[1] += re[own] @ s + im[own] @ c
    return out.T


def filled(plan: Plan, pixels: np.ndarray, tile: int, values: dict[tuple[int, int], np.ndarray], centres: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """(pixels, k) of a tile: what lies between values (points, k) of cells (layer, cell), which are passed on to the points of
    the next layer that reaches as far, and from the last to the pixels. centres: of the cells that are not smaller than the tile."""
    columns = next((v.shape[1] for v in values.values()), 2)
    out = np.zeros((len(pixels), columns))
    for layer in sorted(plan.spec, reverse=True):
        degree, side, reach = plan.spec[layer]
        least = max(0, plan.tile - layer)
        for cell in sorted(c for at, c in values if at == layer):
            start = (cell - (tile << least) << layer) if layer < plan.tile else 0
            some = slice(start, start + (1 << min(layer, plan.tile)))
            centre = centres[layer, cell] if layer >= plan.tile else middle(pixels, layer, start)
            factors = P.solved(degree) @ values[layer, cell]
            inner = next((x for x in sorted(plan.spec, reverse=True) if x < min(layer, plan.tile + 1) and plan.spec[x][2] >= reach), None)
            if inner is None:
                out[some] += P.terms(P.projected(pixels[some], centre, side), degree) @ factors
                continue
            starts = range(some.start, some.stop, 1 << inner)
            at = np.concatenate([points(plan, pixels, inner, k) for k in starts])
            passed = (P.terms(P.projected(at, centre, side), degree) @ factors).reshape(len(starts), -1, columns)
            for k, new in zip(starts, passed):
                key = inner, (tile << plan.tile - inner) + (k >> inner)
                values[key] = values[key] + new if key in values else new
    return out


def points(plan: Plan, pixels: np.ndarray, layer: int, start: int) -> np.ndarray:
    degree, side, _ = plan.spec[layer]
    return P.directions(P.padua(degree), middle(pixels, layer, start), side)
