"""Sums of a tile's pairs in arrays, against plain complex exponentials of all its pixels."""

import math

import numpy as np
import pytest

from farside.functions import interpolation as P
from farside.operators import tilesums as T

BITS, SIDE, FREE = 10, 0.12, 2.12


def tile():
    """Pixels (l, m, n) of a square in the order of NESTED numbers."""
    k = np.arange(1 << BITS)
    x, y = (sum((k >> 2 * j + a & 1) << j for j in range(BITS // 2)) / 2 ** (BITS // 2) - 0.5 for a in (0, 1))
    at = np.stack([x * SIDE, y * SIDE, np.ones_like(x)], axis=1)
    return at / np.linalg.norm(at, axis=1)[:, None]


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("masked", [True, False])
def test_sums_of_a_tile(forward, masked):
    rng, at = np.random.default_rng(5), tile()
    u = rng.normal(size=(300, 3)) * np.where(np.arange(300) % 10 == 0, 60, 0.5)[:, None]  # some are too long for any cell
    tilt = rng.uniform(FREE - 0.1, FREE + 0.1, (2, 300))  # the rim passes through the tile
    turn = rng.uniform(0, 2 * math.pi, (2, 300))
    a, b = np.stack([np.sin(tilt) * np.cos(turn), np.sin(tilt) * np.sin(turn), np.cos(tilt)], axis=2)
    a[7] = np.nan  # no direction: sees nothing forward, is never hidden inversely
    side = 1.1 * SIDE / math.sqrt(2) / 2
    degree, reach = P.degree_for(side, 2.0, 128)
    plan = T.Plan(BITS, 2, {8: (degree, side, reach)}, FREE, forward, masked)
    length, z, bright = np.linalg.norm(u, axis=1), rng.normal(size=(300, 2)), rng.uniform(1, 2, len(at))
    angle = 2 * math.pi * (u @ (at - [0, 0, forward]).T)
    free = T.open_(plan, [a, b], at) if masked else np.ones((300, len(at)), bool)
    sure = np.full(300, 0 if masked else 3, np.int8)
    layers, pairs = set(), 0
    if forward:
        found = np.zeros((300, 3))
    else:
        found, values = np.zeros((len(at), 2)), {}
    for layer, shift, start, some, whole in T.down(plan, at, length, a, b, np.arange(300), sure, BITS):
        own = slice(start, start + (1 << shift))
        places = T.points(plan, at, layer, start) if layer else at[own]
        layers.add(layer)
        pairs += len(places) * len(some)
        if forward:
            terms = P.terms(P.projected(at[own], T.middle(at, layer, start), side), degree) if layer else None
            given = P.solved(degree).T @ (terms.T @ bright[own]) if layer else bright[own]
            T.seen_by(plan, u, length, a, b, places, given, some, whole, found, 1 << layer)
        elif layer:
            values[layer, start >> layer] = T.shone_on(plan, u, length, a, b, z, places, some, whole, False)
        else:
            found[own] += T.shone_on(plan, u, length, a, b, z, places, some, whole, False)
    if forward:
        want = (np.where(free, np.exp(-1j * angle), 0) * bright).sum(1)
        assert (found[:, 2] == free.sum(1)).all()
    else:
        found += T.filled(plan, at, 0, values, {})
        want = (np.where(free, np.exp(1j * angle), 0) * (z @ [1, 1j])[:, None]).sum(0)
    assert np.abs(found[:, 0] + 1j * found[:, 1] - want).max() < 1e-9
    assert layers == {0, 8} and pairs < 300 * len(at)
