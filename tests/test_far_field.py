"""Points that stand in for cells: the same sums as by pixels, from far fewer pairs."""

import math

import pytest
from pyspark.sql import functions as F

from farside import constants as C
from farside.functions import interpolation as P
from farside.operators import farfield as FF
from farside.operators import healpix as H
from farside.operators import imaging as I
from farside.operators import visibility as V
from farside.operators.sky import sky_lmn
from farside.plans.staging import stash
from farside.sources import fixtures

OBS = C.Observation(1e6)


def test_waves_between_points():
    degree, reach = P.degree_for(0.2, 1.5, 10_000)
    assert reach == 1.5 and P.error(degree, 0.2, 1.5) <= P.TOLERANCE and P.count(degree) < 400
    # too long for so few points: what they reach instead
    degree, reach = P.degree_for(0.2, 30.0, 200)
    assert P.count(degree) <= 200 and 0 < reach < 30 and P.error(degree, 0.2, reach) <= P.TOLERANCE


@pytest.mark.parametrize("masked", [True, False])
def test_points_give_the_sums_of_pixels(spark, monkeypatch, masked):
    """All kinds of baselines at nside 32: short, too long for any cell, without a direction, not finite."""
    nside = 32
    sky = lambda: stash(sky_lmn(H.pix2ang_nest(spark, nside).withColumn("b", 1000 + F.pmod(F.col("ipix") * 7919, F.lit(1009))), 12 * nside**2))
    half = fixtures.half(spark, "/root/testdata/sf0.01").where("bid < 24").withColumn("day", F.pmod("bid", F.lit(2)).cast("int"))
    long = {c: F.when(F.col("bid") == 5, 100 * F.col(c)).otherwise(F.col(c)) for c in ("u", "v", "w")}
    half = stash(half.withColumns(long | {c: F.when(F.col("bid") == 7, 0.0).otherwise(F.col(c)) for c in ("x1", "y1", "z1")}))
    full = stash(half.withColumns({"re": F.col("bid") + 0.5, "im": F.lit(1.5), "wt": F.lit(0.1)}))

    def values(sky):
        viss = {(r.day, r.bid): r for r in V.forward(half, sky, OBS, masked).collect()}
        return viss, {(r.day, r.ipix): r for r in I.image(full, sky, OBS, masked).collect()}

    near = values(sky())
    monkeypatch.setattr(FF, "LEAST_PIXELS", 1)
    monkeypatch.setattr(FF, "SLOT_ROWS", 3)
    seen = sky()
    far = values(seen)
    assert seen._far[1].points.count() > 0 and any(x.reach > 0.3 for x in seen._far[1].layers)
    for a, b, names in zip(near, far, (("re", "im"), ("c_re", "c_im"))):
        assert a.keys() == b.keys()
        assert all(math.isclose(a[k][n], b[k][n], abs_tol=1e-8) for k in a for n in names)
    assert all(near[0][k].n_visible == far[0][k].n_visible for k in near[0])
    # a row that is not finite is not spread over cells beyond its own sums
    odd = full.withColumn("re", F.when(F.col("bid") == 3, float("nan")).otherwise(F.col("re")))
    got = {(r.day, r.ipix): r.c_re for r in I.image(odd, seen, OBS, masked).collect()}
    monkeypatch.setattr(FF, "LEAST_PIXELS", 10**9)
    want = {(r.day, r.ipix): r.c_re for r in I.image(odd, seen, OBS, masked).collect()}
    assert got.keys() == want.keys() and all(math.isnan(got[k]) == math.isnan(want[k]) for k in want)


def test_pairs_grow_with_the_rim(spark):
    """A sky of four times the pixels takes much less than four times the pairs, and none but points without a mask."""
    made = []
    for nside in (64, 128):
        sky = stash(sky_lmn(H.pix2ang_nest(spark, nside).withColumn("b", F.lit(1.0)), 12 * nside**2))
        half = stash(V._half(fixtures.half(spark, "/root/testdata/sf0.01").where("bid < 6")).withColumn("length", FF.length()))
        far = FF.layered(sky, 12 * nside**2, nside, OBS, 1.5)
        pairs = lambda masked: [t.count() for t in FF.met(half, far, far.points, 12 * nside**2, False, masked, 1, F.lit(0), ["id", "l", "m", "n"])]  # noqa: E731, B023
        made.append((sum(pairs(True)), sum(pairs(False))))
    assert made[1][0] < 2.2 * made[0][0] and made[1][0] < 0.6 * 6 * 12 * 128**2 and made[1][1] < 0.2 * 6 * 12 * 128**2
