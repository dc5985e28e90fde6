"""Baselines as one polynomial: the same sums as of all pairs, from sums that don't grow with the baselines."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from farside import constants as C
from farside.functions import moments as M
from farside.operators import farfield as FF
from farside.operators import healpix as H
from farside.operators import imaging as I
from farside.operators.sky import sky_lmn
from farside.plans.staging import stash
from farside.sources import fixtures


@pytest.mark.parametrize("length", [0.1, 1.5, 3.0])
def test_moments_give_the_sums_of_waves(length):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(1500, 3))
    rows *= (length * rng.uniform(0, 1, 1500) / np.linalg.norm(rows, axis=1))[:, None]
    rows[:8] = np.concatenate([np.eye(3), -np.eye(3), [[0, 0, 0], [1 / math.sqrt(3)] * 3]]) * length
    at = np.concatenate([np.eye(3), rng.normal(size=(200, 3)), [[1.0, 1.0, 1.0]]])
    at /= np.linalg.norm(at, axis=1)[:, None]
    degree, z = M.degree_for(length), rng.normal(size=(1500, 2))
    sums = M.moments(rows, z, length, degree)
    assert sums.shape == (M.count(degree), 2)
    want = np.exp(2j * math.pi * (at @ rows.T)) @ (z @ [1, 1j])
    assert np.abs(M.values(sums, at, length, degree) @ [1, 1j] - want).max() < M.TOLERANCE * np.hypot(*z.T).sum()
    one = M.values(M.moments(rows[:1], np.array([[1.0, 0.0]]), length, degree), at, length, degree) @ [1, 1j]
    assert np.abs(one - np.exp(2j * math.pi * (at @ rows[0]))).max() < M.TOLERANCE


def test_images_without_a_mask_need_no_pairs(spark, monkeypatch):
    """At nside 64, days of more than one lot: no baseline meets a cell's points, and pixels have the sums of all baselines."""
    monkeypatch.setattr(FF, "coarse", lambda *_: pytest.fail("baselines meet cells"))
    monkeypatch.setattr(FF, "DAYS", 2)
    nside = 64
    half = fixtures.half(spark, "/root/testdata/sf0.01").where("bid < 60").withColumn("day", F.pmod("bid", F.lit(3)).cast("int") * 5)
    full = stash(half.withColumns({"re": F.col("bid") + 0.5, "im": F.lit(1.5), "wt": F.lit(0.1)}))
    sky = stash(sky_lmn(H.pix2ang_nest(spark, nside).withColumn("b", F.lit(1.0)), 12 * nside**2))
    found = I.image(full, sky, C.Observation(1e6), False).toPandas().sort_values(["day", "ipix"])
    at, rows = sky.toPandas().sort_values("ipix")[["l", "m", "n"]].to_numpy(), full.toPandas()
    assert len(found) == 3 * 12 * nside**2
    for day, own in rows.groupby("day"):
        want = np.exp(2j * math.pi * (at @ own[["u", "v", "w"]].to_numpy().T)) @ (own.wt * (own.re + 1j * own.im)).to_numpy()
        got = found[found.day == day]
        assert np.abs(got.c_re.to_numpy() + 1j * got.c_im.to_numpy() - want).max() < 1e-10
