"""Invariants, edge rows and larger-than-broadcast plans of the imaging chain."""

import math
import random

import pytest
from pyspark.sql import functions as F

from farside import constants as C
from farside.functions import complex as X
from farside.operators import baselines as B
from farside.operators import healpix as H
from farside.operators import imaging as I
from farside.operators import mask as M
from farside.operators import visibility as V
from farside.operators import weights as W
from farside.operators.sky import sky_lmn
from farside.plans.staging import discard, stash
from farside.sources import fixtures
from farside.sources import rasters as R

OBS = C.Observation(1e6)


def test_constants():
    assert OBS.shells == 667 and C.Observation(1e7).shells == 6667
    assert OBS.wavelength == 300 and C.Observation(1e7).wavelength == 30
    assert math.isclose(OBS.open_angle, 2.120400, abs_tol=1e-6)
    assert C.npix_to_nside(C.nside_to_npix(512)) == 512
    with pytest.raises(ValueError):
        C.npix_to_nside(13)
    assert fixtures.nside_for(200) == 4 and fixtures.nside_for(768) == 8


@pytest.mark.parametrize("nside", [1, 2, 4, 8])
def test_healpix_invariants(spark, nside):
    df = H.indexed(spark, nside).toPandas()
    assert len(df) == 12 * nside**2 and not df.duplicated(["jr", "jp"]).any()
    assert df.jr.between(1, 4 * nside - 1).all() and (df.groupby("face").size() == nside**2).all()
    angles = H.pix2ang_nest(spark, nside).toPandas()
    x, y, z = angles.theta.map(math.sin) * angles.phi.map(math.cos), angles.theta.map(math.sin) * angles.phi.map(math.sin), angles.theta.map(math.cos)
    assert all(abs(v.mean()) < 1e-12 for v in (x, y, z)) and angles.phi.between(0, 2 * math.pi).all()


@pytest.mark.parametrize("nside", [1, 2, 4, 8, 16, 32, 64])
def test_angles_find_their_pixel(spark, nside):
    found = H.ang2pix_nest(H.pix2ang_nest(spark, nside).withColumnRenamed("ipix", "known"), nside)
    assert found.count() == 12 * nside**2 and found.where("known <> ipix").isEmpty()


def test_directions_fall_to_the_nearest_centre_of_their_ring_region(spark):
    """Any direction's pixel has a centre within a pixel's greatest radius, and poles and the seam have one too."""
    nside = 8
    rng = random.Random(2)
    rows = [(math.acos(rng.uniform(-1, 1)), rng.uniform(0, 2 * math.pi)) for _ in range(4000)] + [(0.0, 1.0), (math.pi, 6.0), (1.0, 0.0), (1.5, 2 * math.pi), (2.9, 2 * math.pi - 1e-12)]
    df = spark.createDataFrame(rows, "theta double, phi double")
    centres = H.pix2ang_nest(spark, nside).toDF("ipix", "theta0", "phi0")
    away = F.acos(F.least(F.lit(1.0), F.cos("theta") * F.cos("theta0") + F.sin("theta") * F.sin("theta0") * F.cos(F.col("phi") - F.col("phi0"))))
    found = H.ang2pix_nest(df, nside).join(centres, "ipix").select(F.count("*"), F.max(away)).first()
    assert found[0] == len(rows) and found[1] < 1.4 * math.sqrt(4 * math.pi / (12 * nside**2))


def test_mollweide_view(spark):
    """All pixels of a coarse map are in view with about their area, the middle row is the equator, longitude grows leftwards."""
    nside, width, height = 4, 400, 200
    values = H.pix2ang_nest(spark, nside).withColumn("c", F.col("ipix") + 0.0)
    out = R.mollweide(values, nside, "c", width, height).toPandas()
    inside = math.pi / 4 * width * height
    assert abs(len(out) - inside) < 0.01 * inside and not out.duplicated(["row", "col"]).any() and out.c.notna().all()
    assert out.groupby("c").size().between(0.8 * inside / 192, 1.2 * inside / 192).all() and out.c.nunique() == 192
    at = out.set_index(["row", "col"]).c
    theta, phi = (values.toPandas().set_index("c")[k] for k in ("theta", "phi"))
    assert phi[at[100, 100]] > 0.5 and phi[at[100, 100]] < math.pi and phi[at[100, 300]] > math.pi and theta[at[3, 200]] < 0.5
    assert R.mollweide(values.where("ipix < 5"), nside, "c", 80, 40).where("c is null").count() > 2000
    with pytest.raises(ValueError):
        R.mollweide_pixels(spark, 1, 10_000, 10_000)


def test_nside_must_be_a_power_of_two(spark):
    with pytest.raises(ValueError):
        H.pixels(spark, 3)


def test_shell_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (0.75,), (0.7500001,)], "bll double")
    assert [r[0] for r in df.select(W.shell_of(F.col("bll"))).collect()] == [0, 0, 1, 2]


def baseline(spark, rows):
    return spark.createDataFrame([(1, k, *map(float, r)) for k, r in enumerate(rows)], "day int, bid long, u double, v double, w double, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, bll double")


def test_weight_edges(spark):
    up = (0, 0, 1, 0, 0, 1)
    rows = [(0, 0, 0, *up, 0), (0, 0, 5, *up, 5), (0, 8.6602540378, 5, *up, 10)]
    got = {r.bid: r.wt for r in W.weighted(W.with_shell(baseline(spark, rows)), OBS).collect()}
    assert got[0] == 0.125 and got[1] == 0.125 and got[2] < 1e-3
    beyond = W.weighted(W.with_shell(baseline(spark, [(0, 400, 0, *up, 400)])), OBS).collect()
    assert beyond[0].wt == 0.125


@pytest.fixture(scope="module")
def small_sky(spark):
    angles = H.pix2ang_nest(spark, 2).withColumn("b", F.lit(1.0))
    return stash(sky_lmn(angles, 48))


def test_masks_and_undefined_angles(spark, small_sky):
    rows = [(0, 0, 0, 0, 0, 0, 0, 0, 1, 1), (0, 0, 0, 0, 0, 1, 0, 0, -1, 1), (0, 0, 0, 0, 0, 1, 0, 0, 1, 1)]
    got = {r.bid: r for r in V.forward(baseline(spark, rows), small_sky, OBS).collect()}
    # a zero vector has no angle: nothing is seen forward, and nothing is hidden in the image
    assert got[0].n_visible == 0 and got[0].re == 0.0
    assert 0 < got[1].n_visible < got[2].n_visible < 48
    flat = baseline(spark, [(0,) * 9 + (1,)]).withColumns({"re": F.lit(1.0), "im": F.lit(0.0), "wt": F.lit(0.1)})
    assert all(math.isclose(r.c_re, 0.1) for r in I.image(flat, small_sky, OBS, masked=True).collect())


def test_point_source_and_mirror(spark, small_sky):
    up = (0, 0, 1, 0, 0, 1)
    half = baseline(spark, [(3, 1, 2, *up, math.sqrt(14)), (0.5, -2, 1, *up, math.sqrt(5.25))])
    point = stash(small_sky.withColumn("b", F.when(F.col("ipix") == 7, 2.0).otherwise(0.0)))
    viss = stash(V.forward(half, point, OBS, masked=False))
    assert all(math.isclose(math.hypot(r.re, r.im), 2.0) for r in viss.collect())
    both = V.rephased(B.mirrored(viss.join(half, ["day", "bid"]))).withColumn("wt", F.lit(1.0))
    whole = {r.ipix: r for r in I.image(both, point, OBS, masked=False).collect()}
    assert all(abs(r.c_im) < 1e-9 for r in whole.values())
    one = I.image(both.where("sgn = 1"), point, OBS, masked=False, hermitian=True).collect()
    assert all(math.isclose(r.c_re, whole[r.ipix].c_re, abs_tol=1e-9) for r in one)
    assert math.isclose(whole[7].c_re, 8.0)


def test_hidden_days_are_dark_not_missing(spark, small_sky):
    rows = baseline(spark, [(0, 0, 0, 0, 0, 1, 0, 0, -1, 1)]).withColumns({"re": F.lit(1.0), "im": F.lit(0.0), "wt": F.lit(0.1)})
    assert I.image(rows, small_sky, OBS, masked=True).count() == 48


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tiles_beyond_the_broadcast_bound(spark, small_sky, monkeypatch):
    """Keyed tiles give the same rows, and each side is sent once for each tile, or part, that it meets."""
    half = baseline(spark, [(k, 1, 2, 0, 0, 1, 0, k % 5 - 2, 1, 3) for k in range(20)]).withColumn("day", (F.col("bid") % 2).cast("int"))
    full = half.withColumns({"re": F.col("bid") + 0.5, "im": F.lit(1.5), "wt": F.lit(0.1)})
    values = lambda: ({(r.day, r.bid): r for r in V.forward(half, small_sky, OBS).collect()}, {(r.day, r.ipix): r for r in I.image(full, small_sky, OBS, masked=True).collect()})
    near = values()
    monkeypatch.setattr(V, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(V, "BLOCK_ROWS", 7)
    for plan in (plan_of(V.forward(half, small_sky, OBS)), plan_of(I.image(full, small_sky, OBS, masked=True))):
        assert "ShuffledHashJoin" in plan and "CartesianProduct" not in plan
    assert values() == near  # the same bits
    tree = M.quadtree(small_sky, 2, OBS)
    rows = stash(V._half(half))
    seen = M.descend(rows, tree.levels, True).count()
    assert seen < 20 * 48 and V.met(rows, 20, tree, 48, True, True, ("bid",)).count() <= seen  # a baseline once for each tile
    assert tree.blocks.count() * 3 == 48 * 3  # and a tile once for each of three parts


@pytest.mark.parametrize("nside", [4, 32, 64, 128])
def test_quadtree_holds_the_mask(spark, nside):
    """What goes down to pixels is what is seen and the rim; nothing seen is missed, nothing sure is hidden."""
    angles = H.pix2ang_nest(spark, nside).withColumn("b", F.lit(1.0))
    sky = stash(sky_lmn(angles, C.nside_to_npix(nside)))
    tree = M.quadtree(sky, nside, OBS)
    rng = random.Random(nside)
    rows = [(0, 0, 0, *(rng.gauss(0, 1) for _ in range(6)), 1) for _ in range(3)] + [(0, 0, 0, 0, 0, 0, 0, 0, 1, 1)]
    half = stash(V._half(baseline(spark, rows)))
    all_ = half.crossJoin(F.broadcast(sky))
    share = all_.where(V.seen(OBS)).groupBy("bid").count().toPandas().set_index("bid")["count"].to_dict()
    found = stash(M.pixels_of(V.met(half, 4, tree, 12 * nside**2, True, True, ("bid",))))
    made = found.groupBy("bid").agg(F.count("*").alias("n"), F.sum(F.when(F.col("sure"), 1).otherwise(0)).alias("sure"), F.sum(F.when(V.seen(OBS), 1).otherwise(0)).alias("seen"), F.sum(F.when(F.col("sure") & ~V.seen(OBS), 1).otherwise(0)).alias("wrong")).toPandas().set_index("bid")
    assert made.wrong.sum() == 0 and made.seen.to_dict() == share and 3 not in made.index
    if nside >= 32:
        # the two rims have length 4 pi sin(phi); blocks they touch reach at most two block widths to either side
        width = math.sqrt(4 * math.pi / tree.blocks.count())
        rim = 12 * nside**2 * min(1, 2 * 2 * math.pi * math.sin(OBS.open_angle) * 4 * width / (4 * math.pi))
        assert all(made.n[k] <= share[k] + rim for k in share) and made.n.max() < 12 * nside**2
    counts = {r.bid: r.n_visible for r in V.visible_counts(baseline(spark, rows), sky, OBS).collect()}
    assert counts == {k: share.get(k, 0) for k in range(4)}
    # inversely: nothing that is not hidden is missed
    kept = M.pixels_of(V.met(half, 4, tree, 12 * nside**2, False, True, ("bid",)))
    assert kept.where(F.col("sure") & V.hidden(OBS)).isEmpty()
    assert kept.where(~V.hidden(OBS)).count() == all_.where(~V.hidden(OBS)).count()


def test_large_skies_descend(spark):
    """At nside 512 five levels lie between cells and pixels: few tests settle a satellite's three million pixels."""
    angles = H.pix2ang_nest(spark, 512)
    sky = stash(sky_lmn(angles.withColumn("b", F.lit(1.0)), C.nside_to_npix(512)))
    tree = M.quadtree(sky, 512, OBS)
    half = stash(V._half(baseline(spark, [(0, 0, 0, 1, 2, 3, 3, -1, 2, 1)])))
    blocks = stash(V.met(half, 1, tree, 1, True, True, ("bid",)).select("sure", "size"))
    seen = sky.crossJoin(F.broadcast(half)).where(V.seen(OBS)).count()
    sure, mixed = (blocks.where(c).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] for c in ("sure", "not sure"))
    assert len(tree.levels) >= 1 and sure <= seen <= sure + mixed and mixed < 0.05 * 3145728


def test_sums_do_not_depend_on_partitions(spark, sf_dir):
    found = []
    for parts in (2, 8):
        half, sky = fixtures.half(spark, sf_dir).repartition(parts), stash(fixtures.sky(spark, sf_dir)[0].repartition(parts))
        viss = stash(V.forward(half, sky, OBS))
        full = viss.join(half, ["day", "bid"]).withColumn("wt", F.lit(0.1)).repartition(parts)
        found.append((sorted(map(tuple, viss.collect())), sorted(map(tuple, I.image(full, sky, OBS, masked=True).collect()))))
    assert found[0] == found[1]
    # not finite: as it is
    bad = stash(sky.withColumn("b", F.when(F.col("ipix") == 5, float("inf")).otherwise(F.col("b"))))
    assert any(not math.isfinite(r.re) for r in V.forward(half, bad, OBS).collect())


def test_total_takes_nan_as_zero(spark):
    df = spark.createDataFrame([(1, 0, float("nan")), (2, 0, 2.0), (1, 1, 1.0)], "day int, ipix long, c_re double")
    assert {r.ipix: r.c for r in I.total(df).collect()} == {0: 2.0, 1: 1.0}


def test_odd_half_and_unequal_files(spark):
    df = spark.createDataFrame([(1, k, float(k)) for k in range(5)], "day int, rn long, u double")
    assert sorted(r.bid for r in B.first_half(df).collect()) == [0, 1]
    three = lambda n: spark.createDataFrame([(1, k, 0.0, 0.0, 0.0) for k in range(n)], "day int, rn long, u double, v double, w double")
    one = spark.createDataFrame([(1, k, 0.0) for k in range(3)], "day int, rn long, bll double")
    assert B.zipped(three(3), three(3), three(3), one).count() == 3
    with pytest.raises(Exception, match="unequal lengths"):
        B.zipped(three(3), three(2), three(3), one).collect()


def test_complex(spark):
    a, b = (F.lit(1.0), F.lit(2.0)), (F.lit(3.0), F.lit(-1.0))
    row = spark.range(1).select(*X.cmul(a, b), *X.conj(a), X.cabs(b), *X.cexp((F.lit(0.0), F.lit(math.pi)))).first()
    assert tuple(row)[:4] == (5.0, 5.0, 1.0, -2.0) and math.isclose(row[4], math.sqrt(10)) and math.isclose(row[5], -1.0)


def test_stash_and_discard(spark):
    df = stash(spark.range(3))
    assert df.count() == 3
    discard(df)
    with pytest.raises(Exception):
        spark.read.parquet(df._stash_path)


def test_all_shells_are_sorted(spark, sf_dir):
    from farside.plans import queries

    out = [tuple(r) for r in queries.shell_sorted_all(spark, sf_dir).collect()]
    assert len(out) == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count() and out == sorted(out)
