"""Queries of the imaging chain over a directory of tables."""

from __future__ import annotations

import functools
import math
import operator
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import Observation, nside_to_npix, pixel_area, resolution_degrees, settings
from ..functions.complex import cabs, norm3
from ..operators import baselines as B
from ..operators import healpix as H
from ..operators import imaging as I
from ..operators import visibility as V
from ..operators import weights as W
from ..sources import fixtures, rasters, text
from . import job
from .staging import checkpoint_dir, stash

OBSERVATION, OBSERVATION_10MHZ = Observation(1e6), Observation(1e7)


def _r(name: str, places: int = 4):
    return F.round(F.col(name), places).alias(name)


def pix_face(spark: SparkSession, sf: str) -> DataFrame:
    n = fixtures.nside_of(spark, sf)
    return H.with_face(H.pixels(spark, n), n).select("ipix", "face", "ipf")


def pix_xy(spark: SparkSession, sf: str) -> DataFrame:
    n = fixtures.nside_of(spark, sf)
    return H.with_xy(H.with_face(H.pixels(spark, n), n), n).select("ipix", "ix", "iy")


def pix_ring(spark: SparkSession, sf: str) -> DataFrame:
    return H.indexed(spark, fixtures.nside_of(spark, sf)).select("ipix", "jr", "nr", "kshift")


def pix_jp(spark: SparkSession, sf: str) -> DataFrame:
    return H.indexed(spark, fixtures.nside_of(spark, sf)).select("ipix", "jp")


def pix_region_counts(spark: SparkSession, sf: str) -> DataFrame:
    return H.indexed(spark, fixtures.nside_of(spark, sf)).groupBy("region").agg(F.count("*").alias("n"))


def pix2ang(spark: SparkSession, sf: str) -> DataFrame:
    return H.pix2ang_nest(spark, fixtures.nside_of(spark, sf)).select("ipix", _r("theta", 6), _r("phi", 6))


def pix_resolution(spark: SparkSession, sf: str) -> DataFrame:
    n = fixtures.nside_of(spark, sf)
    npix = nside_to_npix(n)
    return spark.range(1).select(F.lit(n).cast("long").alias("nside"), F.lit(npix).cast("long").alias("npix"), F.round(F.lit(resolution_degrees(n)), 6).alias("degrees"), F.round(F.lit(pixel_area(npix)), 9).alias("area"))


def sky_lmn(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.sky(spark, sf)[0].select("ipix", _r("b"), _r("l", 6), _r("m", 6), _r("n", 6))


def satellite_norm(spark: SparkSession, sf: str) -> DataFrame:
    norms = [F.round(norm3(*(F.col(a + k) for a in "xyz")), 6).alias(f"norm{k}") for k in "12"]
    return fixtures.half(spark, sf).select("day", "bid", *norms)


def baseline_mirror(spark: SparkSession, sf: str) -> DataFrame:
    return B.mirrored(fixtures.half(spark, sf)).select("day", "bid", "sgn", *(_r(c, 6) for c in ("u", "v", "w", "bll")))


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    rn = (F.row_number().over(Window.partitionBy("day").orderBy("bid")) - 1).cast("long")
    return fixtures.half(spark, sf).withColumn("rn", rn)


def baseline_zip(spark: SparkSession, sf: str) -> DataFrame:
    rows = stash(_numbered(spark, sf))
    part = lambda *c: rows.select("day", "rn", *c)
    out = B.zipped(part("u", "v", "w"), part("x1", "y1", "z1"), part("x2", "y2", "z2"), part("bll"))
    return out.select("day", "rn", *(_r(c, 6) for c in out.columns[2:]))


def baseline_half(spark: SparkSession, sf: str) -> DataFrame:
    return B.first_half(_numbered(spark, sf).drop("bid")).select("day", F.col("bid").alias("rn"), _r("bll", 6))


def _shells(spark: SparkSession, sf: str) -> DataFrame:
    return W.with_shell(B.mirrored(fixtures.half(spark, sf)))


def shell_id(spark: SparkSession, sf: str) -> DataFrame:
    return W.with_shell(fixtures.half(spark, sf)).select("day", "bid", "g")


def shell_hist(spark: SparkSession, sf: str) -> DataFrame:
    return W.shell_histogram(_shells(spark, sf), OBSERVATION)


def shell_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return W.with_shell(fixtures.half(spark, sf)).select("day", "g", "bid").orderBy("day", "g", "bid").limit(100)


def shell_sorted_all(spark: SparkSession, sf: str) -> DataFrame:
    """All baselines in the order of their shells."""
    return W.with_shell(fixtures.half(spark, sf)).select("day", "g", "bid").orderBy("day", "g", "bid")


def shell_dcf(spark: SparkSession, sf: str) -> DataFrame:
    return W.shell_density(shell_hist(spark, sf)).select("day", "g", _r("dcf", 6))


def shell_dcf_shifted(spark: SparkSession, sf: str) -> DataFrame:
    return W.shell_density(shell_hist(spark, sf), 1).select("day", "g", _r("dcf", 6))


def incl_gain(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.half(spark, sf).select("day", "bid", F.round(W.gain(), 4).alias("dg"))


def weight(spark: SparkSession, sf: str) -> DataFrame:
    return W.weighted(_shells(spark, sf), OBSERVATION).select("day", "bid", "sgn", _r("wt", 6))


def weight_shifted(spark: SparkSession, sf: str) -> DataFrame:
    return W.weighted(_shells(spark, sf), OBSERVATION, 1).select("day", "bid", "sgn", _r("wt", 6))


def _viss(spark: SparkSession, sf: str, masked: bool = True) -> DataFrame:
    return V.forward(fixtures.half(spark, sf), fixtures.sky(spark, sf)[0], OBSERVATION, masked)


def vis_mask_count(spark: SparkSession, sf: str) -> DataFrame:
    return V.visible_counts(fixtures.half(spark, sf), fixtures.sky(spark, sf)[0], OBSERVATION)


def vis_forward(spark: SparkSession, sf: str) -> DataFrame:
    return _viss(spark, sf).select("day", "bid", _r("re"), _r("im"))


def vis_amplitude(spark: SparkSession, sf: str) -> DataFrame:
    return _viss(spark, sf).select("day", "bid", F.round(cabs((F.col("re"), F.col("im"))), 4).alias("amp"))


def _half_viss(spark: SparkSession, sf: str) -> DataFrame:
    half = fixtures.half(spark, sf)
    return stash(V.forward(half, fixtures.sky(spark, sf)[0], OBSERVATION).drop("n_visible")).join(half, ["day", "bid"])


def vis_rephased(spark: SparkSession, sf: str) -> DataFrame:
    return V.rephased(B.mirrored(_half_viss(spark, sf))).select("day", "bid", "sgn", _r("re"), _r("im"))


def preview_vis(spark: SparkSession, sf: str) -> DataFrame:
    """The first three of every day: chosen before they meet the sky."""
    first = F.row_number().over(Window.partitionBy("day").orderBy("bid"))
    half = fixtures.half(spark, sf).withColumn("k", first).where("k <= 3").drop("k")
    return V.forward(half, fixtures.sky(spark, sf)[0], OBSERVATION).select("day", "bid", _r("re"), _r("im"))


def point_source(spark: SparkSession, sf: str) -> DataFrame:
    """One bright pixel without a mask: the amplitude is the same for all baselines."""
    sky = stash(fixtures.sky(spark, sf)[0].withColumn("b", F.when(F.col("ipix") == 100, F.col("b")).otherwise(0.0)))
    return V.forward(fixtures.half(spark, sf), sky, OBSERVATION, masked=False).select("day", "bid", F.round(cabs((F.col("re"), F.col("im"))), 4).alias("amp"))


def _images(spark: SparkSession, sf: str, masked: bool, offset: int = 0, pixels: int | None = None) -> DataFrame:
    sky, _ = fixtures.sky(spark, sf)
    half = fixtures.half(spark, sf)
    viss = stash(V.forward(half, sky, OBSERVATION).drop("n_visible"))
    # the other half is this half's mirror here, with the same lengths, gains and so weights
    both = W.weighted(_shells(spark, sf), OBSERVATION, offset).where("sgn = 1").join(viss, ["day", "bid"])
    shown = sky if pixels is None else sky.where(F.col("ipix") < pixels)
    return I.image(V.rephased(both), shown, OBSERVATION, masked, hermitian=True)


def image_noblockage(spark: SparkSession, sf: str) -> DataFrame:
    return _images(spark, sf, False).select("day", "ipix", F.round("c_re", 4).alias("c"))


def image_blockage(spark: SparkSession, sf: str) -> DataFrame:
    return _images(spark, sf, True).select("day", "ipix", F.round("c_re", 4).alias("c"))


def image_blockage_shifted(spark: SparkSession, sf: str) -> DataFrame:
    return _images(spark, sf, True, 1).select("day", "ipix", F.round("c_re", 4).alias("c"))


def image_total(spark: SparkSession, sf: str) -> DataFrame:
    return I.total(_images(spark, sf, False)).select("ipix", _r("c", 3))


def image_total_blockage(spark: SparkSession, sf: str) -> DataFrame:
    return I.total(_images(spark, sf, True)).select("ipix", _r("c", 3))


def _days(rows: DataFrame) -> list[int]:
    """The days of a table, a few hundred at most."""
    return sorted(r.day for r in rows.select("day").distinct().collect())


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


_GROUPS = {job.UVW: ("u v w", "u", "v", "w"), job.FIRST: ("a b c", "x1", "y1", "z1"), job.SECOND: ("a b c", "x2", "y2", "z2"), job.LENGTH: ("n", "bll")}


def _write_days(rows: DataFrame, folder: str) -> None:
    """The four files of each day, as the job reads them."""
    for pattern, (head, *columns) in _GROUPS.items():
        text.write_days(rows, f"{folder}/{pattern.split('/')[0]}", "rn", columns, head)


def _roundtrip(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every baseline of every day, and the same rows read back from files of triples and lengths, joined by position."""
    folder, rows = _folder(spark), stash(_numbered(spark, sf))
    _write_days(rows, folder)
    days = _days(rows)
    parts = [_day_folders(spark, f"{folder}/{pattern}", columns, len(columns), days) for pattern, (_, *columns) in _GROUPS.items()]
    return rows, stash(B.zipped(*parts))


def _day_folders(spark: SparkSession, pattern: str, names: list[str], header: int, days: list[int]) -> DataFrame:
    return text.read_triples(spark, pattern, days, names) if header == 3 else text.read_days(spark, pattern, days, names, header)


def _compared(rows: DataFrame, back: DataFrame) -> DataFrame:
    """(day, rn, same): whether all columns came back; a baseline that the files lack is not the same."""
    names = back.columns[2:]
    both = rows.join(back.select("day", "rn", *(F.col(c).alias(f"{c}_back") for c in names)), ["day", "rn"], "left")
    same = functools.reduce(operator.and_, (F.coalesce(F.abs(F.col(c) - F.col(f"{c}_back")) < 1e-9, F.lit(False)) for c in names))
    return both.select("day", "rn", same.alias("same"))


def text_roundtrip_all(spark: SparkSession, sf: str) -> DataFrame:
    """All days' files against their source."""
    return _compared(*_roundtrip(spark, sf))


def text_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The values of all days as they come back from files; a difference from their source is an error."""
    rows, back = _roundtrip(spark, sf)
    wrong = _compared(rows, back).where(~F.col("same")).count()
    if wrong:
        raise ValueError(f"{wrong} baselines differ from their files")
    return back.select("day", "rn", *(_r(c, 6) for c in back.columns[2:]))


def list_counted(spark: SparkSession, sf: str) -> DataFrame:
    """Brightnesses written as a counted list and read back."""
    folder = _folder(spark)
    raw = fixtures.brightness(spark, sf)
    text.write_values(raw, f"{folder}/B", "ipix", "b", str(raw.count()))
    return text.read_counted(spark, f"{folder}/B").select("rn", _r("b"))


def list_angles(spark: SparkSession, sf: str) -> DataFrame:
    """Both angles written as lists and read back."""
    folder, angles = _folder(spark), stash(H.pix2ang_nest(spark, fixtures.nside_of(spark, sf)))
    for name in ("theta", "phi"):
        text.write_values(angles, f"{folder}/{name}", "ipix", name)
    theta, phi = (text.read_scalars(spark, f"{folder}/{name}", name) for name in ("theta", "phi"))
    return theta.join(phi, "rn").select("rn", _r("theta", 6), _r("phi", 6))


def _job_folder(spark: SparkSession, sf: str) -> tuple[str, DataFrame, list[int]]:
    """A folder of a job's files: the sky's three lists, and the days with both halves of their baselines (the second half
    mirrors the first, in the same order)."""
    folder, raw = _folder(spark), fixtures.brightness(spark, sf)
    text.write_values(raw, f"{folder}/{job.SKY}", "ipix", "b", str(raw.count()))
    angles = stash(H.pix2ang_nest(spark, fixtures.nside_of(spark, sf)))
    for name in (job.THETA, job.PHI):
        text.write_values(angles, f"{folder}/{name}", "ipix", name)
    first = _numbered(spark, sf)
    size = first.groupBy("day").agg(F.count("*").alias("size"))
    both = B.mirrored(first).join(F.broadcast(size), "day")  # one row for each day
    rows = stash(both.withColumn("rn", F.col("rn") + F.when(F.col("sgn") == 1, 0).otherwise(F.col("size"))).drop("size"))
    _write_days(rows, folder)
    return folder, rows, _days(rows)


def image_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """The whole job: lists and day files in, day images out and read back."""
    folder, _, days = _job_folder(spark, sf)
    job.run(spark, folder, days, OBSERVATION, f"{folder}/C")
    return text.read_images(spark, f"{folder}/C").select("day", "ipix", F.round("c_re", 4).alias("c"))


def viss_injected(spark: SparkSession, sf: str) -> DataFrame:
    """The inverse alone, without a mask, of visibilities that come from files."""
    folder, rows, days = _job_folder(spark, sf)
    viss = stash(_viss(spark, sf))
    known = rows.join(viss, ["day", "bid"]).withColumn("im", F.col("im") * F.col("sgn"))
    text.write_days(known, f"{folder}/{job.VISS.split('/')[0]}", "rn", ["re", "im"], "re im")
    found = job.images(spark, folder, days, OBSERVATION, masked=False, known_viss=True)
    return found.select("day", "ipix", F.round("c_re", 4).alias("c"))


def image_general(spark: SparkSession, sf: str) -> DataFrame:
    """Both parts of the inverse of the first half alone, which has no mirror to cancel the imaginary one."""
    sky, _ = fixtures.sky(spark, sf)
    viss = stash(V.forward(fixtures.half(spark, sf), sky, OBSERVATION).drop("n_visible"))
    half = W.weighted(_shells(spark, sf), OBSERVATION).where("sgn = 1").join(viss, ["day", "bid"])
    return I.image(V.rephased(half), sky, OBSERVATION, False).select("day", "ipix", _r("c_re"), _r("c_im"))


def _image_10mhz(spark: SparkSession, sf: str, masked: bool) -> DataFrame:
    """The shorter waves of 10 MHz, on baselines in whose shells the density, and not the cap alone, sets the weights. The data
    are simulated through the Moon's mask in both forms; without blockage only the reconstruction has none."""
    sky, _ = fixtures.sky(spark, sf)
    half = fixtures.half(spark, sf, fixtures.SCALE_10MHZ)
    viss = stash(V.forward(half, sky, OBSERVATION_10MHZ).drop("n_visible"))
    both = W.weighted(W.with_shell(B.mirrored(half)), OBSERVATION_10MHZ).where("sgn = 1").join(viss, ["day", "bid"])
    image = I.image(V.rephased(both), sky, OBSERVATION_10MHZ, masked, hermitian=True)
    return image.select("day", "ipix", F.round("c_re", 4).alias("c"))


def image_10mhz(spark: SparkSession, sf: str) -> DataFrame:
    return _image_10mhz(spark, sf, True)


def image_10mhz_noblockage(spark: SparkSession, sf: str) -> DataFrame:
    return _image_10mhz(spark, sf, False)


def preview_image(spark: SparkSession, sf: str) -> DataFrame:
    """The first three pixels of every day's image: only these meet the baselines."""
    return _images(spark, sf, True, pixels=3).select("day", "ipix", F.round("c_re", 4).alias("c"))


def map_export(spark: SparkSession, sf: str) -> DataFrame:
    """Values of the summed map in the order of its pixels."""
    return I.map_rows(I.total(_images(spark, sf, True))).select("ipix", _r("c", 3))


def map_mollweide(spark: SparkSession, sf: str) -> DataFrame:
    """The summed map as a view of 800 x 400 places, of which only its own pixels are looked up."""
    nside = fixtures.nside_of(spark, sf)
    return rasters.mollweide(stash(I.total(_images(spark, sf, True))), nside).select("row", "col", _r("c", 3))


def mollweide_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many places of a view each pixel fills."""
    return rasters.mollweide_pixels(spark, fixtures.nside_of(spark, sf)).groupBy("ipix").agg(F.count("*").alias("n"))


def constants_log(spark: SparkSession, sf: str) -> DataFrame:
    """What a job logs of its settings."""
    found = settings(OBSERVATION, fixtures.nside_of(spark, sf))
    return spark.createDataFrame(found, "name string, value double").select("name", _r("value", 6))


QUERIES = {
    f.__name__: f
    for f in (
        pix_face, pix_xy, pix_ring, pix_jp, pix_region_counts, pix2ang, pix_resolution, sky_lmn, satellite_norm, baseline_mirror, baseline_zip, baseline_half,
        shell_id, shell_hist, shell_sorted, shell_sorted_all, shell_dcf, shell_dcf_shifted, incl_gain, weight, weight_shifted, vis_mask_count, vis_forward,
        vis_amplitude, vis_rephased, preview_vis, point_source, image_noblockage, image_blockage, image_blockage_shifted, image_total,
        image_total_blockage, image_general, image_10mhz, image_10mhz_noblockage, image_from_files, viss_injected, preview_image, map_export, map_mollweide, mollweide_counts,
        text_roundtrip, text_roundtrip_all, list_counted, list_angles, constants_log,
    )
}
