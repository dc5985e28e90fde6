"""Deterministic sky and baselines out of the star-schema tables, so that SQL can work out the same numbers.

sky: part's key is the pixel, its price the brightness, with the largest nside whose pixels all have a part.
baselines: a vector's label is the day, its id the baseline; components 0-2 times SCALE are u, v, w, components 3-5 and
6-8 the two satellites' positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import nside_to_npix
from ..functions.complex import norm3
from ..operators import healpix
from ..operators.sky import sky_lmn
from ..plans.staging import discard, stash

#: Wavelengths in a unit of a vector, at 1 MHz and at 10 MHz: about three quarters and half of the weights are below the cap.
SCALE, SCALE_10MHZ = 3, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nside_for(n: int) -> int:
    """Largest power of two with at most n pixels."""
    nside = 1
    while nside_to_npix(2 * nside) <= n:
        nside *= 2
    return nside


def nside_of(spark: SparkSession, sf_dir: str) -> int:
    return nside_for(table(spark, sf_dir, "part").count())


def brightness(spark: SparkSession, sf_dir: str, nside: int | None = None) -> DataFrame:
    """(ipix, b) of all pixels, as a list of the sky would have them; nside, if it is known."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("ipix"), F.col("p_retailprice").cast("double").alias("b"))
    return rows.where(F.col("ipix") < nside_to_npix(nside or nside_of(spark, sf_dir)))


def sky(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(ipix, b, l, m, n), materialised, and nside."""
    nside = nside_of(spark, sf_dir)
    angles = healpix.pix2ang_nest(spark, nside)
    out = stash(sky_lmn(angles.join(brightness(spark, sf_dir, nside), "ipix"), nside_to_npix(nside)))
    discard(angles)
    return out, nside


def half(spark: SparkSession, sf_dir: str, scale: float = SCALE) -> DataFrame:
    """(day, bid, u, v, w, x1..z2, bll) of the first halves."""
    e = lambda k: F.col("embedding")[k].cast("double")
    df = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("int").alias("day"), F.col("vec_id").cast("long").alias("bid"), *(((e(k) * scale).alias(c)) for k, c in enumerate("uvw")), *(e(k + 3).alias(c) for k, c in enumerate(("x1", "y1", "z1", "x2", "y2", "z2")))
    )
    return df.withColumn("bll", norm3(F.col("u"), F.col("v"), F.col("w")))
