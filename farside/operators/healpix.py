"""HEALPix pixels in NESTED order to angles, in closed form over whole-number columns.

A pixel's number within its face interleaves the bits of its two face coordinates (even bits x, odd bits y); ring and
longitude follow from them. Each step adds columns; pix2ang_nest() runs them all, with a materialisation boundary between
the whole-number and the floating-point half so that neither plan grows too large to compile.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import nside_to_npix
from ..plans.staging import stash


def _power_of_two(nside: int) -> int:
    if nside < 1 or nside & (nside - 1):
        raise ValueError("NESTED order needs a power of two")
    return nside.bit_length() - 1


def pixels(spark: SparkSession, nside: int) -> DataFrame:
    """ipix, one row for each pixel."""
    _power_of_two(nside)
    return spark.range(nside_to_npix(nside)).withColumnRenamed("id", "ipix")


def with_face(df: DataFrame, nside: int) -> DataFrame:
    """face, and ipf: the number within the face."""
    shift = 2 * _power_of_two(nside)
    return df.withColumns({"face": F.shiftright("ipix", shift).cast("int"), "ipf": F.col("ipix").bitwiseAND(F.lit(nside * nside - 1))})


def _gathered(ipf: Column, odd: int, bits: int) -> Column:
    """Every second bit of ipf, moved together."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftright(ipf, k + odd).bitwiseAND(F.lit(1 << k)))
    return out


def with_xy(df: DataFrame, nside: int) -> DataFrame:
    """ix, iy: coordinates within the face."""
    bits = _power_of_two(nside)
    return df.withColumns({"ix": _gathered(F.col("ipf"), 0, bits), "iy": _gathered(F.col("ipf"), 1, bits)})


def with_ring(df: DataFrame, nside: int) -> DataFrame:
    """jr (ring from the north pole), nr (pixels in a quarter of it), kshift and region (north, equator, south)."""
    ring = (F.shiftright("face", 2) + 2) * nside - F.col("ix") - F.col("iy") - 1
    jr = F.col("jr")
    region = F.when(jr < nside, "north").when(jr > 3 * nside, "south").otherwise("equator")
    nr = F.when(jr < nside, jr).when(jr > 3 * nside, 4 * nside - jr).otherwise(F.lit(nside).cast("long"))
    kshift = F.when(jr.between(nside, 3 * nside), (jr - nside) % 2).otherwise(F.lit(0).cast("long"))
    return df.withColumn("jr", ring).withColumns({"nr": nr, "kshift": kshift, "region": region})


def with_longitude_index(df: DataFrame, nside: int) -> DataFrame:
    """jp: the pixel's number along its ring, from 1."""
    # faces lie on the meridians 1, 3, 5, 7 (north and south) and 0, 2, 4, 6 (equator), in eighths of a turn
    eighth = 2 * (F.col("face") % 4) + F.when(F.shiftright("face", 2) == 1, 0).otherwise(1)
    jp = F.shiftright(eighth * F.col("nr") + F.col("ix") - F.col("iy") + 1 + F.col("kshift"), 1)
    return df.withColumn("jp", jp).withColumn("jp", F.when(F.col("jp") > 4 * nside, F.col("jp") - 4 * nside).when(F.col("jp") < 1, F.col("jp") + 4 * nside).otherwise(F.col("jp")))


def with_angles(df: DataFrame, nside: int) -> DataFrame:
    """theta (from the north pole) and phi, in radians."""
    nr, cap = F.col("nr"), 3.0 * nside * nside
    z = F.when(F.col("region") == "north", 1 - nr * nr / cap).when(F.col("region") == "south", nr * nr / cap - 1).otherwise((2 * nside - F.col("jr")) * (2.0 / (3 * nside)))
    phi = (math.pi / 2) * (F.col("jp") - (F.col("kshift") + 1) / 2) / nr
    return df.withColumns({"theta": F.acos(z), "phi": phi})


def indexed(spark: SparkSession, nside: int) -> DataFrame:
    """All whole-number columns of every pixel."""
    df = pixels(spark, nside)
    for step in (with_face, with_xy, with_ring, with_longitude_index):
        df = step(df, nside)
    return df


def pix2ang_nest(spark: SparkSession, nside: int) -> DataFrame:
    """ipix, theta, phi. The whole-number half is stored; discard() of the result deletes it."""
    stored = stash(indexed(spark, nside).select("ipix", "jr", "nr", "kshift", "region", "jp"))
    out = with_angles(stored, nside).select("ipix", "theta", "phi")
    out._stash_path = stored._stash_path
    return out


def _spaced(v: Column, bits: int) -> Column:
    """Bits of v moved to every second place."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftleft(v.bitwiseAND(F.lit(1 << k)), k))
    return out


def ang2pix_nest(df: DataFrame, nside: int) -> DataFrame:
    """df (with theta, phi) and ipix: the pixel that holds the direction. In the belt two families of lines, rising and
    falling with longitude, bound the pixels; at the caps both turn with the square root of the distance to the pole."""
    bits = _power_of_two(nside)
    z, turn = F.cos("theta"), F.pmod(F.col("phi") / (math.pi / 2), F.lit(4.0))
    df = df.withColumns({"_z": z, "_t": turn}).withColumns({"_q": F.least(F.floor("_t"), F.lit(3).cast("long")), "_s": F.sqrt(3 * (1 - F.abs("_z")))})
    across = F.col("_t") - F.col("_q")
    cap = F.abs("_z") > 2.0 / 3
    belt_up = F.floor(nside * (0.5 + F.col("_t") - 0.75 * F.col("_z")))
    belt_down = F.floor(nside * (0.5 + F.col("_t") + 0.75 * F.col("_z")))
    edge = F.lit(nside - 1).cast("long")
    df = df.withColumns({
        "_cap": cap,
        "_up": F.when(cap, F.least(F.floor(nside * F.col("_s") * across), edge)).otherwise(belt_up),
        "_down": F.when(cap, F.least(F.floor(nside * F.col("_s") * (1 - across)), edge)).otherwise(belt_down),
    })
    up, down, q = F.col("_up"), F.col("_down"), F.col("_q")
    face_up, face_down = F.shiftright(up, bits), F.shiftright(down, bits)
    belt_face = F.when(face_up == face_down, face_up % 4 + 4).when(face_up < face_down, face_up % 4).otherwise(face_down % 4 + 8)
    north = F.col("_z") > 0
    face = F.when(F.col("_cap"), F.when(north, q).otherwise(q + 8)).otherwise(belt_face)
    low = F.lit(nside - 1).cast("long")
    x = F.when(F.col("_cap"), F.when(north, edge - down).otherwise(up)).otherwise(down.bitwiseAND(low))
    y = F.when(F.col("_cap"), F.when(north, edge - up).otherwise(down)).otherwise(edge - up.bitwiseAND(low))
    df = df.withColumns({"_face": face, "_x": x, "_y": y})
    ipix = F.col("_face") * (nside * nside) + _spaced(F.col("_x"), bits).bitwiseOR(F.shiftleft(_spaced(F.col("_y"), bits), 1))
    return df.withColumn("ipix", ipix).drop("_z", "_t", "_q", "_s", "_cap", "_up", "_down", "_face", "_x", "_y")
