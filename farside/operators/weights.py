"""Density weights of baselines by half-wavelength shells of their length."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import INNER_WEIGHT, WEIGHT_CAP, Observation
from ..functions.complex import ratio


def shell_of(length: Column) -> Column:
    """0 up to a quarter, then half a wavelength each."""
    return F.ceil((length - 0.25) / 0.5).cast("int")


def with_shell(baselines: DataFrame) -> DataFrame:
    return baselines.withColumn("g", shell_of(F.col("bll")))


def shell_histogram(baselines: DataFrame, observation: Observation) -> DataFrame:
    """(day, g, cnt) of the shells 1..shells."""
    return baselines.where(F.col("g").between(1, observation.shells)).groupBy("day", "g").agg(F.count("*").alias("cnt"))


def _volume(g: Column) -> Column:
    """Of the half shell g."""
    r = g / 2 + 0.25
    return (2 * math.pi / 3) * (r * r * r - (r - 0.5) * (r - 0.5) * (r - 0.5))


def shell_density(histogram: DataFrame, offset: int = 0) -> DataFrame:
    """(day, g, dcf): volume over count; offset 1 gives shell g the values of shell g + 1."""
    return histogram.select("day", (F.col("g") - offset).alias("g"), (_volume(F.col("g")) / F.col("cnt")).alias("dcf")).where("g >= 1")


def gain() -> Column:
    """Inclination gain, from w and bll."""
    tilt = F.asin(ratio(F.col("w"), F.col("bll")))
    return F.sqrt(F.abs(1 - 4 * F.sin(tilt) * F.sin(tilt))) / F.abs(F.cos(tilt)) * 1.5


def weighted(baselines: DataFrame, observation: Observation, offset: int = 0) -> DataFrame:
    """baselines (both halves, with g) and wt: density times gain, at most WEIGHT_CAP. A shell without a density (none of
    its kind, or beyond the last) has the cap."""
    density = shell_density(shell_histogram(baselines, observation), offset)
    # one row for each day and shell: their number is bounded by the settings, not by the baselines
    joined = baselines.join(density, ["day", "g"], "left")
    dcf = F.when(F.col("g") == 0, F.lit(INNER_WEIGHT)).otherwise(F.col("dcf"))
    return joined.withColumn("wt", F.least(dcf * gain(), F.lit(WEIGHT_CAP))).drop("dcf")
