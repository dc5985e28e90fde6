"""Sky pixels as direction cosines, with brightness times solid angle."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import pixel_area
from ..plans.staging import stash


def sky_lmn(sky: DataFrame, npix: int) -> DataFrame:
    """(ipix, b, theta, phi) to (ipix, b, l, m, n); b is multiplied by the pixel's solid angle."""
    lat = math.pi / 2 - F.col("theta")
    lon = -F.when(F.col("phi") > math.pi, F.col("phi") - 2 * math.pi).otherwise(F.col("phi"))
    return sky.select("ipix", (F.col("b") * pixel_area(npix)).alias("b"), (F.cos(lat) * F.cos(lon)).alias("l"), (F.cos(lat) * F.sin(lon)).alias("m"), F.sin(lat).alias("n"))


def staged_sky(sky: DataFrame, npix: int) -> DataFrame:
    """sky_lmn(), materialised: it is the same for all days."""
    return stash(sky_lmn(sky, npix))
