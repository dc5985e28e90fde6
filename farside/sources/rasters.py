"""Views of the sky: a Mollweide raster of a map in NESTED order.

The view's pixels, a few hundred thousand whatever the map's resolution, are turned into directions and these into map pixels,
and only these pixels of the map are looked up. Rows go from the north pole down; longitude grows to the left, with 0 in the
middle, as maps of the sky are drawn. Places outside of the ellipse have no row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.healpix import ang2pix_nest

WIDTH, HEIGHT = 800, 400
#: Pixels of a view that may be broadcast to a map.
MOST = 4_000_000


def mollweide_pixels(spark: SparkSession, nside: int, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """(row, col, ipix) of all places within the ellipse."""
    if width * height > MOST:
        raise ValueError(f"a view of {width} x {height} is larger than {MOST} pixels")
    grid = spark.range(width * height).select((F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    # the ellipse has half axes of 2 and 1
    x, y = 2 - (F.col("col") + 0.5) * (4.0 / width), 1 - (F.col("row") + 0.5) * (2.0 / height)
    turned = grid.withColumns({"x": x, "y": y}).where("x * x / 4 + y * y < 1").withColumn("aux", F.asin("y"))
    lat = F.asin((2 * F.col("aux") + F.sin(2 * F.col("aux"))) / math.pi)
    lon = F.col("x") * (math.pi / 2) / F.cos("aux")
    angles = turned.select("row", "col", (math.pi / 2 - lat).alias("theta"), F.when(lon < 0, lon + 2 * math.pi).otherwise(lon).alias("phi"))
    return ang2pix_nest(angles, nside).select("row", "col", "ipix")


def mollweide(values: DataFrame, nside: int, value: str = "c", width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """(row, col, value) of a map (ipix, value); pixels that the map lacks are null."""
    view = mollweide_pixels(values.sparkSession, nside, width, height)
    wanted = F.broadcast(view.select("ipix").distinct())  # bounded by MOST
    found = values.join(wanted, "ipix", "left_semi").select("ipix", value)
    return view.join(found, "ipix", "left").select("row", "col", value)
