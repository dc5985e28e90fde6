"""Inverse model: a sky image for each day, and their sum."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import Observation
from ..functions.complex import cabs, cmul, turn
from ..plans.staging import stash
from . import farfield, visibility
from .baselines import with_directions
from .farfield import Far
from .mask import pixels_of, quadtree, sifted
from .visibility import exact_sum, extent, hidden, met, spread

#: Bytes of a baseline when it is broadcast.
ROW_BYTES = 128


def image(baselines: DataFrame, sky: DataFrame, observation: Observation, masked: bool, hermitian: bool = False) -> DataFrame:
    """(day, ipix, c_re, c_im): the sum over each day's weighted, re-phased visibilities. hermitian: the rows are one half
    of baselines whose other half is their mirror, so the sum is twice the real part.

    Few baselines are broadcast, and each task has some blocks of the sky: a block that is hidden from a baseline goes no
    further. More are sent to the tiles they do not miss, once each; a task has a tile and a part of the baselines, and sums
    of its pixels leave it once for each day."""
    columns = ["day", "u", "v", "w", "re", "im", "wt"]
    if masked:
        baselines = with_directions(baselines)
        columns += [f"{a}{k}" for k in "12" for a in "abc"]
    few = stash(baselines.select(*columns))
    pixels, nside, _ = extent(sky)
    tree = quadtree(sky, nside, observation)
    # sums of a day are at most this
    size = F.abs(F.col("wt")) * cabs((F.col("re"), F.col("im")))
    length = farfield.length(size < float("inf"))
    per_day = few.groupBy("day").agg(F.count("*").alias("n"), F.sum(size).alias("most"), F.max(F.when(length < float("inf"), length)).alias("longest"))
    n, most, longest, days = per_day.agg(F.sum("n"), F.max("most"), F.max("longest"), F.sort_array(F.collect_list("day"))).first()  # days: a few hundred
    known = len(days) == per_day.count()
    far = farfield.layered(sky, pixels, nside, observation, longest) if known else None
    if far:
        return _far_image(few.withColumn("length", length), n, days, most, sky, far, pixels, observation, masked, hermitian)
    if (n or 0) * ROW_BYTES <= visibility.BROADCAST_BYTES:
        blocks = tree.blocks.drop("tile", "size")
        both = spread(blocks, -(-pixels // 16), 64).crossJoin(F.broadcast(few))
        both = sifted(both, forward=False) if masked else both.withColumn("sure", F.lit(True))
    else:
        both = met(few, n, tree, pixels, False, masked, ("u", "v", "w"))
    both = pixels_of(both)
    if masked:
        both = both.where(F.col("sure") | ~hidden(observation))
    real, imaginary = _sums(most or 0.0)
    found = both.groupBy("day", "ipix").agg(*([(2 * real).alias("c_re")] if hermitian else [real.alias("c_re"), imaginary.alias("c_im")]))
    found = found.withColumn("c_im", F.lit(0.0)) if hermitian else found
    if not masked:
        return found
    # a pixel that is hidden from all baselines of a day is dark
    days = few.select("day").distinct()
    every = sky.select("ipix").crossJoin(F.broadcast(days))
    return every.join(found, ["day", "ipix"], "left").select("day", "ipix", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("c_re", "c_im")))


def _sums(most: float) -> tuple[Column, Column]:
    """Real and imaginary parts of what meets a direction."""
    phase = 2 * math.pi * (F.col("u") * F.col("l") + F.col("v") * F.col("m") + F.col("w") * F.col("n"))
    re, im = cmul((F.col("re"), F.col("im")), turn(phase))
    return exact_sum(F.col("wt") * re, most), exact_sum(F.col("wt") * im, most)


def _far_image(few: DataFrame, n: int, days: list[int], most: float, sky: DataFrame, far: Far, pixels: int, observation: Observation, masked: bool, hermitian: bool) -> DataFrame:
    """image() of a sky with layers: sums at the points of cells, and at the pixels of those that no layer takes."""
    parts = -(-n // (farfield.SLOT_ROWS * len(days)))
    both = [exact_sum(F.col(c), most).alias(c) for c in ("re", "im")]
    rows = few.withColumns({"zr": F.col("wt") * F.col("re"), "zi": F.col("wt") * F.col("im")}).drop("re", "im", "wt")
    sums, met_ = [], None
    if not masked:
        # all within reach meet all cells of a layer; others, if there are any, go down to tiles
        short = F.coalesce(F.col("length") <= far.widest.reach, F.lit(False)) & F.lit(far.widest.reach > 0)
        if rows.where(short).limit(1).count():
            sums.append(farfield.moments(rows.where(short), far, n, len(days), hermitian, both))
        rows = rows.where(~short)
    if masked or rows.limit(1).count():
        part = F.pmod(F.xxhash64("u", "v", "w", "zr", "zi"), F.lit(parts)).cast("int")
        met_ = farfield._upper(spread(rows.withColumn("part", part), n, farfield.TASK_ROWS), far, False, masked)
        sums.append(farfield.coarse(met_, far, pixels, observation, masked, hermitian, len(days), parts))
    sums = stash(farfield.union(sums).groupBy("day", "layer", "cell", "id").agg(*both))
    found = farfield.shone(met_, sums, days, far, sky, pixels, observation, masked, hermitian, parts)
    found = found.groupBy("day", "ipix").agg(*both) if parts > 1 else found
    return found.select("day", "ipix", (2 * F.col("re") if hermitian else F.col("re")).alias("c_re"), F.col("im").alias("c_im"))


def map_rows(sums: DataFrame) -> DataFrame:
    """(ipix, c) in the order of the pixels, as a map's plot takes its values."""
    return sums.select("ipix", "c").orderBy("ipix")


def total(images: DataFrame) -> DataFrame:
    """(ipix, c): the days' real parts summed, NaN as 0."""
    return images.groupBy("ipix").agg(F.sum(F.nanvl("c_re", F.lit(0.0))).alias("c"))
