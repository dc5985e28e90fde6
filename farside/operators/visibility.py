"""Forward model: visibilities through the Moon's mask.

Each baseline meets the blocks of the sky that its satellites see, found from coarse cells downwards (mask.py), and in these
every pixel. The sky's blocks are broadcast only after their size has been checked. Beyond the bound baselines are sent to the
tiles that they see: tiles and parts of the baselines are explicit keys, so one exchange brings a baseline to a tile once, and a
task holds one tile. Sums are combined before the one small exchange, and they are sums of scaled whole numbers: equal inputs
give equal bits however they are partitioned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import Observation, nside_to_npix
from ..functions.complex import cmul, turn
from ..plans.staging import stash
from . import farfield
from .baselines import with_directions
from .mask import Quadtree, descend, pixels_of, quadtree, sifted

#: Bytes up to which a side may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Bytes of a pixel in a block.
PIXEL_BYTES = 64
#: Rows of baselines that meet one tile in one task.
BLOCK_ROWS = 50_000


def spread(df: DataFrame, rows: int, per_task: int = 256) -> DataFrame:
    """df over enough partitions to keep all cores busy with few rows each: every row stands for a whole other side."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(-(-rows // 8), max(2 * cores, -(-rows // per_task)))))


def extent(sky: DataFrame) -> tuple[int, int, float]:
    """(rows, nside, sum of absolute brightness) of a materialised sky; nside of the smallest whole sky that holds it."""
    if not hasattr(sky, "_extent"):
        bright = F.sum(F.abs("b")) if "b" in sky.columns else F.lit(0.0)
        sky._extent = tuple(sky.agg(F.count("*"), F.max("ipix"), bright).first())
    rows, last, total = sky._extent
    nside = 1
    while rows and nside_to_npix(nside) <= last:
        nside *= 2
    return rows, nside, total or 0.0


def exact_sum(term: Column, bound: float) -> Column:
    """Sum of terms whose absolute values add up to at most `bound`: as whole numbers of a fixed step, 2^-61 of the bound or
    less, so that the order of adding is of no consequence. Terms that are not finite, of which the bound tells, are added
    as they are."""
    if not math.isfinite(bound):
        return F.sum(term)
    step = 2.0 ** (61 - math.frexp(max(bound, 1e-290))[1])
    return F.sum(F.rint(term * step).cast("long")) / step


def met(rows: DataFrame, n_rows: int, tree: Quadtree, n_pixels: int, forward: bool, masked: bool, key: tuple[str, ...]) -> DataFrame:
    """Every row of directions with the blocks it does not miss, and sure: their pixels need no test. key: columns that tell the
    rows apart, to deal them by."""
    if masked:
        rows = descend(rows, tree.levels, forward)
    else:
        rows = rows.crossJoin(F.broadcast(tree.levels[-1].select("cell"))).withColumn("sure", F.lit(True))
    blocks = tree.blocks
    if n_pixels * PIXEL_BYTES <= BROADCAST_BYTES:
        both = rows.join(F.broadcast(blocks), F.col("cell") == F.col("tile"))
    else:
        parts = max(1, -(-n_rows // BLOCK_ROWS))
        rows = rows.withColumn("part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))
        blocks = blocks.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        both = rows.join(blocks.hint("shuffle_hash"), (F.col("cell") == F.col("tile")) & (F.col("part") == F.col("of"))).drop("part", "of")
    return sifted(both.drop("cell", "tile"), forward)


def cosine(k: str) -> Column:
    """Of the angle between a pixel and satellite k."""
    return F.col("l") * F.col(f"a{k}") + F.col("m") * F.col(f"b{k}") + F.col("n") * F.col(f"c{k}")


def seen(observation: Observation) -> Column:
    """Both satellites see the pixel past the Moon; no if an angle is undefined (NaN sorts above 1)."""
    least = math.cos(observation.open_angle)
    return cosine("1").between(least, 1.0) & cosine("2").between(least, 1.0)


def hidden(observation: Observation) -> Column:
    """The Moon hides the pixel from a satellite; no if the angle is undefined."""
    least = math.cos(observation.open_angle)
    one = lambda k: (cosine(k) < least) & (cosine(k) >= -1.0)
    return one("1") | one("2")


def _half(half: DataFrame) -> DataFrame:
    return stash(with_directions(half).select("day", "bid", "u", "v", "w", *(f"{a}{k}" for k in "12" for a in "abc")))


def _every(half: DataFrame, sums: DataFrame) -> DataFrame:
    """Sums of all baselines, also of those that see nothing."""
    zero = [F.coalesce(c, F.lit(0).cast(sums.schema[c].dataType)).alias(c) for c in sums.columns[2:]]
    return half.select("day", "bid").join(sums, ["day", "bid"], "left").select("day", "bid", *zero)


def forward(half: DataFrame, sky: DataFrame, observation: Observation, masked: bool = True) -> DataFrame:
    """(day, bid, re, im, n_visible) for each baseline of the half, also for those that see nothing."""
    half, (pixels, nside, bright) = _half(half), extent(sky)
    n, longest = half.agg(F.count("*"), F.max(F.when(farfield.length() < float("inf"), farfield.length()))).first()
    far = farfield.layered(sky, pixels, nside, observation, longest) if math.isfinite(bright) else None
    if far:
        bright *= 64  # what is dealt out is at most so much more in all
        points = farfield.dealt(far, sky).groupBy("layer", "cell", "id").agg(exact_sum(F.col("b"), bright).alias("b"))
        points = stash(points.join(far.points, ["layer", "cell", "id"]))
        rows = spread(half.withColumn("length", farfield.length()), n, farfield.TASK_ROWS)
        found = farfield.seen(rows, far, points, sky, pixels, observation, masked, -(-n // farfield.SLOT_ROWS))
        sums = [exact_sum(F.col(c), bright).alias(c) for c in ("re", "im")]
        return _every(half, stash(found.groupBy("day", "bid").agg(*sums, F.sum("n").alias("n_visible"))))
    both = pixels_of(met(spread(half, n), n, quadtree(sky, nside, observation), pixels, True, masked, ("day", "bid")))
    both = both.where(F.col("sure") | seen(observation)) if masked else both
    phase = -2 * math.pi * (F.col("u") * F.col("l") + F.col("v") * F.col("m") + F.col("w") * (F.col("n") - 1))
    re, im = turn(phase)
    sums = [exact_sum(F.col("b") * part, bright).alias(name) for name, part in (("re", re), ("im", im))]
    return _every(half, both.groupBy("day", "bid").agg(*sums, F.count("*").alias("n_visible")))


def visible_counts(half: DataFrame, sky: DataFrame, observation: Observation) -> DataFrame:
    """(day, bid, n_visible) alone: wholly seen blocks are counted, only mixed ones come down to pixels."""
    half, (pixels, nside, _) = _half(half), extent(sky)
    n = half.count()
    tree = quadtree(sky, nside, observation)
    both = pixels_of(met(spread(half, n), n, tree, pixels, True, True, ("day", "bid")), all_=False)
    found = F.when(F.col("sure"), F.col("size")).when(seen(observation), 1).otherwise(0)
    return _every(half, both.groupBy("day", "bid").agg(F.sum(found).alias("n_visible")))


def rephased(viss: DataFrame) -> DataFrame:
    """re, im times exp(-2 pi i w): takes the 1 out of n - 1."""
    re, im = cmul((F.col("re"), F.col("im")), turn(-2 * math.pi * F.col("w")))
    return viss.withColumns({"re": re, "im": im})
