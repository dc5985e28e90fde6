"""The Moon's mask over a quadtree of the sky.

In NESTED order the pixels of a square share the upper bits of their numbers, so shifting a number right gives the cell it is
in. A cell has a bounding cone: a mean direction and the greatest angle from it to a pixel. For a satellite a cell is wholly
seen, wholly hidden or mixed, and only what is not hidden goes on to the cells and the pixels inside; pixels of wholly seen
cells need no test of their own. All tests compare cosines with thresholds that are worked out once for each cell.

Cells of the lowest level, the blocks, carry their pixels as an array of bounded length, so that a block is one row wherever it
is sent. Satellites without a direction (a zero vector) see nothing forward and are never hidden inversely, and a pixel
whose cosine is rounded beyond 1 has no angle; cells that hold a satellite's direction or its opposite are therefore mixed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import Observation
from ..functions.complex import norm3, ratio
from ..plans.staging import stash

#: Radians by which a cone is widened, well above the rounding of an angle.
MARGIN = 1e-7
#: Bits between levels: 16 cells in the one above. A block has at most 64 pixels, a tile at most 16,384.
STEP, BLOCK_BITS, TILE_BITS, TOP_CELLS = 4, 6, 14, 192


@dataclass
class Quadtree:
    """levels: cones from the coarsest cells (cell, parent) down to tiles. blocks: (tile, size, pixels) with a cone each, finer
    than tiles or the same. stored: the tables that these read."""

    levels: list[DataFrame]
    blocks: DataFrame
    finer: bool
    stored: list[DataFrame]


def _cell(shift: int, of: str = "ipix") -> Column:
    return F.shiftright(F.col(of), shift)


def _cones(members: DataFrame, observation: Observation, values: list[str], reach: bool) -> DataFrame:
    """Members (cell, l, m, n) as arrays of their values, by cell, with the cell's cone (l, m, n, radius) and the cosines of a
    satellite's angle from its centre: from `whole` on the cell is seen, below `none` it is hidden, and from `near` on (or
    below -near) the satellite's own direction (or the opposite one) may be inside. reach: members are cones themselves."""
    mean = [F.avg(c).alias(f"_{c}") for c in "lmn"]
    found = members.groupBy("cell").agg(F.collect_list(F.struct(*values)).alias("members"), *mean)
    size = norm3(*(F.col(f"_{c}") for c in "lmn"))
    # directions that cancel out have no mean: any will do, the radius says how far they are
    centre = {c: F.when(size < 1e-9, F.lit(float(c == "n"))).otherwise(ratio(F.col(f"_{c}"), size)) for c in "lmn"}
    found = found.withColumns(centre).drop("_l", "_m", "_n")

    def away(p: Column) -> Column:
        cosine = p["l"] * F.col("l") + p["m"] * F.col("m") + p["n"] * F.col("n")
        angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
        return angle + p["radius"] if reach else angle

    found = found.withColumn("radius", F.least(F.array_max(F.transform("members", away)), F.lit(math.pi)))
    free, wide = observation.open_angle, F.col("radius") + MARGIN
    named = {
        "whole": F.when(wide < free, F.cos(free - wide)).otherwise(2.0),
        "none": F.when(wide + free < math.pi, F.cos(wide + free)).otherwise(-2.0),
        "near": F.when(wide < math.pi, F.cos(wide)).otherwise(-2.0),
    }
    return found.withColumns(named)


_CONE = ("cl", "cm", "cn", "whole", "none", "near")


def _as_level(cones: DataFrame) -> DataFrame:
    own = [F.col(c).alias(f"c{c}") for c in "lmn"]
    return cones.select("cell", _cell(STEP, "cell").alias("parent"), *own, *_CONE[3:])


def quadtree(sky: DataFrame, nside: int, observation: Observation) -> Quadtree:
    """Of a materialised sky (ipix, l, m, n, with or without b); also of a part of one. The sky's object remembers it, for the
    next use of the same sky; forget() ends that."""
    key = (nside, observation.open_angle)
    if getattr(sky, "_tree", (None, None))[0] != key:
        sky._tree = (key, _quadtree(sky, nside, observation))
    return sky._tree[1]


def forget(sky: DataFrame) -> None:
    """Before the tables of a sky's tree, and of its layers, are deleted."""
    sky._tree = sky._far = (None, None)


def _quadtree(sky: DataFrame, nside: int, observation: Observation) -> Quadtree:
    bits = 2 * (nside.bit_length() - 1)
    block = tile = max(0, min(BLOCK_BITS, bits - 4))
    values = [c for c in ("ipix", "b", "l", "m", "n") if c in sky.columns]
    cells = lambda shift: 12 << (bits - shift) if shift <= bits else 0
    while tile + STEP <= TILE_BITS and cells(tile + STEP) >= TOP_CELLS:
        tile += STEP
    below = _cones(sky.withColumn("cell", _cell(block)), observation, values, False).withColumnRenamed("members", "pixels")
    below = blocks = stash(below.withColumns({"tile": _cell(tile - block, "cell"), "size": F.size("pixels").cast("long")}))
    levels, kept = ([_as_level(blocks)] if tile == block else []), [blocks]
    shift = block
    while shift < tile or cells(shift + STEP) >= TOP_CELLS:
        shift += STEP
        below = stash(_cones(below.select(_cell(STEP, "cell").alias("cell"), "l", "m", "n", "radius"), observation, ["l", "m", "n", "radius"], True).drop("members"))
        kept.append(below)
        if shift >= tile:
            levels.insert(0, _as_level(below))
    own = [F.col(c).alias(f"c{c}") for c in "lmn"]
    return Quadtree(levels, blocks.select("tile", "size", "pixels", *own, *_CONE[3:]), tile != block, kept)


def _cosine(k: str) -> Column:
    return F.col("cl") * F.col(f"a{k}") + F.col("cm") * F.col(f"b{k}") + F.col("cn") * F.col(f"c{k}")


def _hidden(k: str, forward: bool) -> Column:
    if forward:
        return (_cosine(k) < F.col("none")) | F.isnan(_cosine(k))
    return (_cosine(k) < F.col("none")) & (_cosine(k) > -F.col("near"))


def _whole(k: str, forward: bool) -> Column:
    seen = _cosine(k) >= F.col("whole")  # NaN is above all numbers: not hidden
    return seen & (_cosine(k) < F.col("near")) if forward else seen


def sifted(rows: DataFrame, forward: bool) -> DataFrame:
    """rows of satellites' directions (a1..c2) and a cell's cone without those that are hidden; sure: no pixel of the cell needs
    a test. Cells in a sure one are sure."""
    known = F.col("sure") if "sure" in rows.columns else F.lit(False)
    left = rows.where(known | ~(_hidden("1", forward) | _hidden("2", forward)))
    return left.withColumn("sure", known | (_whole("1", forward) & _whole("2", forward))).drop(*_CONE)


def descend(rows: DataFrame, levels: list[DataFrame], forward: bool) -> DataFrame:
    """rows of directions to (rows, cell, sure): from the coarsest cells down to tiles. Levels are broadcast: all of them
    together have one cell for each 15,000 pixels or so, or a few hundred."""
    out = sifted(rows.crossJoin(F.broadcast(levels[0].drop("parent"))), forward)
    for level in levels[1:]:
        inner = level.withColumnRenamed("cell", "_inner")
        out = sifted(out.join(F.broadcast(inner), F.col("cell") == F.col("parent")).drop("cell", "parent").withColumnRenamed("_inner", "cell"), forward)
    return out


def pixels_of(rows: DataFrame, all_: bool = True) -> DataFrame:
    """rows of blocks to rows of their pixels. all_: else only of blocks that need a test, and a sure one stays one row whose
    pixel is null."""
    others = [c for c in rows.columns if c != "pixels"]
    return rows.select(*others, F.inline("pixels") if all_ else F.inline_outer(F.when(~F.col("sure"), F.col("pixels"))))
