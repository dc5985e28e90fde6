"""Cells of the sky that a few points stand in for.

A baseline of few wavelengths turns slowly over a cell, so over all its pixels the wave follows from its values at some points
of the cell, to 13 digits (interpolation.py). Forward, a cell's brightness is dealt out to its points, and a baseline that sees
the whole cell meets these instead of the pixels. Inversely, baselines are summed at a cell's points, and its pixels get what lies
between. A baseline takes points of the coarsest cell that is wholly seen and within its reach; only at the rim of the Moon, and
where it is too long for any cell, it goes down to pixels. So pairs grow with baselines times the rim, not times the sky.

Cells form layers, each with a quarter of the one above. Coarse layers are broadcast, and a baseline is sent once to each coarse
cell that takes it and to each tile that none does: these and slot (a part of the baselines) are explicit keys of one exchange.
A task sums the pairs of a tile and a slot in arrays (tilesums.py), so pairs never are rows.

Inversely and without a mask every baseline within reach meets all the cells of a coarse layer: there a day's baselines come down to
one polynomial (moments.py) of bounded size, from which the points of those cells get their values.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import Observation, nside_to_npix
from ..functions import interpolation as P
from ..functions import moments as M
from ..functions.complex import norm3
from ..plans.staging import stash
from . import tilesums as T
from .mask import BLOCK_BITS, _cell, _cones, quadtree, sifted

#: Pixels from which a sky has layers, and bytes of a point or a pixel.
LEAST_PIXELS, POINT_BYTES = 49_152, 64
#: Bits between layers, of a tile, and cells of the lowest layer at most.
STEP, TILE_BITS, MOST_CELLS = 2, 14, 300_000
#: Baselines of a slot, and of a task that finds their cells.
SLOT_ROWS, TASK_ROWS = 100_000, 1024
#: A layer that reaches so many times less far than the one below is left out.
SHORT = 4
#: Baselines of a task that sums moments; days whose images a task fills together, without baselines and with some.
MOMENT_ROWS, DAYS, DAYS_MET = 16_384, 16, 4


@dataclass
class Layer:
    """Cells of 2^shift pixels: (cell, parent, cone); half the side of their squares, and the lengths that their points reach."""

    shift: int
    side: float
    degree: int
    reach: float
    cones: DataFrame


@dataclass
class Far:
    """layers from the coarsest down; places: (layer, cell, tile, cl, cm, cn), a cell's centre once for each tile that it meets;
    points: (layer, cell, id, l, m, n); blocks: (tile, layer, cell, members, cone) of pixels by the cells of the lowest layer."""

    layers: list[Layer]
    tile: int
    places: DataFrame
    blocks: DataFrame

    @functools.cached_property
    def points(self) -> DataFrame:
        """Made when they are first asked for: only forward sums read them."""
        centres = self.places.select("layer", "cell", "cl", "cm", "cn").distinct()
        centres = centres.repartition(centres.sparkSession.sparkContext.defaultParallelism, "layer", "cell")
        return stash(centres.mapInPandas(_points(_spec(self)), "layer int, cell long, id long, l double, m double, n double"))

    @property
    def upper(self) -> list[Layer]:
        return [x for x in self.layers if x.shift >= self.tile]

    @property
    def widest(self) -> Layer:
        """Of the coarse layers the one that reaches farthest; of several the coarsest."""
        return max(self.upper, key=lambda x: (x.reach, x.shift))

    @property
    def lower(self) -> list[Layer]:
        return [x for x in self.layers if x.shift < self.tile]


def length(defined: Column | None = None) -> Column:
    """Of a baseline; infinite where it is not defined."""
    size = norm3(F.col("u"), F.col("v"), F.col("w"))
    return size if defined is None else F.when(defined, size).otherwise(float("inf"))


def layered(sky: DataFrame, pixels: int, nside: int, observation: Observation, longest: float | None) -> Far | None:
    """Of a materialised whole sky; None of a small one or a part, and where no baseline is within reach. The sky's object
    remembers it as it does its tree. longest: of the baselines, those that are not finite left out."""
    if pixels < LEAST_PIXELS or pixels != nside_to_npix(nside) or not longest:
        return None
    longest = 1.25 ** math.ceil(math.log(longest, 1.25) - 1e-9)  # so that much the same baselines share the layers
    key = (nside, observation.open_angle, longest)
    if getattr(sky, "_far", (None, None))[0] != key:
        sky._far = (key, _layered(sky, nside, observation, longest))
    return sky._far[1]


def _layered(sky: DataFrame, nside: int, observation: Observation, longest: float) -> Far | None:
    bits = 2 * (nside.bit_length() - 1)
    below = quadtree(sky, nside, observation).stored[0]
    shift, cones, places = BLOCK_BITS, {}, []
    low = next(s for s in range(shift + STEP, bits + 1, STEP) if 12 << (bits - s) <= MOST_CELLS)
    while shift < bits:
        shift += STEP
        below = stash(_cones(below.select(_cell(STEP, "cell").alias("cell"), "l", "m", "n", "radius"), observation, ["l", "m", "n", "radius"], True).drop("members"))
        if shift >= low:
            cones[shift] = below
            # the pixel beside the middle: the same direction however a mean is added up
            middle = F.col("ipix").bitwiseAND(F.lit((1 << shift) - 1)) == 3 << (shift - 2)
            places.append(sky.where(middle).select(F.lit(shift).alias("layer"), _cell(shift).alias("cell"), F.col("l").alias("cl"), F.col("m").alias("cm"), F.col("n").alias("cn")))
    off = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("l") * F.col("cl") + F.col("m") * F.col("cm") + F.col("n") * F.col("cn"))))
    radii = [p.join(cones[s], "cell").agg(F.first("layer").alias("layer"), F.max(F.col("radius") + off).alias("radius")) for s, p in zip(cones, places)]
    radius = dict(tuple(r) for r in union(radii).collect())  # one row a layer
    layers = []
    for s in sorted(cones, reverse=True):
        side = 2 * math.sin(min(radius[s] + 1e-9, 2.0) / 2)
        degree, reach = P.degree_for(side, longest, (1 << s) // 2) if side * math.sqrt(2) < 1.9 else (0, 0.0)
        own = [F.col(c).alias(f"c{c}") for c in "lmn"]
        layers.append(Layer(s, side, degree, reach, cones[s].select("cell", _cell(STEP, "cell").alias("parent"), *own, "whole", "none", "near")))
    for x, inner in zip(layers, layers[1:]):
        if x.reach * SHORT <= inner.reach:
            x.reach = 0.0  # hardly a baseline would take it, and every pixel would be dealt out to its many points
    if not any(x.reach for x in layers):
        return None
    tile = max(low, min(TILE_BITS, bits - 4))
    centres = stash(union(places).where(F.col("layer").isin([x.shift for x in layers if x.reach])))
    # tiles inside the cell, or the one that it is in
    met = F.expr(f"CASE WHEN layer >= {tile} THEN sequence(shiftleft(cell, layer - {tile}), shiftleft(cell + 1, layer - {tile}) - 1) ELSE array(shiftright(cell, {tile} - layer)) END")
    blocks = quadtree(sky, nside, observation).blocks
    first = F.col("pixels")[0]["ipix"]
    blocks = blocks.select(F.shiftright(first, tile).alias("tile"), F.lit(0).alias("layer"), F.shiftright(first, low).alias("cell"), "pixels", "cl", "cm", "cn", "whole", "none", "near")
    return Far(layers, tile, stash(centres.withColumn("tile", F.explode(met))), blocks)


def union(tables: list[DataFrame]) -> DataFrame:
    """All rows of tables with the same columns."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out


def _points(spec: dict[int, tuple[int, float]]):
    def run(batches):
        for batch in batches:
            for layer, cells in batch.groupby("layer"):
                degree, side = spec[layer]
                size = P.count(degree)
                for k in range(0, len(cells), 256):
                    some = cells.iloc[k : k + 256]
                    at = np.concatenate([P.directions(P.padua(degree), centre, side) for centre in some[["cl", "cm", "cn"]].to_numpy()])
                    yield pd.DataFrame({"layer": layer, "cell": np.repeat(some["cell"].to_numpy(), size), "id": np.tile(np.arange(size), len(some)), "l": at[:, 0], "m": at[:, 1], "n": at[:, 2]})

    return run


def _cells(pixels: pd.DataFrame, places: pd.DataFrame, spec: dict[int, tuple[int, float]]):
    """(layer, cell, slice of the tile's pixels, terms of these, degree) of each cell that a tile meets, in order."""
    ipix, at = pixels["ipix"].to_numpy(), pixels[["l", "m", "n"]].to_numpy()
    for layer, cell, *centre in places.sort_values(["layer", "cell"])[["layer", "cell", "cl", "cm", "cn"]].itertuples(index=False):
        degree, side = spec[layer]
        some = slice(*np.searchsorted(ipix, [cell << layer, (cell + 1) << layer]))
        yield layer, cell, some, P.terms(P.projected(at[some], np.array(centre), side), degree), degree


def _spec(far: Far) -> dict[int, tuple[int, float]]:
    return {x.shift: (x.degree, x.side) for x in far.layers}


def dealt(far: Far, sky: DataFrame) -> DataFrame:
    """(layer, cell, id, b): a tile's brightness at the points of the cells it meets."""
    spec = _spec(far)

    def deal(pixels: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        pixels, out = pixels.sort_values("ipix"), []
        b = pixels["b"].to_numpy()
        for layer, cell, some, terms, degree in _cells(pixels, places, spec):
            at = P.solved(degree).T @ (terms.T @ b[some])
            out.append(pd.DataFrame({"layer": layer, "cell": cell, "id": np.arange(len(at)), "b": at}))
        return pd.concat(out) if out else pd.DataFrame({"layer": [], "cell": [], "id": [], "b": []})

    rows = sky.select(_cell(far.tile).alias("tile"), "ipix", "b", "l", "m", "n")
    return rows.groupBy("tile").cogroup(far.places.groupBy("tile")).applyInPandas(deal, "layer int, cell long, id long, b double")


def _sifted(rows: DataFrame, layer: Layer, forward: bool, masked: bool) -> DataFrame:
    rows = sifted(rows, forward) if masked else rows.drop("cl", "cm", "cn", "whole", "none", "near")
    taken = (F.col("layer") == 0) & F.col("sure") & (F.col("length") <= layer.reach) & F.lit(layer.reach > 0)
    # a row count ends the method that Spark generates: several layers in one would be more than the JVM compiles
    return rows.withColumn("layer", F.when(taken, layer.shift).otherwise(F.col("layer"))).observe(f"layer {layer.shift}", F.count(F.lit(1)).alias("n"))


def _down(rows: DataFrame, layers: list[Layer], forward: bool, masked: bool) -> DataFrame:
    """Rows that no layer has taken yet, to the cells inside theirs."""
    for layer in layers:
        inner = F.broadcast(layer.cones.withColumnRenamed("cell", "_inner"))
        rows = rows.join(inner, (F.col("cell") == F.col("parent")) & (F.col("layer") == 0), "left")
        rows = _sifted(rows.withColumn("cell", F.coalesce("_inner", "cell")).drop("_inner", "parent"), layer, forward, masked)
    return rows


def _members(points: DataFrame, values: list[str]) -> DataFrame:
    return points.groupBy("layer", "cell").agg(F.collect_list(F.struct(*values)).alias("members"))


def _upper(rows: DataFrame, far: Far, forward: bool, masked: bool) -> DataFrame:
    """Rows at the coarse cells that take them (layer, cell, sure), or at tiles (layer 0)."""
    top, *others = far.upper
    down = rows.crossJoin(F.broadcast(top.cones.drop("parent"))).withColumns({"sure": F.lit(not masked), "layer": F.lit(0)})
    return _down(_sifted(down, top, forward, masked), others, forward, masked)


def met(rows: DataFrame, far: Far, points: DataFrame, pixels: int, forward: bool, masked: bool, slots: int, slot: Column, values: list[str]) -> list[DataFrame]:
    """The pairs as rows, to count or look at them; the sums go without. Rows of directions with a length, together with the
    points, or pixels, that they meet: of coarse cells, and of what lies in tiles. Every row has layer (0: a pixel's), cell, sure
    and the values. points: (layer, cell, values)."""
    top, down = far.upper[0], _upper(rows, far, forward, masked)
    shifts = [x.shift for x in far.upper]
    coarse = F.broadcast(_members(points.where(F.col("layer").isin(shifts)), values))
    out = [down.where("layer > 0").join(coarse, ["layer", "cell"])]
    # without a mask, and with none too long for the coarsest, there is nothing more
    if masked or rows.where(F.col("length") > top.reach).limit(1).count():
        inside = _members(points.where(~F.col("layer").isin(shifts)), values)
        cone = [F.lit(None).cast("double").alias(c) for c in ("cl", "cm", "cn", "whole", "none", "near")]
        tile = F.expr(f"shiftright(cell, {far.tile} - layer)")
        blocks = far.blocks.withColumn("members", F.transform("pixels", lambda p: F.struct(*(_value(p, v) for v in values))))
        inside = inside.select(tile.alias("tile"), "layer", "cell", "members", *cone).unionAll(blocks.select("tile", "layer", "cell", "members", "cl", "cm", "cn", "whole", "none", "near"))
        inside = inside.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        # all that has one tile and slot comes to one task, whatever its cells
        cores = rows.sparkSession.sparkContext.defaultParallelism
        tasks = max(16 * cores, pixels * POINT_BYTES * slots >> 26)
        going = down.where("layer = 0").withColumn("tile", F.col("cell")).withColumn("slot", slot).repartition(tasks, "tile", "slot")
        going = _down(going, far.lower, forward, masked)
        both = going.join(inside.repartition(tasks, "tile", "slot").hint("shuffle_hash"), ["tile", "slot", "layer", "cell"])
        both = sifted(both, forward) if masked else both.drop("cl", "cm", "cn", "whole", "none", "near")
        out.append(both.drop("tile", "slot"))
    return [t.select(*(c for c in t.columns if c not in ("members", "length")), F.inline("members")) for t in out]


def _value(pixel: Column, name: str) -> Column:
    """A pixel's value as a point has it."""
    return F.lit(1).cast("long").alias(name) if name == "many" else pixel["ipix" if name == "id" else name].alias(name)


def _plan(far: Far, observation: Observation, forward: bool, masked: bool) -> T.Plan:
    spec = {x.shift: (x.degree, x.side, x.reach) for x in far.layers if x.reach}
    return T.Plan(far.tile, STEP, spec, observation.open_angle, forward, masked)


def _tasks(df: DataFrame, groups: int) -> int:
    return min(4096, max(8 * df.sparkSession.sparkContext.defaultParallelism, groups >> 3))


def _not_null(sums: DataFrame) -> DataFrame:
    """What is undefined comes out of pandas as null."""
    return sums.withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in ("re", "im")})


def _arrays(left: pd.DataFrame, masked: bool) -> tuple[np.ndarray, ...]:
    """(u, v, w), lengths and both satellites' directions of rows."""
    a, b = ((left[[f"{x}{k}" for x in "abc"]].to_numpy() if masked else None) for k in "12")
    return left[["u", "v", "w"]].to_numpy(), left["length"].to_numpy(), a, b


def seen(rows: DataFrame, far: Far, points: DataFrame, sky: DataFrame, pixels: int, observation: Observation, masked: bool, slots: int) -> DataFrame:
    """(day, bid, re, im, n) of baselines, in parts: a row for each tile or coarse cell where they see something. points: (layer,
    cell, id, l, m, n, b)."""
    plan, key = _plan(far, observation, True, masked), ["at", "cell", "slot"]

    def run(group: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((len(left), 3))
        if len(left):
            lines, every = _arrays(left, masked), np.arange(len(left))
            right = right.sort_values(["layer", "inner", "id"])
            layer, at, bright = right["layer"].to_numpy(), right[["l", "m", "n"]].to_numpy(), right["b"].to_numpy()
            if group[0]:
                T.seen_by(plan, *lines, at, bright, every, 3, out, 1 << group[0])
            else:
                where = {x: slice(*np.searchsorted(layer, [x, x + 1])) for x in np.unique(layer)}
                own = at[where[0]]
                for x, shift, start, some, sure in T.down(plan, own, *lines[1:], every, 3 * left["sure"].to_numpy(np.int8), plan.tile):
                    size = P.count(plan.spec[x][0]) if x else 1
                    first = where[x].start + (start >> x) * size
                    some_of = slice(first, first + (size if x else 1 << shift))
                    T.seen_by(plan, *lines, at[some_of], bright[some_of], some, sure, out, 1 << x)
        there = out[:, 2] > 0
        named = {"re": out[there, 0], "im": out[there, 1], "n": out[there, 2].astype("int64")}
        return pd.DataFrame({"day": left["day"][there], "bid": left["bid"][there]} | named)

    tasks = _tasks(sky, (pixels >> far.tile) * slots)
    slot = F.pmod(F.xxhash64("day", "bid"), F.lit(slots)).cast("int").alias("slot")
    left = _upper(rows, far, True, masked).withColumnRenamed("layer", "at").select("*", slot)
    upper = F.col("layer") >= far.tile
    at = F.when(upper, F.col("layer")).otherwise(0).alias("at"), F.when(upper, F.col("cell")).otherwise(F.expr(f"shiftright(cell, {far.tile} - layer)")).alias("cell")
    right = points.select(*at, "layer", F.col("cell").alias("inner"), "id", "l", "m", "n", "b")
    none = F.lit(0).cast("long")
    right = right.unionAll(sky.select(F.lit(0).alias("at"), _cell(far.tile).alias("cell"), F.lit(0).alias("layer"), none.alias("inner"), F.col("ipix").alias("id"), "l", "m", "n", "b"))
    right = right.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    left, right = (x.repartition(tasks, *key).groupBy(*key) for x in (left, right))
    return _not_null(left.cogroup(right).applyInPandas(run, "day int, bid long, re double, im double, n long"))


def coarse(rows: DataFrame, far: Far, pixels: int, observation: Observation, masked: bool, hermitian: bool, days: int, parts: int) -> DataFrame:
    """(day, layer, cell, id, re, im) in parts: rows' values (zr, zi) summed at the points of coarse cells. rows: as _upper()
    gives them, with part."""
    plan, key = _plan(far, observation, False, masked), ["layer", "cell", "day", "part"]

    def run(group: tuple, left: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["u", "v", "w", "zr", "zi"])  # so that sums don't depend on the order of rows
        degree, side, _ = plan.spec[group[0]]
        at = P.directions(P.padua(degree), left[["cl", "cm", "cn"]].to_numpy()[0], side)
        found = T.shone_on(plan, *_arrays(left, False), left[["zr", "zi"]].to_numpy(), at, np.arange(len(left)), 3, hermitian)
        return pd.DataFrame({"day": group[2], "layer": group[0], "cell": group[1], "id": np.arange(len(at)), "re": found[:, 0], "im": found[:, 1]})

    centres = far.places.where(F.col("layer") >= far.tile).select("layer", "cell", "cl", "cm", "cn").distinct()
    left = rows.where("layer > 0").join(F.broadcast(centres), ["layer", "cell"]).select(*key, "u", "v", "w", "zr", "zi", "length", "cl", "cm", "cn")
    groups = left.repartition(_tasks(rows, (pixels >> far.tile) * days * parts), *key).groupBy(*key)
    return groups.applyInPandas(run, "day int, layer int, cell long, id long, re double, im double")


def moments(rows: DataFrame, far: Far, n: int, days: int, hermitian: bool, added: list[Column]) -> DataFrame:
    """(day, layer, cell, id, re, im): the values (zr, zi) of rows within the reach of the widest layer, none of which is hidden, summed at
    its points. A task sums moments of a part of a day's rows; of a day they are as many as the reach needs. added: sums of
    re and im."""
    layer, spec = far.widest, _spec(far)
    shift, reach = layer.shift, layer.reach
    degree, parts = M.degree_for(reach), max(1, -(-n // (MOMENT_ROWS * days)))
    centres = [tuple(r) for r in far.places.where(F.col("layer") == shift).select("cell", "cl", "cm", "cn").distinct().orderBy("cell").collect()]  # few hundred at most

    def part(group: tuple, left: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["u", "v", "w", "zr", "zi"])  # so that sums don't depend on the order of rows
        found = M.moments(left[["u", "v", "w"]].to_numpy(), left[["zr", "zi"]].to_numpy(), reach, degree)
        return pd.DataFrame({"day": group[0], "id": np.arange(len(found)), "re": found[:, 0], "im": found[:, 1]})

    def at(group: tuple, sums: pd.DataFrame) -> pd.DataFrame:
        some = centres[group[1] :: shares]
        places = [P.directions(P.padua(spec[shift][0]), np.array(c[1:]), spec[shift][1]) for c in some]
        found = M.values(sums.sort_values("id")[["re", "im"]].to_numpy(), np.concatenate(places), reach, degree)
        size = len(places[0])
        cells, ids = np.repeat([c[0] for c in some], size), np.tile(np.arange(size), len(places))
        return pd.DataFrame({"day": group[0], "layer": shift, "cell": cells, "id": ids, "re": found[:, 0], "im": 0.0 if hermitian else found[:, 1]})

    shares = min(4, len(centres))
    own = F.pmod(F.xxhash64("u", "v", "w", "zr", "zi"), F.lit(parts)).cast("int").alias("share")
    groups = rows.select("day", own, "u", "v", "w", "zr", "zi").repartition(_tasks(rows, days * parts), "day", "share").groupBy("day", "share")
    sums = groups.applyInPandas(part, "day int, id long, re double, im double").groupBy("day", "id").agg(*added)
    sums = sums.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return sums.repartition(_tasks(rows, days * shares), "day", "share").groupBy("day", "share").applyInPandas(at, "day int, layer int, cell long, id long, re double, im double")


def shone(rows: DataFrame | None, sums: DataFrame, days: list[int], far: Far, sky: DataFrame, pixels: int, observation: Observation, masked: bool, hermitian: bool, parts: int) -> DataFrame:
    """(day, ipix, re, im) of every pixel and day, in parts: rows, if there are any that no coarse cell takes, summed in tiles, and
    what lies between sums (day, layer, cell, id, re, im) of coarse cells. A tile is sent once for some days together."""
    plan, key, each = _plan(far, observation, False, masked), ["cell", "some", "part"], DAYS if rows is None else DAYS_MET

    def run(group: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tile, some = int(group[0]), np.array(days[int(group[1]) * each : (int(group[1]) + 1) * each])
        right = right.sort_values(["layer", "id"])
        layer, ids, at = right["layer"].to_numpy(), right["id"].to_numpy(), right[["l", "m", "n"]].to_numpy()
        which = np.searchsorted(some, right["day"].to_numpy())
        own, values, centres = at[layer == 0], {}, {}
        for x in np.unique(layer[layer > 0]):
            place = int(x), tile >> int(x) - plan.tile
            centre, inside = (layer == x) & (ids < 0), (layer == x) & (ids >= 0)
            centres[place] = at[centre][0]
            if inside.any():
                values[place] = np.zeros((P.count(plan.spec[place[0]][0]), len(some), 2))
                values[place][ids[inside], which[inside]] = at[inside, :2]
        out = np.zeros((len(own), len(some), 2))
        if len(left):
            left = left.sort_values(["day", "u", "v", "w", "zr", "zi"])
            lines, z, sure = _arrays(left, masked), left[["zr", "zi"]].to_numpy(), 3 * left["sure"].to_numpy(np.int8)
            for k, day in enumerate(some):
                of_day = np.arange(*np.searchsorted(left["day"].to_numpy(), [day, day + 1]))
                for x, shift, start, met, seen in T.down(plan, own, *lines[1:], of_day, sure[of_day], plan.tile) if len(of_day) else ():
                    at = T.points(plan, own, x, start) if x else own[start : start + (1 << shift)]
                    found = T.shone_on(plan, *lines, z, at, met, seen, hermitian)
                    if x:
                        values.setdefault((x, (tile << plan.tile - x) + (start >> x)), np.zeros((len(at), len(some), 2)))[:, k] += found
                    else:
                        out[start : start + (1 << shift), k] += found
        if values:
            out += T.filled(plan, own, tile, {c: v.reshape(len(v), -1) for c, v in values.items()}, centres).reshape(out.shape)
        day, ipix = np.repeat(some, len(own)), np.tile(ids[layer == 0], len(some))
        return pd.DataFrame({"day": day, "ipix": ipix, "re": out[:, :, 0].T.ravel(), "im": out[:, :, 1].T.ravel()})

    lots = -(-len(days) // each)
    tasks = _tasks(sky, (pixels >> far.tile) * lots * parts)
    lot = lambda: F.floor((F.array_position(F.array(*map(F.lit, days)), F.col("day")) - 1) / each).cast("int").alias("some")
    of = ["cell", "some", "part", "layer", "id", "day", "l", "m", "n"]
    every, no_day = F.explode(F.sequence(F.lit(0), F.lit(lots - 1))), F.lit(None).cast("int").alias("day")
    right = sky.select(_cell(far.tile).alias("cell"), F.lit(0).alias("layer"), F.col("ipix").alias("id"), no_day, "l", "m", "n")
    right = right.withColumn("some", every).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(*of)
    upper, first = far.places.where(F.col("layer") >= far.tile), F.lit(0).alias("part")
    middles = upper.select(F.col("tile").alias("cell"), first, "layer", F.lit(-1).cast("long").alias("id"), no_day, F.col("cl").alias("l"), F.col("cm").alias("m"), F.col("cn").alias("n"))
    inside = sums.join(F.broadcast(upper.select("layer", "cell", "tile")), ["layer", "cell"])
    inside = inside.select(F.col("tile").alias("cell"), lot(), first, "layer", "id", "day", F.col("re").alias("l"), F.col("im").alias("m"), F.lit(0.0).alias("n"))
    right = union([right, middles.withColumn("some", every).select(*of), inside]).repartition(tasks, *key)
    schema = "day int, ipix long, re double, im double"
    if rows is None:

        def alone(group: tuple, right: pd.DataFrame) -> pd.DataFrame:
            return run(group, pd.DataFrame(), right)

        return _not_null(right.groupBy(*key).applyInPandas(alone, schema))
    directions = [f"{x}{k}" for k in "12" for x in "abc"] if masked else []
    left = rows.where("layer = 0").select("cell", lot(), "part", "day", "u", "v", "w", "zr", "zi", "length", "sure", *directions)
    return _not_null(left.repartition(tasks, *key).groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, schema))
