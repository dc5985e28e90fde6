"""Baselines: positional joins, the simulated half and its Hermitian mirror."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.complex import conj, norm3, ratio
from ..sources.text import sizes

POSITIONS = ("x1", "y1", "z1", "x2", "y2", "z2")


def zipped(uvw: DataFrame, first: DataFrame, second: DataFrame, length: DataFrame) -> DataFrame:
    """Four tables keyed by (day, rn), rn from 0 without gaps, joined row by row; days of unequal lengths are an error. Lengths
    are compared first (those of files are known from their scan), so that plain joins do, and each table is exchanged once."""
    keys = ["day", "rn"]
    tables = [uvw, first.toDF(*keys, *POSITIONS[:3]), second.toDF(*keys, *POSITIONS[3:]), length.toDF(*keys, "bll")]
    found = [sizes(t) for t in (uvw, first, second, length)]
    if None in found:
        counts = [t.groupBy("day").agg(F.count("*").alias("n")).withColumn("which", F.lit(k)) for k, t in enumerate(tables)]
        found = [{} for _ in tables]
        for r in functools.reduce(DataFrame.unionAll, counts).collect():  # four rows a day
            found[r.which][r.day] = r.n
    whole = [{d: n for d, n in f.items() if n} for f in found]
    if any(f != whole[0] for f in whole):
        wrong = sorted({d for f in whole for d in f if any(f[d] != g.get(d) for g in whole)})
        raise ValueError(f"the day's files have unequal lengths: days {wrong}")
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, keys)
    return out.select(*keys, "u", "v", "w", *POSITIONS, "bll")


def first_half(baselines: DataFrame) -> DataFrame:
    """Of each day's n rows (rn from 0) the first n div 2, as bid."""
    return _counted(baselines).where("rn < _n div 2").drop("_n").withColumnRenamed("rn", "bid")


def _counted(baselines: DataFrame) -> DataFrame:
    """baselines with _n, the rows of their day: counted first, as a day may have more rows than one task should hold."""
    return baselines.join(F.broadcast(baselines.groupBy("day").agg(F.count("*").alias("_n"))), "day")  # one row for each day


def with_conjugates(baselines: DataFrame, viss: DataFrame) -> DataFrame:
    """All rows of each day (rn from 0) with re, im: the first n div 2 those of viss (bid is rn), the next as many their
    conjugates in the same order, an odd last one 0."""
    half = F.expr("_n div 2")
    rows = _counted(baselines).withColumn("bid", F.when(F.col("rn") < half, F.col("rn")).when(F.col("rn") < 2 * half, F.col("rn") - half))
    _, im = conj((F.col("re"), F.col("im")))
    second = F.col("rn") >= half
    both = rows.join(viss.select("day", "bid", "re", "im"), ["day", "bid"], "left")
    return both.withColumns({"re": F.coalesce("re", F.lit(0.0)), "im": F.coalesce(F.when(second, im).otherwise(F.col("im")), F.lit(0.0))}).drop("bid", "_n")


def mirrored(half: DataFrame) -> DataFrame:
    """Both halves: sgn 1 as it is, sgn -1 with u, v, w negated (and im, if there is one)."""
    turned = [c for c in ("u", "v", "w", "im") if c in half.columns]
    both = half.withColumn("sgn", F.explode(F.array(F.lit(1), F.lit(-1))))
    return both.withColumns({c: F.col(c) * F.col("sgn") for c in turned})


def with_directions(baselines: DataFrame) -> DataFrame:
    """Unit vectors a1..c1, a2..c2 of both satellites, NaN for a zero vector; hoisted out of the pair loop."""
    out = {}
    for k in ("1", "2"):
        size = norm3(*(F.col(f"{axis}{k}") for axis in "xyz"))
        out |= {f"{name}{k}": ratio(F.col(f"{axis}{k}"), size) for name, axis in zip("abc", "xyz")}
    return baselines.withColumns(out)
