"""The whole job from files to files: lists of the sky, day files of baselines, day images and their sum.

Days are worked on some at a time. What is done of a day is moved to its place and then noted, so a job that was lost starts
again where it stopped: days with a note are skipped, and what lies in a day's place without one is replaced.
"""

from __future__ import annotations

import json
import logging
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import Observation, npix_to_nside, settings
from ..operators import baselines as B
from ..operators import imaging as I
from ..operators import visibility as V
from ..operators import weights as W
from ..operators.mask import forget
from ..operators.sky import staged_sky
from ..sources import text
from .staging import Store, discard, keep, scratch, stash

log = logging.getLogger("farside")

#: Names within a job's folder; {day} is a day's number. Triples have a header of three tokens, lengths of one.
SKY, THETA, PHI = "B", "theta", "phi"
UVW, FIRST, SECOND, LENGTH, VISS = "uvw/day={day}", "xyza/day={day}", "xyzb/day={day}", "bll/day={day}", "viss/day={day}"


def read_sky(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """(ipix, b, l, m, n), materialised, and nside: a counted list of brightnesses and two lists of angles."""
    b = text.read_counted(spark, f"{folder}/{SKY}", "b").withColumnRenamed("rn", "ipix")
    for name in (THETA, PHI):
        b = b.join(text.read_scalars(spark, f"{folder}/{name}", name).withColumnRenamed("rn", "ipix"), "ipix")
    b = stash(b)  # else the lists are read and joined once more to be counted
    npix = b.count()
    out = staged_sky(b, npix), npix_to_nside(npix)
    discard(b)
    return out


def read_baselines(spark: SparkSession, folder: str, days: list[int]) -> DataFrame:
    """(day, rn, u..w, x1..z2, bll) of the four files of each day."""
    triples = [text.read_triples(spark, f"{folder}/{p}", days, names) for p, names in ((UVW, ["u", "v", "w"]), (FIRST, ["a", "b", "c"]), (SECOND, ["a", "b", "c"]))]
    return B.zipped(*triples, text.read_days(spark, f"{folder}/{LENGTH}", days, ["bll"], header=1))


def read_viss(spark: SparkSession, folder: str, days: list[int]) -> DataFrame:
    """(day, rn, re, im) of known visibilities."""
    return text.read_days(spark, f"{folder}/{VISS}", days, ["re", "im"], header=2)


def images(
    spark: SparkSession, folder: str, days: list[int], observation: Observation, masked: bool = True, known_viss: bool = False, sky: tuple[DataFrame, int] | None = None
) -> DataFrame:
    """(day, ipix, c_re, c_im) of the days in the folder, stored. The second half of a day's rows has the first half's
    conjugates, and its own lengths and places; data always come through the Moon's mask, masked is for the reconstruction.
    known_viss: visibilities come from files, to try the inverse alone. sky: as read_sky() gives it, if it is known."""
    began = time.perf_counter()
    pixels, nside = sky or read_sky(spark, folder)
    for name, value in settings(observation, nside):
        log.info("%s: %s", name, value)
    with scratch():
        try:
            rows = stash(read_baselines(spark, folder, days))
            if known_viss:
                full = rows.join(read_viss(spark, folder, days), ["day", "rn"])
            else:
                full = B.with_conjugates(rows, stash(V.forward(B.first_half(rows), pixels, observation).drop("n_visible")))
            weighted = W.weighted(W.with_shell(full), observation)
            out = keep(stash(I.image(V.rephased(weighted), pixels, observation, masked)))
        finally:
            forget(pixels)  # its tree ends with this block
    if sky is None:
        discard(pixels)
    log.info("total time: %.1f s", time.perf_counter() - began)
    return out


def _note(target: str, day: int | str) -> str:
    return f"{target}/_done/{day}"


def done(spark: SparkSession, target: str, told: str | None = None) -> list[int]:
    """Days that have been written and noted; a note that tells of other settings than `told` is an error."""
    store, out = Store(spark), []
    for name in store.names(f"{target}/_done"):
        if name.isdigit():
            if told is not None and (found := store.read(_note(target, name))) != told:
                raise ValueError(f"day {name} in {target} was made with other settings: {found}")
            out.append(int(name))
    return sorted(out)


def run(spark: SparkSession, folder: str, days: list[int], observation: Observation, target: str, masked: bool = True, together: int = 8) -> DataFrame:
    """The days' images, written to target, `together` days at a time, and (ipix, c) of their sum. Run again after a stop, it
    goes on with the days that are missing."""
    store = Store(spark)
    pixels, nside = read_sky(spark, folder)
    told = json.dumps(dict(settings(observation, nside), masked=masked), sort_keys=True)
    known = set(done(spark, target, told))
    left = [d for d in sorted(set(days)) if d not in known]
    for at in range(0, len(left), together):
        some = left[at : at + together]
        found = images(spark, folder, some, observation, masked, sky=(pixels, nside))
        work = f"{target}/_work/{uuid.uuid4().hex}"
        text.write_images(found, work)
        for day in some:
            place = f"{target}/day={day}"
            if store.exists(place):
                store.delete(place)
            if store.exists(f"{work}/day={day}"):  # a day without baselines has no image
                store.move(f"{work}/day={day}", place)
            store.write(_note(target, day), told)
        store.delete(work)
        discard(found)
    discard(pixels)
    there = [d for d in sorted(set(days)) if store.exists(f"{target}/day={d}")]
    return I.total(text.read_images(spark, target, there)).select("ipix", F.col("c"))
