"""Shared helpers: stored intermediate tables, forests of links and connected components."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import checkpoint_dir, discard, stash  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that go to a Python worker at once. Texts can be very long, and a batch is held by Spark and by Python.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that Python functions get, unless the session's bound is lower still."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "67108864b").lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def trim() -> None:
    """Hand freed memory back: Arrow and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    found = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library's; others have no such call
    if found:
        found(0)


def tidy(function):
    """A function over Arrow batches that hands freed memory back when its task ends: Python workers stay for tasks to come
    beside those of other stages."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            trim()

    return run


_shared: dict[tuple, object] = {}


def shared(spark: SparkSession, key: tuple, make):
    """A broadcast of make(), made once for a key and an application. The driver keeps no copy of the object itself."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _shared:
        for other in [k for k in _shared if k[0] != key[0]]:
            del _shared[other]
        _shared[key] = spark.sparkContext.broadcast(make())
        trim()
    return _shared[key]


def column_name(df: DataFrame, base: str) -> str:
    """A column name that clashes with none of df's, compared without case."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = "_" + name
    return name


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the links a-b (64-bit ids): every node that is not its component's smallest, with that smallest."""
    if len(a) == 0:
        return a[:0], a[:0]
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _local_forest(batches):
    a = b = np.empty(0, np.int64)
    for batch in batches:
        # what is known so far shrinks to its stars at every batch, so the state is bounded by the task's distinct nodes
        a, b = forest(np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()]))
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """Distributed union-find over links (a long, b long; nulls and loops are ignored).

    Returns (node long, root long) for every node with a link to another one; root is the smallest id of its component
    (signed order). Each task first turns its links into stars, then large-star and small-star steps over shuffled,
    map-side combined minima alternate until all links are stars (logarithmically many rounds). Every round is written to
    the shared checkpoint folder, the last one is the result; links never reach the driver.
    """
    spark = links.sparkSession
    clean = links.select(F.col(links.columns[0]).cast("long").alias("a"), F.col(links.columns[1]).cast("long").alias("b"))
    edges = stash(clean.where("a <> b").mapInArrow(tidy(_local_forest), "a long, b long"))
    while _tangled(edges):
        large = _star(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), larger=True)
        ordered = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        new = stash(_star(ordered, larger=False).mapInArrow(tidy(_local_forest), "a long, b long").distinct())
        discard(edges)
        edges = new
    out = edges.toDF("node", "root")
    out._stash_path = edges._stash_path  # for discard()
    return out


def _tangled(edges: DataFrame) -> bool:
    """Whether some node has two links down, or one down and one up: links (a, b) with b < a are stars otherwise."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(edges.select(F.col("b").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return not ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down > 0 and up > 0").isEmpty()


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """One star step over directed pairs a -> b: each neighbour is linked to the least id around a. larger: neighbours
    above a only (large-star); else a and its smaller neighbours (small-star)."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = pairs.join(least, "a")
    if larger:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(least.select("a", F.col("m").alias("b")).where("a <> b")).distinct()


def hot_join(rows: DataFrame, table: DataFrame, key: str, count: str, parts: int = 512, least: int = 10_000) -> DataFrame:
    """rows joined with a table that has one row for each key and, in its column `count`, the number of rows with that key;
    both are stored tables. Keys that more than 1/parts of those rows share (so at most `parts` of them, each with over
    `least` rows) are looked up in a broadcast table, the rest meets in an exchange: no task gets all rows of a hot key."""
    often = max(least, (table.agg(F.sum(count)).first()[0] or 0) // parts)
    hot, cold = (table.where(c).drop(count) for c in (F.col(count) > often, F.col(count) <= often))
    if hot.isEmpty():
        return rows.join(cold, key)
    few = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return few.unionAll(rest.select(*few.columns))


#: 64-bit words of the largest filters: in Python workers (32 MB) and as a broadcast table of as many rows.
ARRAY_WORDS, TABLE_WORDS = 1 << 22, 1 << 20


def filter_words(n: int, most: int) -> int | None:
    """Words of a filter that gives every one of n ids eight bits. None if that takes more than `most`: such a filter would
    be too large to send, a smaller one too full to be of use, and callers exchange all rows instead."""
    words = 1 << 12
    while words * 64 < 8 * n:
        words *= 2
    return words if words <= most else None


def _bloom(ids: DataFrame, words: int) -> DataFrame:
    """(word, bits) of the hash bits of a single column."""
    h = F.xxhash64(F.col(ids.columns[0]))
    word = F.pmod(F.shiftright(h, 6), F.lit(words)).alias("word")
    return ids.select(word, F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{ids.columns[0]}`), 64) as int))").alias("b")).groupBy("word").agg(F.expr("bit_or(b)").alias("bits"))


def split_by_bloom(rows: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose id may be among ids (one column, stored), and rows whose id surely is not. Sized by the count of ids;
    beyond the bound of a broadcast all rows are in the first."""
    words = filter_words(ids.count(), TABLE_WORDS)
    if words is None:
        return rows, rows.where(F.lit(False))
    word, bits = (column_name(rows, c) for c in ("_bloom_word", "_bloom_bits"))
    at = F.pmod(F.shiftright(F.xxhash64(F.col(id_col)), 6), F.lit(words))
    joined = rows.join(F.broadcast(_bloom(ids, words).toDF(word, bits)), at == F.col(word), "left")
    hit = F.coalesce(F.expr(f"(`{bits}` & shiftleft(1L, cast(pmod(xxhash64(`{id_col}`), 64) as int))) <> 0"), F.lit(False))
    own = [F.col(f"`{c}`") for c in rows.columns]
    return joined.where(hit).select(*own), joined.where(~hit).select(*own)


def bloom_bits(ids: DataFrame) -> np.ndarray | None:
    """A filter of ids (one column of longs, repeats allowed), to be sent along with Python functions; None if they are
    too many for its bound."""
    words = filter_words(ids.agg(F.approx_count_distinct(ids.columns[0])).first()[0], ARRAY_WORDS)
    if words is None:
        return None
    found = _bloom(ids, words).toArrow()
    out = np.zeros(words, np.uint64)
    out[found.column(0).to_numpy().astype(np.int64)] = found.column(1).to_numpy().view(np.uint64)
    return out


def hash_of_long(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's xxhash64 of a long: XXH64 of its eight little-endian bytes."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, k: v << np.uint64(k) | v >> np.uint64(64 - k)
    h = np.uint64((seed + int(p5) + 8) & (1 << 64) - 1) ^ turn(x * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)


def bloom_has(bits: np.ndarray | None, ids: np.ndarray) -> np.ndarray:
    """Whether each id (unsigned 64-bit) may be among those of bloom_bits(); without a filter all may."""
    if bits is None:
        return np.ones(len(ids), bool)
    h = hash_of_long(ids)
    word = (h.view(np.int64) >> 6) % len(bits)
    return bits[word] >> (h & np.uint64(63)) & np.uint64(1) != 0
