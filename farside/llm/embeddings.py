"""Embedding near-dedup by product quantisation.

Unit vectors are filed under the nearest of a number of coarse centres (inverted lists); what is left after subtracting
the centre is cut into subspaces, each coded by its nearest codeword. Two linked vectors of different lists meet in the
list of the lower number: a vector visits it if the plane that bisects the two centres is no further off than the greatest
distance of a link, and if its distance to that centre is within that distance of those of the list's own vectors. A linked
vector can be in no other list, so the probes are sufficient. Visitors bring their codes only. In the list, distances of its
vectors to all coded ones are sums of table entries (asymmetric: the list's own vectors are not coded), and a pair goes
on only if that distance is within the link's plus the code's own error, which again loses nothing. What remains is
compared by exact cosine in double precision; the vectors of visitors are fetched for that, once for each block of a list.

Equal vectors of one label are one class with a count before the search, known by two 64-bit hashes of its values. A list
with many rows is cut into blocks, and visitors pass them in batches, so memory is bounded by a block; a task returns counts
of links and spanning stars, never the pairs of one block.

Centres and codewords are fitted on a sample of classes, taken by order of a hash: sample_rows, or eight for each list if
that is more. There are as many lists as the root of the number of classes of one label, on average; all rows are filed.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows
with a null label or a null id: n_links 0, component_id the own id, kept true; vectors of different length never link;
repeated rows are vectors of their own that are linked with each other; ids that stand for several vectors count for each,
and component_id is the least id of the component; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import components, discard, forest, small_batches, stash

SLACK = 1e-4


def _nearest(x: np.ndarray, centres: np.ndarray, step: int = 4096) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    parts = [np.argmin(half - x[k : k + step] @ centres.T, axis=1) for k in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres by Lloyd's rounds from k rows drawn without replacement."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        size = np.bincount(own, minlength=len(centres))
        total = np.stack([np.bincount(own, column, len(centres)) for column in x.T], axis=1)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


class Quantiser:
    def __init__(self, sample: np.ndarray, n_lists: int, n_parts: int = 8, n_words: int = 64):
        self.centres = kmeans(sample, n_lists)
        rest = sample - self.centres[_nearest(sample, self.centres)]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(n_parts, sample.shape[1]))
        self.words = [kmeans(rest[:, p], n_words) for p in self.parts]

    def file(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, the codes' error and the distance to the list's centre of each row."""
        own = _nearest(x, self.centres)
        rest = x - self.centres[own]
        codes = np.stack([_nearest(rest[:, p], w) for p, w in zip(self.parts, self.words)], axis=1).astype(np.uint8)
        coded = np.concatenate([w[codes[:, k]] for k, w in enumerate(self.words)], axis=1)
        return own, codes, np.linalg.norm(rest - coded, axis=1), np.linalg.norm(rest, axis=1)

    def probes(self, x: np.ndarray, own: np.ndarray, reach: float, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Which lists below its own each row visits. near, far: the least and greatest distance of a list's vectors."""
        c, square = self.centres, (self.centres**2).sum(axis=1)
        score = x @ c.T - square / 2
        ahead = score[np.arange(len(x)), own][:, None] - score
        away = np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] - 2 * score, 0))
        apart = np.sqrt(np.maximum(square[own][:, None] + square - 2 * c[own] @ c.T, 0))
        hits = (ahead <= reach * apart + SLACK) & (away <= far + reach + SLACK) & (away >= near - reach - SLACK)
        return hits & (np.arange(len(c)) < own[:, None])

    def distances(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of every row of x to every coded row, by table look-up: products with all words of
        a subspace and with the coded rows' centres, and the squares of what is coded."""
        which, place = np.unique(lists, return_inverse=True)
        square, total = np.zeros(len(codes)), (x @ self.centres[which].T).astype(np.float32)[:, place]
        for k, (p, w) in enumerate(zip(self.parts, self.words)):
            total += (x[:, p] @ w.T).astype(np.float32)[:, codes[:, k]]
            square += ((self.centres[which][:, p][place] + w[codes[:, k]]) ** 2).sum(axis=1)
        return (x**2).sum(axis=1)[:, None] + square - 2 * total


def _hashes(label, vec) -> tuple:
    """Two 64-bit hashes of label and values."""
    return F.xxhash64(label, F.size(vec), vec).alias("h1"), F.xxhash64(F.lit(7), F.reverse(vec), label).alias("h2")


def _rows(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vec, sound): values as they are if they are single or double precision, else as doubles."""
    vec = F.col(f"`{vector_col}`")
    if rows.select(vec).schema[0].dataType.simpleString() not in ("array<float>", "array<double>"):
        vec = F.transform(vec, lambda v: v.cast("double"))
    vec = F.transform(vec, lambda v: v + F.lit(0).cast("float"))  # no negative zeros
    sound = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    id_, label = F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label")
    out = rows.select(id_, label, vec.alias("vec"))
    return out.withColumn("sound", F.coalesce(sound, F.lit(False)) & F.col("id").isNotNull() & F.col("label").isNotNull())


def vector_classes(rows: DataFrame) -> DataFrame:
    """(k, id, size, grp, h1, h2, vec) of each class of equal, valid vectors of one label, stored; k is a number of its own,
    id the least of the class."""
    found = rows.where("sound").groupBy("label", "vec").agg(F.min("id").alias("id"), F.count("*").alias("size"))
    grp = F.xxhash64("label", F.size("vec")).alias("grp")
    return stash(found.select(F.monotonically_increasing_id().alias("k"), "id", "size", grp, *_hashes(F.col("label"), F.col("vec")), "vec"))


def _padded(column, dim: int) -> np.ndarray:
    """Vectors as rows of `dim` columns, of their own precision."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), dim), flat.dtype)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.maximum(np.abs(x).max(axis=1, initial=0), 1e-300)[:, None]  # no overflow in the squares
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]


def _matrix(column, kind, width: int) -> np.ndarray:
    """A binary column of rows of `width` numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _binary(x: np.ndarray) -> pa.Array:
    raw, step = np.ascontiguousarray(x).tobytes(), x.shape[1] * x.itemsize
    ends = np.arange(len(x) + 1, dtype=np.int32) * step
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(raw)])


class _Found:
    """Counts of links by class, and links as stars, of one task; handed on when many."""

    def __init__(self, most: int = 200_000):
        self.most, self.size = most, 0
        self.k, self.n = [], []
        self.a, self.b = [], []

    def add(self, a, size_a, b, size_b) -> None:
        self.k += [a, b]
        self.n += [size_b, size_a]
        x, y = forest(a, b)
        self.a.append(x)
        self.b.append(y)
        self.size += 2 * len(a)

    def batches(self, least: int):
        """(k, links, other, t): sums by k with no other, stars with it."""
        if not self.k or self.size < least:
            return
        k, at = np.unique(np.concatenate(self.k), return_inverse=True)
        n = np.bincount(at, np.concatenate(self.n)).astype(np.int64)
        a, b = forest(np.concatenate(self.a), np.concatenate(self.b))
        yield _row_batch(np.r_[k, a], np.r_[n, np.zeros(len(a), np.int64)], pa.array(np.r_[k, b], mask=np.r_[np.ones(len(k), bool), np.zeros(len(b), bool)]), None)
        self.k, self.n, self.a, self.b, self.size = [], [], [], [], 0


def _row_batch(k, links, other, t) -> pa.RecordBatch:
    t = pa.nulls(len(k), pa.int64()) if t is None else pa.array(np.full(len(k), t, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(links), other, t], names=["k", "links", "other", "t"])


def _runs(batches, keys: list[str]):
    """Slices of the batches in which the key columns are equal, with their values."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edges = np.r_[np.flatnonzero(change), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            yield tuple(int(c[a]) for c in cols), batch.slice(a, b - a)


def links(classes: DataFrame, threshold: float = 0.98, n_lists: int | None = None, n_parts: int = 8, sample_rows: int = 10_000, block: int = 1024) -> DataFrame:
    """(k, links, other) over vector classes, stored: links sums the sizes of classes linked with k as far as one task has
    found them; other is set on rows of the spanning stars."""
    spark = classes.sparkSession
    small_batches(spark)
    n, dim, groups = classes.agg(F.count("*"), F.max(F.size("vec")), F.approx_count_distinct("grp")).first()
    if not n:
        return stash(spark.createDataFrame([], "k long, links long, other long"))
    n_lists = n_lists or max(1, math.isqrt(n // max(1, groups)))
    sample_rows = max(256, min(sample_rows, 4_000_000 // dim), 8 * n_lists)
    # a first cut by a hash, so that no task gets many more rows than the sample has
    few = classes if n <= 2 * sample_rows else classes.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) <= math.ceil((1 << 20) * 1.5 * sample_rows / n))
    few = few.select("k", "vec").orderBy(F.xxhash64("k"), "k").limit(sample_rows).select("vec").toArrow().column(0).combine_chunks()
    fitted = spark.sparkContext.broadcast(Quantiser(_unit(_padded(few, dim)), n_lists, n_parts))  # lists: the root of the rows
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    kind = np.float32 if classes.schema["vec"].dataType.elementType.simpleString() == "float" else np.float64
    parts = len(fitted.value.parts)

    def file(batches):
        q, names = fitted.value, ["k", "size", "grp", "own", "raw", "codes", "error", "away"]
        for big in batches:
            for at in range(0, big.num_rows, 4096):
                batch = big.slice(at, 4096)
                raw = _padded(batch.column("vec"), dim)
                own, codes, error, away = q.file(_unit(raw))
                cols = [pa.array(own, pa.int32()), _binary(raw.astype(kind, copy=False)), _binary(codes), pa.array(error), pa.array(away)]
                yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("size"), batch.column("grp"), *cols], names=names)

    filed = classes.select("k", "size", "grp", "vec").mapInArrow(file, "k long, size long, grp long, own int, raw binary, codes binary, error double, away double")
    filed = stash(filed)
    near, far = np.full(n_lists, np.inf), np.full(n_lists, -np.inf)
    for own, low, high in filed.groupBy("own").agg(F.min("away"), F.max("away")).collect():  # one row for each list
        near[own], far[own] = low, high
    span = spark.sparkContext.broadcast((near, far))
    # lists of more than a block, of one group: the number of their blocks
    large = filed.groupBy("grp", "own").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = large.select("grp", F.col("own").alias("list"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    placed = filed.join(large.withColumnRenamed("list", "own"), ["grp", "own"], "left")
    placed = placed.select("k", "size", "grp", "own", "raw", "codes", "error", F.pmod(F.xxhash64("k"), blocks).cast("int").alias("b"))
    columns = "k long, size long, grp long, own int, raw binary, codes binary, error double, b int"

    def visit(batches):
        q, (low, high) = fitted.value, span.value
        for big in batches:
            for at in range(0, big.num_rows, 2048):
                batch = big.slice(at, 2048)
                own = batch.column("own").to_numpy()
                row, to = np.nonzero(q.probes(_unit(_matrix(batch.column("raw"), kind, dim)), own, reach, low, high))
                out = {c: batch.column(c).take(pa.array(row)) for c in ("k", "size", "grp", "own", "codes", "error", "b")}
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *out.values()], names=["list", *out])

    # roles: 0 the block's own vectors, 1 those of the list's later blocks, 2 visitors with codes only
    own = placed.withColumn("list", F.col("own")).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("b"))))
    own = own.withColumn("role", F.when(F.col("at") == F.col("b"), 0).otherwise(1))
    visits = placed.mapInArrow(visit, "list int, " + columns.replace("raw binary, ", "")).join(large, ["grp", "list"], "left")
    visits = visits.withColumn("at", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("role", F.lit(2)).withColumn("raw", F.lit(None).cast("binary"))
    order = ["grp", "list", "at", "role"]
    rows = [d.select(*order, "k", "size", "own", "b", "raw", "codes", "error") for d in (own, visits)]
    meet = rows[0].unionAll(rows[1]).repartition("grp", "list", "at").sortWithinPartitions(*order)
    pairs = "k long, links long, other long, t long"

    def search(batches):
        q, found, now = fitted.value, _Found(), None
        base: list = []

        def candidates(x, lists, codes, error):
            return np.nonzero(q.distances(x, lists, codes) <= (reach + SLACK + error) ** 2 + SLACK)

        def close(x, k, size, i, y, k2, size2, j):
            hit = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
            i, j = i[hit], j[hit]
            if len(i):
                found.add(k[i], size[i], k2[j], size2[j])

        for key, rows in _runs(batches, order):
            if key[:3] != now:
                now, base = key[:3], []
            k, size = (rows.column(c).to_numpy() for c in ("k", "size"))
            codes, error = _matrix(rows.column("codes"), np.uint8, parts), rows.column("error").to_numpy()
            lists = rows.column("own").to_numpy()
            if key[3] == 0:
                x = _unit(_matrix(rows.column("raw"), kind, dim))
                for x0, k0, size0 in base:  # a block may come in two batches
                    i, j = candidates(x0, lists, codes, error)
                    close(x0, k0, size0, i, x, k, size, j)
                i, j = candidates(x, lists, codes, error)
                close(x, k, size, i[i < j], x, k, size, j[i < j])
                base.append((x, k, size))
                yield from found.batches(found.most)
                continue
            for x0, k0, size0 in base:
                for part in range(0, len(k), 4096):
                    s = slice(part, part + 4096)
                    i, j = candidates(x0, lists[s], codes[s], error[s])
                    if key[3] == 1:
                        y = _unit(_matrix(rows.column("raw").slice(part, 4096), kind, dim))
                        close(x0, k0, size0, i, y, k[s], size[s], j)
                    elif len(i):
                        # both vectors are fetched by the two blocks that they stand in
                        b = rows.column("b").to_numpy()[s]
                        place = lists[s].astype(np.int64) << 32 | b
                        for p in np.unique(place[j]):
                            on = place[j] == p
                            t = hash((now, int(p))) >> 1
                            yield _row_batch(k0[i[on]], np.zeros(on.sum(), np.int64), pa.array(k[s][j[on]]), t)
                    yield from found.batches(found.most)
        yield from found.batches(1)

    met = stash(meet.mapInArrow(search, pairs))
    asked = met.where("t is not null").select("t", F.col("k").alias("a"), F.col("other").alias("b"))
    ends = asked.select("t", F.col("a").alias("k")).unionAll(asked.select("t", F.col("b").alias("k"))).distinct()
    vectors = ends.join(filed.select("k", "size", "raw"), "k").select("t", F.lit(0).alias("role"), "k", "size", F.lit(None).cast("long").alias("other"), "raw")
    wanted = asked.select("t", F.lit(1).alias("role"), F.col("a").alias("k"), F.lit(0).cast("long").alias("size"), F.col("b").alias("other"), F.lit(None).cast("binary").alias("raw"))
    fetched = vectors.unionAll(wanted).repartition("t").sortWithinPartitions("t", "role")

    def compare(batches):
        found, now = _Found(), None
        for key, rows in _runs(batches, ["t", "role"]):
            if key[0] != now:
                now, known = key[0], []
            k = rows.column("k").to_numpy()
            if key[1] == 0:
                known.append((k, rows.column("size").to_numpy(), _unit(_matrix(rows.column("raw"), kind, dim))))
                continue
            if len(known) > 1:
                known = [tuple(np.concatenate(x) for x in zip(*known))]
            ids, size, unit = known[0]
            order_ = np.argsort(ids)
            place = lambda x: order_[np.searchsorted(ids, x, sorter=order_)]  # noqa: B023, E731
            other = rows.column("other").to_numpy()
            for s in range(0, len(k), 16384):
                a, b = place(k[s : s + 16384]), place(other[s : s + 16384])
                hit = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
                if hit.any():
                    found.add(ids[a[hit]], size[a[hit]], ids[b[hit]], size[b[hit]])
            yield from found.batches(found.most)
        yield from found.batches(1)

    out = met.where("t is null").unionAll(fetched.mapInArrow(compare, pairs)).select("k", "links", "other")
    out = stash(out)
    discard(met, filed)
    return out


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, **settings) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    prepared = _rows(rows, id_col, vector_col, label_col)
    classes = vector_classes(prepared)
    found = links(classes, threshold, **settings)
    stars = components(found.where("other is not null").select("k", "other"))
    members = stars.select(F.col("node").alias("k"), "root").unionAll(stars.select(F.col("root").alias("k"), "root").distinct())
    least = members.join(classes.select("k", "id"), "k").groupBy("root").agg(F.min("id").alias("c"))
    counts = found.where("other is null").groupBy("k").agg(F.sum("links").alias("links"))
    # of linked classes, and of those with several rows; a row without either stands alone
    known = counts.join(members.join(least, "root").select("k", "c"), "k")
    known = classes.drop("vec", "grp").join(known, "k", "left").where("size > 1 or c is not null")
    known = stash(known.select("h1", "h2", "size", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n"), F.coalesce("c", "id").alias("c")))
    discard(found, stars, classes)
    total = known.agg(F.sum("size")).first()[0] or 0
    # vectors that many rows share (at most 512 of them) are looked up in a broadcast table, and their rows and those without
    # a vector are dealt by id, so no key is hot in the exchange
    hot = known.where(F.col("size") > max(10_000, total // 512)).select("h1", "h2", F.col("n").alias("hot_n"), F.col("c").alias("hot_c"))
    h1, h2 = (F.when(F.col("sound"), h) for h in _hashes(F.col("label"), F.col("vec")))
    own = prepared.select(F.col("id").alias("vec_id"), h1.alias("h1"), h2.alias("h2"))
    own = own.join(F.broadcast(hot), ["h1", "h2"], "left")
    own = own.withColumn("j1", F.when(F.col("h1").isNotNull() & F.col("hot_n").isNull(), F.col("h1")).otherwise(F.xxhash64("vec_id")))
    own = own.withColumn("j2", F.when(F.col("hot_n").isNull(), F.col("h2"))).drop("h1", "h2")
    out = own.join(known.drop("size"), (F.col("j1") == F.col("h1")) & (F.col("j2") == F.col("h2")), "left")
    component = F.coalesce("hot_c", "c", "vec_id")
    n_links = F.coalesce("hot_n", "n", F.lit(0)).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and class of every vector."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
