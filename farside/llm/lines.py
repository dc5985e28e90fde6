"""Line dedup: fuzzy lines by MinHash.

A line is the set of its character shingles. Its signature comes from one hash of each shingle: the hash picks one of
bands * rows bins and each bin keeps its least value; empty bins take the value of a bin chosen by a fixed sequence. Lines
that agree on all rows of a band meet in a bucket, equal buckets of several bands are one task, and there the exact Jaccard
similarity of the shingle sets decides; pairs that are already connected need no comparison, so a task hands on a
spanning forest. The lines of a bucket of over MANY are grouped around pivots, and one of over SHARD is dealt in shards
first; the pivots of all its shards meet, and only groups that may still hold a link meet as a whole, so not all pairs are
made. A
distributed union-find makes components, of which the first line, by document id and place, stays.

With 16 bands of 6 rows a pair at the threshold of 0.8 shares a bucket with probability 0.99, one at 0.9 with 0.9999.
Lines are known by 64-bit hashes (XXH64, seed 42) of their text.

Defined results: null and empty texts stay as they are; lines of white space only stay and are never compared; lines
shorter than a shingle are one shingle; a null id sorts before all others; of rows with equal id and text one
counts as the first, the others keep nothing of what it holds; an empty table gives an empty result; other columns are kept by dedup().
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import bloom_bits, bloom_has, column_name, components, discard, hot_join, small_batches, split_by_bloom, stash, tidy

SHINGLE, BANDS, ROWS, THRESHOLD, SHARD, MANY = 5, 16, 6, 0.8, 2048, 32
TASKS = "task long, lead long, h long, size int"
SET_BYTES = 32 << 20
_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _ODD[1]
    x = (x ^ (x >> _U(27))) * _ODD[2]
    return x ^ (x >> _U(31))


def _choices(bins: int, tries: int = 24) -> np.ndarray:
    """For each bin the bins it borrows from, in order."""
    at = np.arange(bins, dtype=np.uint64)[:, None] * _U(1 << 20) + np.arange(1, tries + 1, dtype=np.uint64)
    return (_mixed(at * _ODD[0]) % _U(bins)).astype(np.int64)


def signatures(lines: list[str], bins: int, shingle: int = SHINGLE) -> np.ndarray:
    """Least hash in each bin, of every line (n, bins)."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    hashes = np.zeros(len(codes), np.uint64)
    for k in range(min(shingle, len(codes))):
        head = hashes[: len(codes) - k]
        head *= _ODD[0]
        head += codes[k:]
        head += _U(1)
    end = np.cumsum(size)
    short = np.flatnonzero((size > 0) & (size < shingle))
    for i in short:  # the whole line is its only shingle
        hashes[end[i] - size[i]] = xxhash.xxh64_intdigest(lines[i].encode())
    hashes ^= hashes >> _U(31)
    hashes *= _ODD[1]
    hashes ^= hashes >> _U(29)
    value = hashes.astype(np.uint32) & np.uint32(0xFFFFFFFE)
    for k in range(1, shingle):  # a shingle does not reach into the next line
        value[end[size >= k] - k] = 0xFFFFFFFF
    value[(end - size)[short]] = hashes[(end - size)[short]].astype(np.uint32) & np.uint32(0xFFFFFFFE)
    hashes >>= _U(32)
    hashes *= _U(bins)
    hashes >>= _U(32)
    place = hashes.view(np.int64) + np.repeat(np.arange(len(lines)) * bins, size)
    out = np.full(len(lines) * bins, 0xFFFFFFFF, np.uint32)
    np.minimum.at(out, place, value)
    out = out.reshape(-1, bins)
    filled = out != 0xFFFFFFFF
    whole, choice = out.copy(), _choices(bins)
    row, col = np.nonzero(~filled)
    for k in range(choice.shape[1]):
        source = choice[col, k]
        ok = filled[row, source]
        whole[row[ok], col[ok]] = out[row[ok], source[ok]]
        row, col = row[~ok], col[~ok]
        if not len(row):
            break
    for k in range(1, bins):  # very few shingles: the next filled bin around
        if not len(row):
            break
        source = (col + k) % bins
        ok = filled[row, source]
        whole[row[ok], col[ok]] = out[row[ok], source[ok]]
        row, col = row[~ok], col[~ok]
    return whole


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """(n, bands) 64-bit keys."""
    parts = sig.reshape(len(sig), bands, -1).astype(np.uint64)
    out = np.tile((np.arange(bands, dtype=np.uint64) + _U(1)) * _ODD[0], (len(sig), 1))
    for k in range(parts.shape[2]):
        out = _mixed((out ^ parts[:, :, k]) * _ODD[1] + _ODD[0])
    return out


def _banded(bands, rows, shingle):
    def run(batches):
        seen: set[int] = set()  # lines of this task: each is banded once

        def emit(lines, ids):
            keys = band_keys(signatures(lines, bands * rows, shingle), bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(np.array(ids, np.uint64).view(np.int64), bands))], names=["key", "h"])

        lines, ids, chars = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for text in batch.column(0).slice(at, 64).to_pylist():
                    for line in (text or "").split("\n"):
                        h = xxhash.xxh64_intdigest(line.encode(), 42)
                        if h not in seen and comparable(line):
                            seen.add(h)
                            lines.append(line)
                            ids.append(h)
                            chars += len(line)
                            if chars > 400_000:
                                yield from emit(lines, ids)
                                lines, ids, chars = [], [], 0
        if lines:
            yield from emit(lines, ids)

    return run


def _buckets(batches):
    """(key, h) of one partition by key to (task, lead, h, size): members of each bucket with two lines or more, the least
    of them and their number. Sorted here, at 16 bytes a row of the partition. Equal buckets of one partition are one task;
    large ones go out in pieces."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    key, h = (np.concatenate(x) for x in zip(*parts))
    del parts
    order = np.argsort(key, kind="stable")
    key, h = key[order], h[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    size = np.diff(np.r_[start, len(key)])
    seen: set[int] = set()
    found: list[tuple[int, np.ndarray]] = []
    held = 0

    def emit():
        sizes = [len(m) for _, m in found]
        cols = [np.repeat(np.array(x, np.int64), sizes) for x in ([t for t, _ in found], [m[0] for _, m in found])]
        members = np.concatenate([m for _, m in found])
        for at in range(0, len(members), 100_000):
            s = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (*cols, members, np.repeat(np.array(sizes, np.int32), sizes))], names=["task", "lead", "h", "size"])

    # one line that several tasks have banded makes no bucket
    many = np.minimum.reduceat(h, start) != np.maximum.reduceat(h, start) if len(h) else size > 1
    for a, n in zip(start[many], size[many]):
        members = np.unique(h[a : a + n])
        mark = int(xxhash.xxh64_intdigest(members.tobytes())) >> 1
        if mark not in seen:
            seen.add(mark)
            found.append((mark, members))
            held += len(members)
        if held >= 4096:
            yield from emit()
            found, held = [], 0
    if found:
        yield from emit()


def shingles(line: str, n: int = SHINGLE) -> set[str]:
    return {line[k : k + n] for k in range(max(1, len(line) - n + 1))}


class Shingles:
    """The shingle set of a line: of characters below 4096, each packed into 12 bits, a sorted array at 8 bytes a shingle
    (very long lines come in buckets too), else a Python set."""

    def __init__(self, line: str, n: int):
        codes = np.frombuffer(line.encode("utf-32-le"), np.uint32)
        self.packed = n <= 5 and len(codes) >= n and int(codes.max()) < 4096
        if self.packed:
            key = np.zeros(len(codes) - n + 1, np.uint64)
            for k in range(n):
                key <<= _U(12)
                key |= codes[k : len(key) + k]
            self.items = np.unique(key)
        else:
            self.items = shingles(line, n)
        self.line, self.n = line, n

    def __len__(self) -> int:
        return len(self.items)

    def shared(self, other: Shingles) -> int:
        if self.packed and other.packed:
            both = np.concatenate([self.items, other.items])
            both.sort(kind="stable")  # two sorted runs
            return int(np.count_nonzero(both[1:] == both[:-1]))
        return len(shingles(self.line, self.n) & shingles(other.line, other.n))


class Links:
    """Union-find over lines of one Spark task: pairs that it knows as connected are not compared again, so all buckets
    together hand on a forest. Its size is bounded by the task's lines."""

    def __init__(self, threshold: float, shingle: int = SHINGLE):
        self.threshold, self.shingle = threshold, shingle
        self.root: dict[int, int] = {}
        self.sets: dict[int, Shingles] = {}  # of lines seen lately, up to SET_BYTES
        self.size = 0
        self.found: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        root = self.root
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    def joined(self, a: int, b: int) -> bool:
        """Whether both are connected; from now on they are."""
        x, y = self.find(a), self.find(b)
        self.root[y] = x
        return x == y

    def shingles(self, h: int, line: str) -> Shingles:
        found = self.sets.get(h)
        if found is None:
            if self.size > SET_BYTES:
                self.sets, self.size = {}, 0
            found = self.sets[h] = Shingles(line, self.shingle)
            self.size += len(line) * (8 if found.packed else 120)
        return found

    def bucket(self, lines: list[tuple[int, str]]) -> None:
        """Compare the members of one bucket: many are grouped around pivots, of few all pairs are looked at."""
        share = self.threshold
        if len(lines) > MANY:
            groups = Groups(share)
            for h, line in lines:
                groups.add(h, self.shingles(h, line))
            self.found += [(a, b) for a, b in groups.links if not self.joined(a, b)]
            return
        for i in range(len(lines)):
            for j in range(i + 1, len(lines)):
                x, y = self.find(lines[i][0]), self.find(lines[j][0])
                if x == y:
                    continue
                p, q = self.shingles(*lines[i]), self.shingles(*lines[j])
                if min(len(p), len(q)) < share * max(len(p), len(q)):
                    continue  # sizes alone rule the pair out
                both = p.shared(q)
                if both >= share * (len(p) + len(q) - both):
                    self.root[y] = x
                    self.found.append((lines[i][0], lines[j][0]))


def _verify(threshold, shingle):
    def run(batches):
        links, task, members = Links(threshold, shingle), None, []

        def emit():
            if links.found:
                a, b = (pa.array([x[k] for x in links.found], pa.int64()) for k in (0, 1))
                links.found = []
                yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for t, h, line in zip(*(part.column(k).to_pylist() for k in range(3))):
                    if t != task:
                        links.bucket(members)
                        task, members = t, []
                    members.append((h, line))
                if len(links.found) > 10_000:
                    yield from emit()
        links.bucket(members)
        yield from emit()

    return run


class Groups:
    """Lines of one large bucket, each in a group around a pivot whose distance (1 less the similarity) it knows. Distances
    of this kind obey the triangle inequality, so a line whose distance to a pivot exceeds the group's radius by more than
    a link's is linked with none of the group, and of the others only lines with nearly its own distance can be linked
    with it. Groups known as connected are not compared again. Nothing is left out: of lines that are linked all end up
    in connected groups."""

    def __init__(self, threshold: float):
        self.reach = 1 - threshold
        self.groups: list[tuple[int, object, list[tuple[int, object, float]]]] = []  # pivot, its set, members
        self.radius: list[float] = []
        self.root: list[int] = []
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = x = self.root[self.root[x]]
        return x

    def distance(self, a, b) -> float:
        both = a.shared(b)
        return 1 - both / (len(a) + len(b) - both)

    def add(self, h: int, item) -> None:
        """item: the line's set, with a length and shared(other)."""
        own = -1
        for g, (pivot, pivots, members) in enumerate(self.groups):
            if own >= 0 and self.find(g) == self.find(own):
                continue
            d = self.distance(item, pivots)
            hit = pivot if d <= self.reach + EPS else None
            if hit is None and d <= self.reach + self.radius[g] + EPS:
                near = (m for m in members if abs(m[2] - d) <= self.reach + EPS)
                hit = next((m[0] for m in near if self.distance(item, m[1]) <= self.reach + EPS), None)
            if hit is None:
                continue
            self.links.append((h, hit))
            if own < 0:
                own = g
                members.append((h, item, d))
                self.radius[g] = max(self.radius[g], d)
            else:
                self.root[max(self.find(g), self.find(own))] = min(self.find(g), self.find(own))
        if own < 0:
            self.groups.append((h, item, []))
            self.radius.append(0.0)
            self.root.append(len(self.groups) - 1)


#: Distances are compared with this much to spare; links are judged by similarity itself.
EPS = 1e-12
_NAMES = ["kind", "task", "a", "b", "d"]
_KINDS = "kind int, task long, a long, b long, d double"


def _sections(batches, keys: int):
    """Rows of the batches, a few at a time, as ((key values), rest)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            for row in zip(*(batch.slice(at, 512).column(k).to_pylist() for k in range(batch.num_columns))):
                yield row[:keys], row[keys:]


def _emitted(rows):
    cols = list(zip(*rows))
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=_NAMES)


def _grouped(threshold, make):
    """(task, shard, h, line) to links (kind 0), groups (1: pivot, its first connected pivot, radius) and members (2: pivot,
    line, distance)."""

    def done(task, found):
        rows = [(0, task, a, b, 0.0) for a, b in found.links]
        for g, (pivot, _, members) in enumerate(found.groups):
            rows.append((1, task, pivot, found.groups[found.find(g)][0], found.radius[g]))
            rows += [(2, task, pivot, pivot, 0.0), *((2, task, pivot, h, d) for h, _, d in members)]
        for k in range(0, len(rows), 20_000):
            yield _emitted(rows[k : k + 20_000])

    def run(batches):
        now, found = None, None
        for key, (h, line) in _sections(batches, 2):
            if key != now:
                if found:
                    yield from done(now[0], found)
                now, found = key, Groups(threshold)
            found.add(h, make(line))
        if found:
            yield from done(now[0], found)

    return run


def _pivots(threshold, make):
    """(task, pivot, connected pivot, radius, line) of all groups of a bucket to links (0) and pairs of groups that may hold
    one (3), as far as they are not connected otherwise."""

    def solve(task, rows):
        at = {p: k for k, (p, *_) in enumerate(rows)}
        root = list(range(len(rows)))
        sets, judge = [make(line) for *_, line in rows], Groups(threshold)

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for k, (_, other, _, _) in enumerate(rows):
            root[find(k)] = find(at[other])
        links, open_ = [], []
        for i, (p, _, r, _) in enumerate(rows):
            for j in range(i):
                if find(i) != find(j):
                    d = judge.distance(sets[i], sets[j])
                    if d <= judge.reach + EPS:
                        root[find(i)] = find(j)
                        links.append((0, task, p, rows[j][0], d))
                    elif d <= judge.reach + r + rows[j][2] + EPS:
                        open_.append((i, j, d))
        links += [(3, task, rows[i][0], rows[j][0], d) for i, j, d in open_ if find(i) != find(j)]
        for k in range(0, len(links), 20_000):
            yield _emitted(links[k : k + 20_000])

    def run(batches):
        now, rows = None, []
        for (task,), rest in _sections(batches, 1):
            if task != now and rows:
                yield from solve(now, rows)
                rows = []
            now = task
            rows.append(rest)
        if rows:
            yield from solve(now, rows)

    return run


def _between(threshold, make):
    """(pair, side, h, line) to one link (0) between the two sides, if there is any."""

    def solve(sides):
        judge = Groups(threshold)
        left, right = ([(h, make(line)) for h, line in side] for side in sides)
        for h, a in left:
            for g, b in right:
                if judge.distance(a, b) <= judge.reach + EPS:
                    yield _emitted([(0, 0, h, g, 0.0)])
                    return

    def run(batches):
        now, sides = None, ([], [])
        for (pair,), (side, h, line) in _sections(batches, 1):
            if pair != now:
                yield from solve(sides)
                now, sides = pair, ([], [])
            sides[side].append((h, line))
        yield from solve(sides)

    return run


def large_links(tasks: DataFrame, lines: DataFrame, threshold: float, make, shard: int = SHARD) -> DataFrame:
    """Links of buckets of more than a shard, without all their pairs: members are dealt in shards and grouped there, the
    groups' pivots of a bucket meet, and only groups that may hold a link and are not connected by then meet as a whole.
    Buckets with the same least line (mostly those of several bands of one cluster) count as one. tasks: (lead, h), stored;
    lines: (h, line), stored."""
    tasks = tasks.select(F.col("lead").alias("task"), "h").distinct()
    tasks = tasks.join(tasks.groupBy("task").agg(F.count("*").alias("size")), "task")
    dealt = tasks.withColumn("shard", F.pmod(F.xxhash64("h"), F.ceil(F.col("size") / shard)).cast("int")).join(lines, "h")
    dealt = dealt.repartition("task", "shard").sortWithinPartitions("task", "shard", "h").select("task", "shard", "h", "line")
    found = stash(dealt.mapInArrow(tidy(_grouped(threshold, make)), _KINDS))
    groups = found.where("kind = 1").join(lines.withColumnRenamed("h", "a"), "a")
    met = groups.repartition("task").sortWithinPartitions("task", "a").select("task", "a", "b", "d", "line")
    met = stash(met.mapInArrow(tidy(_pivots(threshold, make)), _KINDS))
    pairs = met.where("kind = 3").select("task", F.xxhash64("task", "a", "b").alias("pair"), "a", "b")
    ends = pairs.select("task", "pair", F.lit(0).alias("side"), "a").unionAll(pairs.select("task", "pair", F.lit(1).alias("side"), F.col("b").alias("a")))
    members = found.where("kind = 2").select("task", "a", F.col("b").alias("h"))
    sides = ends.join(members, ["task", "a"]).join(lines, "h").repartition("pair").sortWithinPartitions("pair", "side", "h")
    last = sides.select("pair", "side", "h", "line").mapInArrow(tidy(_between(threshold, make)), _KINDS)
    return found.unionAll(met).unionAll(last).where("kind = 0").select("a", "b")


def comparable(line: str) -> bool:
    return bool(line.strip(" \t\r\v\f"))


def _wanted(bits: np.ndarray):
    """(text) to (h, line): lines whose hash may be among those wanted, each once a task."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                lines = [x for text in batch.column(0).slice(at, 256).to_pylist() for x in (text or "").split("\n")]
                hashes = np.fromiter((xxhash.xxh64_intdigest(x.encode(), 42) for x in lines), np.uint64, len(lines))
                ids, found = [], []
                for k in np.flatnonzero(bloom_has(bits, hashes)):
                    if (h := int(hashes[k])) not in seen and comparable(lines[k]):
                        seen.add(h)
                        ids.append(h)
                        found.append(lines[k])
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(found, pa.string())], names=["h", "line"])

    return run


def _occurrences(batches):
    """(i, t, text) to (i, t, pos, h) of every line that can be compared."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            row, pos, ids = [], [], []
            for k, text in enumerate(part.column(2).to_pylist()):
                for place, line in enumerate((text or "").split("\n")):
                    if comparable(line):
                        row.append(k)
                        pos.append(place)
                        ids.append(xxhash.xxh64_intdigest(line.encode(), 42))
            row = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(pos, pa.int32()), pa.array(np.array(ids, np.uint64).view(np.int64))], names=["i", "t", "pos", "h"])


def link(
    docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, shard: int = SHARD
) -> DataFrame:
    """Links (a, b: line hashes) whose similarity is verified, stored; a spanning forest of each task's."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    keyed = texts.mapInArrow(tidy(_banded(bands, rows, shingle)), "key long, h long")
    tasks = stash(keyed.repartition("key").mapInArrow(tidy(_buckets), TASKS).distinct())
    bits = bloom_bits(tasks.select("h"))
    near = texts.mapInArrow(tidy(_wanted(bits)), "h long, line string").groupBy("h").agg(F.first("line").alias("line"))
    large = tasks.where(F.col("size") > shard)
    some = not large.isEmpty()
    near = stash(near) if some else near
    # buckets with the same least line lie together, in four shares as a large cluster has many: most of a cluster meets in
    # few tasks, and what one of them has connected need not be compared again there
    share = F.pmod(F.col("task"), F.lit(4))
    dealt = tasks.where(F.col("size") <= shard).join(near, "h").repartition("lead", share)
    dealt = dealt.sortWithinPartitions("lead", "task", "h").select("task", "h", "line")
    found = dealt.mapInArrow(tidy(_verify(threshold, shingle)), "a long, b long")
    if some:
        found = found.unionAll(large_links(large.select("lead", "h"), near, threshold, functools.partial(Shingles, n=shingle), shard))
    found = stash(found)
    discard(tasks, near)
    return found


def removals(docs: DataFrame, id_col: str, text_col: str, **settings) -> DataFrame:
    """(i, t, copies, removed array<int>, firsts array<int>) of the documents that lose lines, by id and hash of the text:
    how many rows have both, the places of the lines that go from all of these rows, and of those that only the first of
    them keeps."""
    found = link(docs, text_col, **settings)
    roots = components(found)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.xxhash64(text).alias("t"), text.alias("text")).mapInArrow(tidy(_occurrences), "i long, t long, pos int, h long")
    lines = stash(rows.join(roots, F.col("h") == F.col("node"), "left").select("i", "t", "pos", F.coalesce("root", "h").alias("root")))
    kept = lines.groupBy("root").agg(F.min(F.struct("i", "t", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    kept = stash(kept)
    first = F.struct("i", "t", "pos").eqNullSafe(F.col("first"))
    gone = hot_join(lines, kept, "root", "n").select("i", "t", F.when(~first, F.col("pos")).alias("later"), F.when(first, F.col("pos")).alias("own"))
    places = [F.sort_array(F.collect_set(c)).alias(name) for c, name in (("later", "removed"), ("own", "firsts"))]
    gone = gone.groupBy("i", "t").agg(F.count("*").alias("n"), *places)
    # rows of the same id and text bring each of their places once
    gone = gone.withColumn("copies", F.expr("n div (size(removed) + size(firsts))")).where("copies > 1 or size(removed) > 0")
    out = stash(gone.select("i", "t", "copies", "removed", "firsts"))
    discard(lines, kept, found, roots)
    return out


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> tuple[DataFrame, str]:
    """docs with the removed lines' places (null: none) behind the other columns, and that column's name."""
    removed = column_name(docs, "removed")
    key, id_, gone, copies, all_, its, salt, rank, rank2 = (column_name(docs, c) for c in ("_line_key", "_line_hash", "_gone", "_copies", "_own", "_its_key", "_salt", "_rank", "_rank_of_ranks"))
    found = removals(docs, id_col, text_col, **settings)
    own = [F.col(f"`{c}`") for c in docs.columns]
    same = lambda a, b: F.struct(a.alias("i"), b.alias("t"))
    keyed = docs.withColumn(key, same(F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))))
    keyed = keyed.withColumn(id_, F.xxhash64(key))
    # rows that surely lose no line stay where they are
    hit, miss = split_by_bloom(keyed, id_, found.select(F.xxhash64(same(F.col("i"), F.col("t"))).alias("id")))
    found = found.select(same(F.col("i"), F.col("t")).alias(its), F.col("copies").alias(copies), F.col("removed").alias(gone), F.col("firsts").alias(all_))
    # one row a document on the build side, so texts need no sorting
    joined = hit.join(found.hint("shuffle_hash"), hit[key] == found[its], "left")
    single = joined.where(F.coalesce(F.col(copies), F.lit(1)) == 1).select(*own, F.when(F.size(gone) > 0, F.col(gone)).alias(removed))
    # of repeated rows one is the first: they are counted in shares, then one for each share is
    many = joined.where(F.col(copies) > 1).withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    many = many.withColumn(rank, F.row_number().over(Window.partitionBy(key, salt).orderBy(id_)))
    share = F.when(F.col(rank) == 1, F.lit(-1)).otherwise(F.col(salt))
    many = many.withColumn(rank2, F.row_number().over(Window.partitionBy(key, share).orderBy(rank)))
    first = (F.col(rank) == 1) & (F.col(rank2) == 1)
    lost = F.when(first, F.col(gone)).otherwise(F.sort_array(F.array_union(gone, all_)))
    many = many.select(*own, F.when(F.size(lost) > 0, lost).alias(removed))
    return single.unionAll(many).unionAll(miss.select(*own, F.lit(None).cast("array<int>").alias(removed))), removed


def _rest(text, removed: str):
    """text without the removed lines. The split lines are bound once by the outer transform; named within the inner one
    they would be split anew for every line."""
    gone = F.col(removed)
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    rest = F.transform(F.array(F.split(text.cast("string"), "\n", -1)), lambda lines: F.array_join(F.transform(left(lines), lambda k: F.get(lines, k)), "\n"))
    return F.when(gone.isNull(), text.cast("string")).otherwise(rest[0])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False, **settings) -> DataFrame:
    """docs with one line of each component left, where it comes first. drop_emptied: without the documents that lost
    lines and have only white space left."""
    out, removed = marked(docs, id_col, text_col, **settings)
    rest = _rest(F.col(f"`{text_col}`"), removed)
    if drop_emptied:
        out = out.where(F.col(removed).isNull() | rest.rlike(r"[^\s]"))
    return out.select(*[rest.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Of every document: its lines, those removed, and the digest of the rest."""
    rows, removed = marked(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    gone, none = F.col(removed), F.col(removed).isNull()
    return rows.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.when(none, 0).otherwise(F.size(gone)).cast("long").alias("n_removed"),
        F.coalesce(gone, F.array().cast("array<int>")).alias("removed"),
        F.sha2(F.coalesce(_rest(F.col("text"), removed), F.lit("")), 256).alias("kept_sha256"),
    )
