"""Suffix-array dedup: common-prefix-aware distributed merge sort.

Every byte covered by a string of `length` bytes that also starts anywhere else is found from a sparse suffix array. Each
window of `length` bytes elects one anchor, the leftmost of its grams with the least hash; equal windows elect the same
one at the same place. A window can repeat only if its anchor's gram does, so grams are counted first, with one row for
each gram and task. The suffixes that start at the remaining anchors are sorted in runs, front-coded (the length of the
prefix shared with the suffix before, and the rest), exchanged by ranges of their first bytes (a range that cannot be cut
further by them is dealt by its grams, so ranges stay as small however much there is), and merged by loser trees
that compare the lengths of known prefixes first and bytes only beyond them. The sorted suffixes with their common
prefixes say which anchors agree to the right as far as a window needs, their reversed left contexts, sorted likewise,
which agree to the left; both together, for every distance between a window's start and its anchor, tell repeated windows.

Texts are known by their XXH64 and length, and equal texts are worked on once in a task. Anchors with equal contexts
within a run are one record that says so.

Defined results: null text counts as empty; texts shorter than `length` have no windows; strings are judged on the input,
overlaps and the same document included; repeated rows repeat each other, so their windows all go; texts of any length are
read whole; an empty table gives an empty result; other columns are kept, and a clash of names with the new ones is avoided
by leading underscores.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import column_name, discard, small_batches, split_by_bloom, stash

LENGTH, GRAM = 200, 64
#: Anchors in one sorted run, and aimed at in one range of the merge.
RUN, RANGE = 60_000, 60_000
PREFIX = 16
_U = np.uint64
_MULTIPLIERS = [_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the gram that starts at each byte (a power of two long), by doubling."""
    h = (data.astype(np.uint64) + _U(1)) * _MULTIPLIERS[0]
    step, k = 1, 0
    while step < gram:
        m = _MULTIPLIERS[k % len(_MULTIPLIERS)]
        h = (h[:-step] ^ (h[:-step] >> _U(29))) * m + h[step:]
        step, k = 2 * step, k + 1
    h ^= h >> _U(32)
    h *= _MULTIPLIERS[1]
    return h ^ (h >> _U(29))


def least_places(order: np.ndarray, width: int) -> np.ndarray:
    """For each start, the leftmost place of the least value among the next `width`."""
    value, place, step = order, np.arange(len(order), dtype=np.int32), 1

    def joined(v, p, s):
        right = v[s:] < v[:-s]
        return np.where(right, v[s:], v[:-s]), np.where(right, p[s:], p[:-s])

    while 2 * step <= width:
        value, place = joined(value, place, step)
        step *= 2
    return joined(value, place, width - step)[1] if width > step else place


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """(text, place, least and greatest distance of a window's start before it, gram hash) of every anchor."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    start = np.cumsum(size) - size
    windows = np.maximum(size - length + 1, 0)
    if not windows.any():
        none = np.empty(0, np.int64)
        return none, none, none, none, np.empty(0, np.uint64)
    hashes = gram_hashes(data, gram)
    elected = least_places((hashes >> _U(32)).astype(np.uint32), length - gram + 1)
    text = np.repeat(np.arange(len(texts)), windows)
    at = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + start[text]
    place = elected[at]
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(place)] - 1
    p, owner = place[first].astype(np.int64), text[first]
    return owner, p - start[owner], p - at[last], p - at[first], hashes[p]


def _pack(place, low, high):
    return place << 16 | low << 8 | high


def _batched(batches, columns, limit=2_000_000):
    """Rows of the given columns, as lists, in groups of about `limit` bytes of the first one."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            for row in zip(*(part.column(k).to_pylist() for k in columns)):
                held.append(row)
                size += len(row[0] or "")
                if size >= limit:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _counted(length, gram):
    """(text, h, n) to one row for each gram of the task with its weight, and one of weight 2 for each further anchor of a
    gram that repeats within the task, under a key of its own."""

    def run(batches):
        copies: dict[tuple[int, int], int] = {}
        keys: list[tuple[int, int]] = []
        found = []
        for rows in _batched(batches, (0, 1, 2)):
            new = []
            for text, h, n in rows:
                if n >= length:
                    copies[h, n] = copies.get((h, n), 0) + 1
                    if copies[h, n] == 1:
                        new.append(text.encode())
                        keys.append((h, n))
            if new:
                owner, place, low, high, key = anchors(new, length, gram)
                found.append((owner + len(keys) - len(new), _pack(place, low, high), key))
        if not found:
            return
        owner, packed, key = (np.concatenate(x) for x in zip(*found))
        weight = np.array([copies[k] for k in keys], np.int64)[owner]
        _, first, group = np.unique(key, return_index=True, return_inverse=True)
        total = np.bincount(group, weight).astype(np.int64)[group]
        lead = np.zeros(len(key), bool)
        lead[first] = True
        keep = np.flatnonzero(lead | (total > 1))
        ref = np.array(keys, np.int64)[owner[keep]]
        own = (key[keep] ^ (ref[:, 0].view(np.uint64) * _MULTIPLIERS[2]) ^ (packed[keep].view(np.uint64) * _MULTIPLIERS[3])).view(np.int64)
        out_key = np.where(lead[keep], key[keep].view(np.int64), own)
        out_weight = np.minimum(total[keep], 2).astype(np.int32)
        for at in range(0, len(keep), 100_000):
            s = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (out_key, out_weight, ref[:, 0], ref[:, 1].astype(np.int32), packed[keep])], names=["key", "weight", "h", "n", "packed"])

    return run


def _repeated(batches):
    """Rows sorted by key: those whose key weighs 2 or more. A key has a row for each task at most."""
    held = None
    for batch in batches:
        part = [batch.column(k).to_numpy() for k in range(5)]
        held = part if held is None else [np.concatenate(x) for x in zip(held, part)]
        if not len(held[0]):
            continue
        cut = int(np.searchsorted(held[0], held[0][-1], "left"))
        yield from _heavy([x[:cut] for x in held])
        held = [x[cut:] for x in held]
    if held is not None:
        yield from _heavy(held)


def _heavy(cols):
    key, weight = cols[0], cols[1]
    if len(key):
        group = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        keep = np.bincount(group, weight)[group] >= 2
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in cols[2:]], names=["h", "n", "packed"])


def front_code(rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Of sorted rows (padded to one width): how much each shares with the one before, and all the rests together."""
    shared = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        shared[1:] = np.minimum(shared[1:], np.minimum(size[1:], size[:-1]))
    col = np.arange(rows.shape[1])
    return shared, rows[(col >= shared[:, None]) & (col < size[:, None])].tobytes()


def _sorted_rows(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order of padded rows, a prefix before what it begins."""
    text = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()
    by_size = np.argsort(size, kind="stable")
    return by_size[np.argsort(text[by_size], kind="stable")]


def _records(texts: list[bytes], refs: np.ndarray, packed: list[np.ndarray], length: int, gram: int) -> dict[str, np.ndarray]:
    """Both contexts of the given anchors: right from the anchor on, left backwards from before it."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    count = np.fromiter(map(len, packed), np.int64, len(packed))
    owner, flat = np.repeat(np.arange(len(texts)), count), np.concatenate(packed)
    place, low, high = flat >> 16, flat >> 8 & 255, flat & 255
    at = place + (np.cumsum(size) - size)[owner]
    right, left = np.arange(length), np.arange(length - gram)
    r = data[np.minimum(at[:, None] + right, len(data) - 1)]
    r[right >= (length - low)[:, None]] = 0
    b = data[np.maximum(at[:, None] - 1 - left, 0)]
    b[left >= high[:, None]] = 0
    return {"r": r, "b": b, "low": low, "high": high, "place": place, "h": refs[owner, 0], "n": refs[owner, 1]}


def bounds(sample: list[bytes], n_ranges: int) -> tuple[list[bytes], list[int]]:
    """Bounds that cut the sorted sample (with repeats) into about n_ranges ranges, and into how many parts each is dealt by
    its grams: a range that cannot be cut, as its suffixes begin alike, or a sample too small for so many bounds."""
    sample = sorted(sample)
    n = max(1, min(n_ranges, len(sample) // 40))
    cuts = sorted({sample[k * len(sample) // n] for k in range(1, n)} - {sample[0]}) if sample else []
    held = np.diff(np.r_[0, np.searchsorted(np.array(sample, f"S{PREFIX}"), np.array(cuts, f"S{PREFIX}")), len(sample)])
    return cuts, [max(1, -(-int(x) * n_ranges // max(1, len(sample)))) for x in held]


def _runs(length, gram, splitters, parts):
    """(text, h, n, anchors) to front-coded runs by range, and rows (h, n, a, b) of windows a..b known to repeat. Suffixes
    whose grams are equal are in one range; no others need to meet."""
    cuts = np.array(splitters, f"S{PREFIX}")
    base, parts = np.cumsum([0, *parts[:-1]]), np.array(parts, np.uint64)
    names = ["range", "run", "seq", "blob", "h", "n", "a", "b"]

    def done(h, n, a, b):
        k = len(h)
        none = lambda t: pa.nulls(k, t)
        return pa.RecordBatch.from_arrays([pa.array(np.full(k, -1, np.int32)), none(pa.int64()), none(pa.int32()), none(pa.binary()), *(pa.array(np.asarray(x, np.int64)) for x in (h, n, a, b))], names=names)

    def flush(held, number):
        cols = {k: np.concatenate([x[k] for x in held]) for k in held[0]}
        order = _sorted_rows(cols["r"], length - cols["low"])
        cols = {k: v[order] for k, v in cols.items()}
        # equal contexts within the run: all their windows repeat, one record stands for them
        whole = np.ascontiguousarray(np.concatenate([cols["r"], cols["b"], cols["low"].astype(np.uint8)[:, None], cols["high"].astype(np.uint8)[:, None]], axis=1))
        whole = whole.view(f"V{whole.shape[1]}").ravel()
        seen: dict[bytes, int] = {}
        stands = np.fromiter((seen.setdefault(x, k) for k, x in enumerate(x.tobytes() for x in whole)), np.int64, len(whole))
        many = np.bincount(stands, cols["many"] + 1, len(whole))[stands] > 1
        if many.any():
            c = {k: cols[k][many] for k in ("h", "n", "place", "low", "high")}
            yield done(c["h"], c["n"], c["place"] - c["high"], c["place"] - c["low"])
        own = stands == np.arange(len(whole))
        cols = {k: v[own] for k, v in cols.items()} | {"many": many[own].astype(np.int64)}
        prefix = np.ascontiguousarray(cols["r"][:, :PREFIX]).view(f"S{PREFIX}").ravel()
        to = np.searchsorted(cuts, prefix, "right")
        word = np.ascontiguousarray(cols["r"][:, :gram]).view(np.uint64) if gram % 8 == 0 else cols["r"][:, :gram].astype(np.uint64)
        mixed = np.zeros(len(word), np.uint64)
        for k in range(word.shape[1]):
            mixed = (mixed ^ (mixed >> _U(29)) ^ word[:, k]) * _MULTIPLIERS[0]
        to = base[to] + ((mixed >> _U(20)) % parts[to]).astype(np.int64)
        order = np.argsort(to, kind="stable")  # each range's suffixes stay sorted
        to, cols = to[order], {k: v[order] for k, v in cols.items()}
        edges = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        press = zstandard.ZstdCompressor(level=1)
        out = []
        for a, b in zip(edges, np.r_[edges[1:], len(to)]):
            part = {k: v[a:b] for k, v in cols.items()}
            shared, rest = front_code(part["r"], length - part["low"])
            col = np.arange(part["b"].shape[1])
            left = part["b"][col < part["high"][:, None]].tobytes()
            numbers = np.stack([shared, part["low"], part["high"], part["many"], part["place"], part["h"], part["n"]]).astype(np.int64)
            blob = press.compress(int(b - a).to_bytes(8, "little") + len(rest).to_bytes(8, "little") + numbers.tobytes() + rest + left)
            out.append((int(to[a]), number, 0, blob))
        k = len(out)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.binary()), *(pa.nulls(k, pa.int64()) for _ in range(4))], names=names)

    def run(batches):
        context = TaskContext.get()
        number, held, count = (context.partitionId() if context else 0) << 24, [], 0
        last, copies = None, 1
        for rows in _batched(batches, (0, 1, 2, 3)):
            once = []
            for text, h, n, packed in rows:  # sorted by text: copies follow each other
                if (h, n) == last:
                    copies += 1
                    if copies == 2:
                        yield done([h], [n], [0], [n - length])
                    continue
                last, copies = (h, n), 1
                once.append((text.encode(), h, n, np.array(packed, np.int64)))
            if not once:
                continue
            for at in range(0, len(once), 256):
                part = once[at : at + 256]
                records = _records([x[0] for x in part], np.array([x[1:3] for x in part], np.int64), [x[3] for x in part], length, gram)
                records["many"] = np.zeros(len(records["h"]), np.int64)
                held.append(records)
                count += len(records["h"])
                if count >= RUN:
                    yield from flush(held, number)
                    number, held, count = number + 1, [], 0
        if held:
            yield from flush(held, number)

    return run


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes need no look."""
    n = min(len(a), len(b))
    while known + 16 <= n and a[known : known + 16] == b[known : known + 16]:
        known += 16
    while known < n and a[known] == b[known]:
        known += 1
    return known


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Sorted runs of strings with the prefix each shares with the one before it, merged by a loser tree.

    Returns (run, index) in order and the prefix shared with the string before. Every player carries the length of its
    common prefix with the last winner: the longer one wins without a look at its bytes; of equal lengths only what
    follows is compared. An ended run counts as -1 and loses always."""
    k = 1
    while k < len(runs):
        k *= 2
    strings = [r[0] for r in runs] + [[]] * (k - len(runs))
    shares = [r[1] for r in runs] + [[]] * (k - len(runs))
    at = [0] * k
    known = [0 if s else -1 for s in strings]
    loser = [0] * k

    def wins(x: int, y: int) -> bool:
        """Whether run x's head comes before run y's; the loser's known prefix becomes that with the winner."""
        if known[x] != known[y]:
            return known[x] > known[y]
        if known[x] < 0:
            return True
        a, b = strings[x][at[x]], strings[y][at[y]]
        h = common(a, b, known[x])
        first = h == len(a) and (h < len(b) or x < y) or h < len(a) and h < len(b) and a[h] < b[h]
        known[y if first else x] = h
        return first

    def build(node: int) -> int:
        if node >= k:
            return node - k
        x, y = build(2 * node), build(2 * node + 1)
        if wins(x, y):
            loser[node] = y
            return x
        loser[node] = x
        return y

    top = build(1) if k > 1 else 0
    out, shared = [], []
    while known[top] >= 0:
        out.append((top, at[top]))
        shared.append(known[top])
        at[top] += 1
        known[top] = shares[top][at[top]] if at[top] < len(strings[top]) else -1
        node = (top + k) >> 1
        while node:
            if not wins(top, loser[node]):
                top, loser[node] = loser[node], top
            node >>= 1
    if shared:
        shared[0] = 0
    return out, shared


def _unpacked(blob: bytes, length: int, gram: int):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    k, size = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:16], "little")
    numbers = np.frombuffer(raw, np.int64, 7 * k, 16).reshape(7, k)
    shared, low, high = numbers[0], numbers[1], numbers[2]
    at, strings, last = 16 + 56 * k, [], b""
    for s, n in zip(shared.tolist(), (length - low).tolist()):
        last = last[:s] + raw[at : at + n - s]
        at += n - s
        strings.append(last)
    left = np.zeros((k, length - gram), np.uint8)
    left[np.arange(length - gram) < high[:, None]] = np.frombuffer(raw, np.uint8, int(high.sum()), 16 + 56 * k + size)
    return strings, shared.tolist(), numbers[1:], left


def repeats(shared: np.ndarray, low, high, many, left: np.ndarray, length: int) -> np.ndarray:
    """(anchors in suffix order, distances): whether the window that starts so far before the anchor repeats."""
    n, width = left.shape
    order = _sorted_rows(left, high)
    rows = left[order]
    differ = rows[1:] != rows[:-1]
    agree = np.zeros(n, np.int64)
    agree[1:] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), width), np.minimum(high[order][1:], high[order][:-1]))
    out = np.zeros((n, width + 1), bool)
    side = np.empty(n, np.int64)
    weight = many + 1
    for d in range(int(low.min()), int(high.max()) + 1):
        on = np.flatnonzero((low <= d) & (d <= high))
        if not len(on):
            continue
        after = np.cumsum(shared < length - d)[on]
        side[order] = np.cumsum(agree < d)
        key = after * (n + 1) + side[on]
        _, group = np.unique(key, return_inverse=True)
        out[on, d] = np.bincount(group, weight[on])[group] > 1
    return out


def _merged(length, gram):
    """Runs sorted by range to rows (h, n, a, b)."""

    def solve(blobs):
        parts = [_unpacked(x, length, gram) for x in blobs]
        order, shared = merge([(p[0], p[1]) for p in parts])
        base = np.cumsum([0, *(len(p[0]) for p in parts)])
        pick = np.fromiter((base[r] + k for r, k in order), np.int64, len(order))
        low, high, many, place, h, n = np.concatenate([p[2] for p in parts], axis=1)[:, pick]
        left = np.concatenate([p[3] for p in parts])[pick]
        shared = np.array(shared)
        # an anchor whose gram no neighbour shares has no repeated window
        close = shared >= gram
        near = (close | np.r_[close[1:], False]) | (many > 0)
        if not near.any():
            return
        group = np.cumsum(~close)
        kept = np.flatnonzero(near)
        # what is left out lies between groups, so that the first of a group shares nothing that counts
        first = np.r_[True, group[kept][1:] != group[kept][:-1]]
        found = repeats(np.where(first, 0, shared[kept]), low[kept], high[kept], many[kept], left[kept], length)
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, begin = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        at = kept[row]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[at], n[at], place[at] - end + 1, place[at] - begin)], names=["h", "n", "a", "b"])

    def run(batches):
        now, blobs = None, []
        for batch in batches:
            for r, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if r != now and blobs:
                    yield from solve(blobs)
                    blobs = []
                now = r
                blobs.append(blob)
        if blobs:
            yield from solve(blobs)

    return run


def _once_or_twice(batches):
    """(text, h, n): of a task's copies of a text the first, and of all the others one row without the text, so that mass copies
    send no more than two rows a task."""
    seen: dict[tuple[int, int], bool] = {}
    for batch in batches:
        keep, bare = [], []
        for k, key in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            if key not in seen:
                seen[key] = False
                keep.append(k)
            elif not seen[key]:
                seen[key] = True
                bare.append(k)
        for rows, with_text in ((keep, True), (bare, False)):
            if rows:
                text, h, n = (batch.column(c).take(pa.array(rows)) for c in range(3))
                yield pa.RecordBatch.from_arrays([text if with_text else pa.nulls(len(rows), pa.string()), h, n], names=["text", "h", "n"])


def windows(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """texts (text, h, n) to (h, n, spans array<struct<a, b>>): starts a..b of windows that repeat, for texts with any."""
    spark = texts.sparkSession
    small_batches(spark)
    counted = texts.where(F.col("n") >= length).mapInArrow(_counted(length, gram), "key long, weight int, h long, n int, packed long")
    held = counted.repartition("key").sortWithinPartitions("key").mapInArrow(_repeated, "h long, n int, packed long").distinct()
    held = stash(held.groupBy("h", "n").agg(F.collect_list("packed").alias("packed")))
    total = held.agg(F.sum(F.size("packed"))).first()[0] or 0
    near, _ = split_by_bloom(texts, "h", held.select("h"))
    # range bounds: first bytes at a bounded sample of anchors
    n_ranges, splitters, parts = max(1, total // RANGE), [], [1]
    if n_ranges > 1:
        few = held.select("h", "n", F.explode("packed").alias("p"))
        most = min(20_000, 40 * n_ranges)
        few = few.where(F.pmod(F.xxhash64("h", "p"), F.lit(1 << 30)) <= int((1 << 30) * 1.5 * most / total)).orderBy(F.xxhash64("h", "p")).limit(most)
        seen = near.join(F.broadcast(few), ["h", "n"]).select("h", "n", "p", F.substring(F.col("text").cast("binary"), F.shiftright("p", 16).cast("int") + 1, PREFIX).alias("s"))
        # of copies of a text one counts
        seen = seen.groupBy("h", "n", "p").agg(F.first("s").alias("s"))
        splitters, parts = bounds([bytes(r[0]).rstrip(b"\0") for r in seen.select("s").collect()], n_ranges)
    few = near.select("text", "h", "n").mapInArrow(_once_or_twice, "text string, h long, n int")
    dealt = few.join(held, ["h", "n"]).select("text", "h", "n", "packed").sortWithinPartitions("h", "n", F.col("text").isNull())
    runs = stash(dealt.mapInArrow(_runs(length, gram, splitters, parts), "range int, run long, seq int, blob binary, h long, n long, a long, b long"))
    merged = runs.where("range >= 0").select("range", "run", "blob").repartition(max(1, sum(parts)), "range").sortWithinPartitions("range", "run")
    found = merged.select("range", "blob").mapInArrow(_merged(length, gram), "h long, n long, a long, b long")
    known = runs.where("range < 0").select("h", "n", "a", "b")
    out = stash(found.unionAll(known).groupBy("h", "n").agg(F.collect_set(F.struct("a", "b")).alias("spans")))
    discard(held, runs)
    return out


def covered(spans, length: int, n: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows that start in the given intervals."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        end = min(b + length, n)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([a, end])
    return [(a, b) for a, b in out]


def _finished(length, with_text, names):
    def run(batches):
        for batch in batches:
            extra = batch.num_columns - 2
            for at in range(0, max(1, batch.num_rows), 128):
                part = batch.slice(at, 128)
                cols = [[], [], [], [], []]
                for text, spans in zip(part.column(extra).to_pylist(), part.column(extra + 1).to_pylist()):
                    raw = (text or "").encode()
                    gone = covered([(s["a"], s["b"]) for s in spans or ()], length, len(raw))
                    left, last = [], 0
                    for a, b in gone:
                        left.append(raw[last:a])
                        last = b
                    rest = b"".join([*left, raw[last:]])
                    for c, v in zip(cols, (len(raw), len(raw) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), rest)):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                made = [pa.array(c, k) for c, k in zip(cols, kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:extra], *(made if with_text else made[:4])], names=names)

    return run


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep: tuple[str, ...] | None = None, with_text: bool = True) -> DataFrame:
    """The kept columns (all by default) with n_bytes, n_removed, n_spans, kept_sha256 and, with_text, the bytes left
    (`kept`: bytes, as cuts may fall within a character)."""
    keep = docs.columns if keep is None else list(keep)
    t = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    text, h, n, spans = (column_name(docs, c) for c in ("_text", "_h", "_n", "_spans"))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], t.alias(text), F.xxhash64(t).alias(h), F.octet_length(t).alias(n))
    found = windows(docs.select(t.alias("text"), F.xxhash64(t).alias("h"), F.octet_length(t).alias("n")), length, gram)
    # texts that surely have no repeats are finished where they are; the others meet their spans
    hit, miss = split_by_bloom(rows, h, found.select("h"))
    kept = [F.col(f"`{c}`") for c in keep]
    clear = miss.select(*kept, text, F.lit(None).cast(found.schema["spans"].dataType).alias(spans))
    its_h, its_n = column_name(docs, "_found_h"), column_name(docs, "_found_n")
    spanned = hit.join(found.toDF(its_h, its_n, spans), (F.col(h) == F.col(its_h)) & (F.col(n) == F.col(its_n)), "left")
    fields = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    names = [column_name(docs.select(*kept), f) for f in fields]
    types = ["long", "long", "long", "string", "binary"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]) + ", " + ", ".join(f"`{a}` {b}" for a, b in zip(names, types))
    return clear.unionAll(spanned.select(*kept, text, spans)).mapInArrow(_finished(length, with_text, [*keep, *names]), schema)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat, and the digest of the rest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return remove_repeats(docs, keep=("doc_id",), with_text=False)
