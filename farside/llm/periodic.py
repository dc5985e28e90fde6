"""Periodic runs of words, by the runs theorem.

A run is a stretch of words with a smallest period q that no neighbouring word extends. The longest Lyndon word that starts
at a place ends before the next place whose suffix is smaller: the next smaller value in the inverse suffix array. Every run
holds, under one of the two orders of the alphabet, such a longest Lyndon word of its period's length, so the Lyndon words of
all places under both orders are all candidates there are. Each is extended to the right by the common prefix of the suffixes
at its start and its end, and to the left by that of the reversed text: least values of the array of common prefixes, found
in a sparse table. What is then long enough is a run, and its period is the smallest, as a Lyndon word has no shorter one.

Many texts share one set of arrays: the symbols of each text are its own, and so is the one it ends in, which is its
least, so nothing is shared between texts and only repeats within a text cost rounds of doubling. A text in which too few
windows of words recur near enough for any run to hold them has none, and skips the arrays.

Defined results: words are maximal stretches of other bytes than ASCII space and \\t to \\r; null and empty texts have no words
and no runs; a repeated row has the same result again; an empty table gives an empty result; other columns come back as they
are, and clashes with new names get leading underscores; texts of any length are worked on whole, in memory of about 300 bytes
a word. In the query a null doc_id has no checksum, so its words stay as they are.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import column_name, small_batches, tidy

#: A run counts from this many words, and this many times its period, on.
LEAST, TIMES = 6, 4
#: Words whose arrays are built together (a longer text is alone).
TOGETHER = 1 << 17
_NONE = np.empty((0, 3), np.int64)


def window(least: int, times: int) -> int:
    """Words that every counted run repeats, from the first Lyndon root in it on, one period later."""
    return min(max(least, times * p) - 2 * p + 1 for p in range(1, max(2, least) + 1))


class Suffixes:
    """Suffix array of symbols by prefix doubling. levels[k] holds ranks by the first 2^k symbols: equal ones are equal
    stretches. Only suffixes that are not alone yet take part in a round."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sa = np.argsort(symbols, kind="stable")
        ordered = symbols[self.sa]
        new = np.r_[True, ordered[1:] != ordered[:-1]]
        at = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, np.int32)
        rank[self.sa] = at
        self.levels = [rank]
        open_ = np.flatnonzero(~(new & np.r_[new[1:], True]))
        step = 1
        while len(open_):
            suffixes = self.sa[open_]
            key = rank[suffixes].astype(np.int64) * n + rank[suffixes + step]
            order = np.argsort(key, kind="stable")
            suffixes, key = suffixes[order], key[order]
            self.sa[open_] = suffixes
            new = np.r_[True, key[1:] != key[:-1]]
            rank = rank.copy()
            rank[suffixes] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
            self.levels.append(rank)
            open_ = open_[~(new & np.r_[new[1:], True])]
            step *= 2
        self.rank = rank

    def prefixes(self) -> np.ndarray:
        """Common prefixes of neighbours in the suffix array (0 for the first)."""
        a, b = self.sa[:-1].copy(), self.sa[1:].copy()
        found = np.zeros(len(a), np.int32)
        near = np.flatnonzero(self.levels[0][a] == self.levels[0][b])
        a, b = a[near], b[near]
        for k in range(len(self.levels) - 1, -1, -1):
            same = np.flatnonzero(self.levels[k][a] == self.levels[k][b])
            found[near[same]] += 1 << k
            a[same] += 1 << k
            b[same] += 1 << k
        return np.r_[np.int32(0), found]

    def table(self) -> None:
        """The sparse table of least common prefixes over stretches of 2^k neighbours."""
        rows = [self.prefixes()]
        while 2 << (len(rows) - 1) <= len(rows[0]):
            half = 1 << (len(rows) - 1)
            rows.append(np.minimum(rows[-1][:-half], rows[-1][half:]))
        self.least = rows

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes a and b (which differ)."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.least[k][low[m]], self.least[k][high[m] - (1 << k) + 1])
        return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value (the length if there is none). A place that looks at a greater value
    may look on from where that one looks, so looks double; the few long rows of greater neighbours are finished one by one."""
    n = len(values)
    ext = np.append(values, -1)
    to = np.append(np.arange(1, n + 1), n)
    open_ = np.flatnonzero(ext[to[:n]] > ext[:n])
    rounds = 0
    while len(open_) and (rounds < 64 or len(open_) > 256):
        to[open_] = to[to[open_]]
        open_ = open_[ext[to[open_]] > ext[open_]]
        rounds += 1
    if len(open_):
        look, v = to.tolist(), ext.tolist()
        for i in reversed(open_.tolist()):  # what lies to the right is finished first
            j = look[i]
            while v[j] > v[i]:
                j = look[j]
            look[i] = to[i] = j
    return to[:n]


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, equal for equal words, texts one after the other; lengths of the texts)."""
    known: dict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    every = itertools.chain.from_iterable(texts)
    return np.fromiter(map(known.__getitem__, every), np.int64, int(sizes.sum())), sizes


def _recurring(words: np.ndarray, sizes: np.ndarray, width: int, times: int) -> np.ndarray:
    """Whether a text can have a run. In a run of period p at least (times - 1) * p - width + 1 windows of `width` words, and
    one at least, recur within p words; so for some distance d, the greatest of these, as many windows as that bound says for
    d recur within d. A chance equality of hashes only means more work."""
    out = np.zeros(len(sizes), bool)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    n = len(words) - width + 1
    if n < 2:
        return out
    h = owner[:n].astype(np.uint64)
    for k in range(width):
        h = (h ^ h >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n].astype(np.uint64)
    at = np.flatnonzero(owner[:n] == owner[width - 1 :])
    h = h[at]
    ordered = np.sort(h)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return out
    again = twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
    h, at = h[again], at[again]
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    next_ = np.flatnonzero(h[1:] == h[:-1])
    distance, text = at[next_ + 1] - at[next_], owner[at[next_]]
    order = np.lexsort((distance, text))
    distance, text = distance[order], text[order]
    within = np.arange(len(text)) - np.searchsorted(text, text) + 1
    out[text[within >= (times - 1) * distance - width + 1]] = True
    return out


def runs_of(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """For each text its runs as rows (start, length, period), by start, then period."""
    out = [_NONE] * len(texts)
    if not texts:
        return out
    words, sizes = _numbered(texts)
    width = window(least, times)
    chosen = np.flatnonzero(_recurring(words, sizes, width, times))
    if len(chosen):
        begin = np.cumsum(sizes) - sizes
        found = _runs([words[begin[k] : begin[k] + sizes[k]] for k in chosen], width.bit_length() - 1, least, times)
        for k, runs in zip(chosen, found):
            out[k] = runs
    return out


def _runs(texts: list[np.ndarray], level: int, least: int, times: int) -> list[np.ndarray]:
    """Runs of texts that are all in one set of arrays. A run repeats at least 2^level words from its first root on."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    last = first + sizes
    words = np.zeros(len(owner), np.int64)
    inner = np.ones(len(owner), bool)
    inner[last] = False
    words[inner] = np.concatenate(texts)
    span = int(words.max()) + 2
    up, down = owner * span, owner * span  # the end of a text is less than all its words under both orders
    up[inner] += 1 + words[inner]
    down[inner] += span - 1 - words[inner]
    forward = Suffixes(up)
    if level >= len(forward.levels):
        return [_NONE] * len(texts)
    found = []
    for rank in (forward.rank, Suffixes(down).rank):
        end = next_smaller(rank)
        at = np.flatnonzero(inner & (end <= last[owner]))
        to = end[at]
        same = forward.levels[level][at] == forward.levels[level][to]  # else the root's neighbour is no repeat of it
        found.append(np.stack([at[same], to[same]]))
    at, to = np.unique(np.concatenate(found, axis=1), axis=1)
    if not len(at):
        return [_NONE] * len(texts)
    forward.table()
    n, period = len(owner), to - at
    end = to + forward.common(at, to)
    del forward
    backward = Suffixes(np.append(up[:-1][::-1], up[-1]))
    backward.table()
    start = at.copy()
    inside = at > first[owner[at]]
    start[inside] -= backward.common(n - 1 - at[inside], n - 1 - to[inside])
    length = end - start
    good = length >= np.maximum(least, times * period)
    rows = np.unique(np.stack([start[good], period[good], length[good]], axis=1), axis=0)
    cuts = np.searchsorted(rows[:, 0], first[1:])
    rows[:, 0] -= first[owner[rows[:, 0]]]
    return np.split(rows[:, [0, 2, 1]], cuts)


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Words outside of all runs, or within the first period of each run they are in."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _groups(texts, words):
    """Stretches (from, to, words of each) of a column of texts, of about TOGETHER words; words: (place, text) to words."""
    begin, held, size = 0, [], 0
    for k in range(len(texts)):
        held.append(words(k, texts[k].as_py()))
        size += len(held[-1]) + 1
        if size >= TOGETHER:
            yield begin, k + 1, held
            begin, held, size = k + 1, [], 0
    if held:
        yield begin, len(texts), held


RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)


def collapse(docs: DataFrame, text_col: str = "text", runs_col: str = "runs", collapsed_col: str = "collapsed", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with two columns behind the others: the runs of each text, and its words joined by one space without those that
    repeat a run's first period."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    new = T.StructField(column_name(docs, runs_col), RUNS), T.StructField(column_name(docs, collapsed_col), T.StringType())
    out = T.StructType([*docs.schema.fields, *new])

    def run(batches):
        for batch in batches:
            for a, b, held in _groups(batch.column(at), lambda _, t: words_of(t)):
                found = runs_of(held, least, times)
                ends = pa.array(np.r_[0, np.cumsum([len(r) for r in found])], pa.int32())
                rows = np.concatenate([_NONE, *found])
                items = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], names=["start", "length", "period"])
                texts = pa.array([b" ".join(kept_words(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(held, found)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.ListArray.from_arrays(ends, items), texts], names=out.names)

    return docs.mapInArrow(tidy(run), out)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The query's input: one text in ten gets a tail that repeats with a period, both told by the id's checksum."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % len(words)
    period = 1 + (len(words) - a) // (3 + g % 8)
    tail = words[a : a + period]
    return words[:a] + (tail * (len(words) // period + 1))[: len(words) - a]


#: What the query returns behind doc_id.
DIGEST = (("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()))


def _summary(words: list[bytes], runs: np.ndarray) -> tuple:
    rows = runs.tolist()
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in rows)
    longest = min(rows, key=lambda r: (-r[1], r[0], r[2]), default=None)
    best = (*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4
    return len(rows), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept_words(words, runs))).hexdigest()


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the number of runs in planted() texts, the longest of them, and digests of all runs and the collapsed text."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    names = ["doc_id", *(n for n, _ in DIGEST)]
    kinds = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, held in _groups(batch.column(1), lambda k, t: planted(words_of(t), ids[k])):
                found = [_summary(w, r) for w, r in zip(held, runs_of(held))]
                columns = [pa.array(list(c), kind) for c, (_, kind) in zip(zip(*found), DIGEST)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=names)

    return rows.mapInArrow(tidy(run), kinds)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
