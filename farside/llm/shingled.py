"""Links between documents whose sets of word shingles are similar: banded MinHash, exact Jaccard.

A document is the set of the 64-bit hashes of its runs of `words` words (bytes, A-Z lowered). Documents that agree on all
rows of a band meet in a bucket, and there the exact similarity of the sets decides. With 20 bands of 5 rows a pair at the
threshold of 0.8 shares a bucket with probability 0.9996. Buckets are cut, deduplicated and dealt as those of lines.

Defined results: a document with fewer words than a shingle is one shingle; one without words has no links; documents of
equal words are one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lines import TASKS, Groups, _buckets, band_keys, large_links
from .util import bloom_bits, bloom_has, discard, stash, tidy

WORDS, THRESHOLD, BANDS, ROWS, SHARD, MANY = 5, 0.8, 20, 5, 512, 32
_U = np.uint64
_TURNS = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_TURNS[1] |= _U(1)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def node_of(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), 42)


def shingle_set(words: list[bytes], n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(n, len(one))
    out = np.zeros(len(one) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ (out >> _U(29))) * _U(0x9E3779B97F4A7C15) + one[k : k + len(out)]
    return np.unique(out)


def keys_of(shingles: np.ndarray) -> np.ndarray:
    """The band keys of one set; none of an empty one."""
    if not len(shingles):
        return np.empty(0, np.uint64)
    least = np.full(BANDS * ROWS, ~_U(0), np.uint64)
    for at in range(0, len(shingles), 1024):
        part = (shingles[at : at + 1024, None] ^ _TURNS[0]) * _TURNS[1]
        part ^= part >> _U(32)
        part *= _U(0xBF58476D1CE4E5B9)
        np.minimum(least, part.min(axis=0), out=least)
    return band_keys(least[None, :], BANDS)[0]


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the Jaccard similarity of two sets reaches the threshold."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False  # sizes alone rule the pair out
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # two sorted runs
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared >= threshold * (len(a) + len(b) - shared)


def _wanted(bits: np.ndarray, words: int):
    """(text) to (h, shingles): sets of documents whose node may be among those wanted, each once a task."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                texts = [split(t) for t in batch.column(0).slice(at, 64).to_pylist()]
                nodes = np.fromiter(map(node_of, texts), np.uint64, len(texts))
                ids, found = [], []
                for k in np.flatnonzero(bloom_has(bits, nodes)):
                    if (h := int(nodes[k])) not in seen and texts[k]:
                        seen.add(h)
                        ids.append(h)
                        found.append(shingle_set(texts[k], words).tobytes())
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(found, pa.binary())], names=["h", "shingles"])

    return run


def _verify(threshold: float):
    def run(batches):
        root: dict[int, int] = {}  # pairs known as connected are not compared again
        task, members, found = None, [], []

        def find(x):
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        def bucket():
            if len(members) > MANY:
                groups = Groups(threshold)
                for h, items in members:
                    groups.add(h, Hashes(items))
                for p, q in groups.links:
                    if (x := find(p)) != (y := find(q)):
                        root[y] = x
                        found.append((p, q))
                return
            for i, (p, a) in enumerate(members):
                for q, b in members[i + 1 :]:
                    x, y = find(p), find(q)
                    if x != y and similar(a, b, threshold):
                        root[y] = x
                        found.append((p, q))

        def emit():
            a, b = (pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))
            found.clear()
            return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

        for batch in batches:
            for k in range(batch.num_rows):
                t, h, shingles = (batch.column(c)[k].as_py() for c in range(3))
                if t != task:
                    bucket()
                    task, members = t, []
                members.append((h, np.frombuffer(shingles, np.uint64)))
            if found:
                yield emit()
        bucket()
        if found:
            yield emit()

    return run


class Hashes:
    """A set of shingle hashes as it comes from _wanted()."""

    def __init__(self, raw: bytes | np.ndarray):
        self.items = raw if isinstance(raw, np.ndarray) else np.frombuffer(raw, np.uint64)

    def __len__(self) -> int:
        return len(self.items)

    def shared(self, other: Hashes) -> int:
        both = np.concatenate([self.items, other.items])
        both.sort(kind="stable")  # two sorted runs
        return int(np.count_nonzero(both[1:] == both[:-1]))


def link(texts: DataFrame, banded: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """Links (a, b: nodes) of verified similarity, stored; a spanning forest of each task's. texts: (text); banded: (node,
    keys) of the same documents."""
    keyed = banded.dropDuplicates(["node"]).select(F.explode("keys").alias("key"), F.col("node").alias("h"))
    tasks = stash(keyed.repartition("key").mapInArrow(tidy(_buckets), TASKS).distinct())
    bits = bloom_bits(tasks.select("h"))
    near = texts.mapInArrow(tidy(_wanted(bits, words)), "h long, shingles binary").groupBy("h").agg(F.first("shingles").alias("line"))
    large = tasks.where(F.col("size") > shard)
    some = not large.isEmpty()
    near = stash(near) if some else near
    dealt = tasks.where(F.col("size") <= shard).join(near, "h").repartition("lead", F.pmod(F.col("task"), F.lit(4)))
    dealt = dealt.sortWithinPartitions("lead", "task", "h").select("task", "h", "line")
    found = dealt.mapInArrow(tidy(_verify(threshold)), "a long, b long")
    if some:
        found = found.unionAll(large_links(large.select("lead", "h"), near, threshold, Hashes, shard))
    found = stash(found)
    discard(tasks, near)
    return found
