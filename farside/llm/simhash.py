"""SimHash near-dedup: pigeonhole blocks.

A fingerprint is cut into blocks; two fingerprints that differ in at most `max_bits` bits agree on all but `max_bits` of
the blocks. Every choice of blocks that may agree becomes a join key, fingerprints with equal keys meet in one stream of
sorted rows, and their Hamming distance is verified there. Found links are handed on as spanning stars, never as all
pairs, and a distributed union-find turns them into classes.

Defined results: null text counts as empty; texts of any length are read whole; a text without words has fingerprint zero and is linked like any other;
repeated rows share their class; a null id never becomes a class id unless its whole class has none; an empty table gives
an empty result; other columns are ignored by fingerprints() and link() and kept by dedup().
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingled
from .util import column_name, components, discard, forest, hot_join, small_batches, stash, tidy

SEED, WORDS = 42, 3
_LANES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit word whose bits are set where more than half of the hashes have them set (0 for none)."""
    n, sums = len(hashes), np.zeros((8, 8), np.int64)
    for at in range(0, n, 255):  # eight one-byte lanes in a 64-bit sum hold up to 255 ones each
        part = hashes[at : at + 255]
        for bit in range(8):
            sums[bit] += ((part >> np.uint64(bit)) & _LANES).sum(dtype=np.uint64).reshape(1).view(np.uint8)
    out = 0
    for bit, lane in zip(*np.nonzero(2 * sums > n)):
        out |= 1 << (8 * int(lane) + int(bit))
    return out


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Of one text: XXH64 (seed 42) of each run of `words` words, repeats included, then the majority of every bit."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not w:
        return 0
    if len(w) < words:
        return majority(np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64))
    grams = zip(*(w[k:] for k in range(words)))
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(SEED)), np.uint64, len(w) - words + 1))


def _fingerprint_batches(words):
    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t, words) for t in _texts(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return run


def _texts(column, step: int = 64):
    for at in range(0, len(column), step):  # a few at a time, so that Python holds no second copy of the whole batch
        yield from column.slice(at, step).to_pylist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp long: the unsigned fingerprint's bits) for each row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(_fingerprint_batches(words)), "doc_id long, fp long")


def masks(n_blocks: int, max_bits: int) -> list[int]:
    """For each choice of blocks that agree, the mask of their bits, as a signed 64-bit number."""
    edges = [64 * k // n_blocks for k in range(n_blocks + 1)]
    blocks = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(n_blocks)]
    found = [sum(c) for c in combinations(blocks, n_blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _close(fp: np.ndarray, group: np.ndarray, free: int, max_bits: int, dense: int = 512):
    """Links between rows of one group (sorted by it) at distance max_bits or less. Groups of over `dense` members are
    cut again by the pigeonhole: pairs differ in free bits only, so they agree on one of max_bits + 1 parts of those."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[starts, len(group)])
    left = np.repeat(starts + size, size) - np.arange(len(group)) - 1  # members after this one
    big = np.repeat(size > dense, size)
    found_a, found_b = [], []
    at = np.flatnonzero((left > 0) & ~big)
    step = 1
    while len(at):
        other = at + step
        hit = np.bitwise_count(fp[at] ^ fp[other]) <= max_bits
        found_a.append(fp[at[hit]])
        found_b.append(fp[other[hit]])
        step += 1
        at = at[left[at] >= step]
    bits = [k for k in range(64) if free >> k & 1]
    for s, n in zip(starts[size > dense], size[size > dense]):
        members, parts = fp[s : s + n], np.array_split(np.array(bits, np.uint64), max_bits + 1)
        if len(bits) <= max_bits:
            found_a.append(members[:-1])
            found_b.append(members[1:])
            continue
        for part in parts:
            mask = int(sum(1 << int(k) for k in part))
            key = members & np.uint64(mask)
            order = np.argsort(key, kind="stable")
            for x, y in [_close(members[order], key[order], free & ~mask, max_bits, dense)]:
                found_a.append(x)
                found_b.append(y)
    if not found_a:
        return fp[:0], fp[:0]
    a, b = forest(np.concatenate(found_a).view(np.int64), np.concatenate(found_b).view(np.int64))
    return a.view(np.uint64), b.view(np.uint64)


def _verify(mask_list, max_bits):
    full = (1 << 64) - 1
    table_ = np.array(mask_list, np.int64).view(np.uint64)

    def run(batches):
        held_k, held = np.empty(0, np.int64), np.empty(0, np.uint64)

        def links(which, fps):
            for k in np.unique(which):
                own = fps[which == k]
                mask = int(table_[k])
                key = own & np.uint64(mask)
                order = np.lexsort((own, key))
                own, key = own[order], key[order]
                keep = np.r_[True, own[1:] != own[:-1]]
                a, b = _close(own[keep], key[keep], full & ~mask, max_bits)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            which = np.concatenate([held_k, batch.column(0).to_numpy().astype(np.int64)])
            fps = np.concatenate([held, batch.column(1).to_numpy().view(np.uint64)])
            if not len(which):
                continue
            same = (which == which[-1]) & ((fps & table_[which]) == (fps[-1] & table_[which[-1]]))
            yield from links(which[~same], fps[~same])  # the last group may go on in the next batch
            held_k, held = which[same], fps[same]
            keep = np.unique(held, return_index=True)[1]
            held_k, held = held_k[keep], held[keep]
        if len(held):
            yield from links(held_k, held)

    return run


def link(fps: DataFrame, n_blocks: int = 5, max_bits: int = 2) -> DataFrame:
    """Links (a, b: fingerprints, at most max_bits apart) over (doc_id, fp); as stars, so their number stays below
    that of distinct fingerprints times that of block choices."""
    found = masks(n_blocks, max_bits)
    distinct = fps.select("fp").distinct()
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.lit(m) for m in found])).alias("k", "mask"))
    keyed = keyed.select("k", "fp", F.expr("fp & mask").alias("key"))
    dealt = keyed.repartition("k", "key").sortWithinPartitions("k", "key", "fp")
    return dealt.select("k", "fp").mapInArrow(tidy(_verify(found, max_bits)), "a long, b long")


def rooted(fps: DataFrame, n_blocks: int = 5, max_bits: int = 2) -> DataFrame:
    """(fp, root) of every distinct fingerprint: root is the smallest fingerprint (as a signed number) reachable."""
    return _rooted(fps, link(fps, n_blocks, max_bits))


def _rooted(fps: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links)
    distinct = fps.select("fp").distinct()
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def classes(fps: DataFrame, n_blocks: int = 5, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of stored fingerprints: component_id is the smallest doc_id reachable over links. A
    fingerprint that many rows share (empty texts, mass copies) is looked up apart from the others."""
    roots = rooted(fps, n_blocks, max_bits)
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    least = stash(least.join(roots, "fp"))
    found = stash(least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id", "n"))
    discard(least)
    return hot_join(fps, found, "fp", "n").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs."""
    return classes(stash(fingerprints(docs, id_col, text_col)))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = shingled.WORDS, max_bits: int = 2, threshold: float = shingled.THRESHOLD) -> DataFrame:
    """docs with one row of each class: the one with the smallest id (of rows that share it, one); a row with a null id
    stays if its text's class has no id at all, one for each class. Two texts are linked if their fingerprints of `words`
    words differ in at most max_bits bits, or if the Jaccard similarity of their sets of such shingles reaches the
    threshold: at 0.8 fingerprints differ in about ten bits, which no choice of blocks finds."""
    key, fp_col = column_name(docs, "_row"), column_name(docs, "_kept")
    marked = docs.withColumn(key, F.struct(F.col(id_col).cast("long").alias("i"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("h")))
    found = stash(_fingerprints_with_key(marked, id_col, text_col, key, words))
    # similar texts as links of their fingerprints; texts of equal words have equal ones
    near = shingled.link(docs.select(F.col(text_col).cast("string").alias("text")), found.select("node", "keys"), words, threshold)
    of = found.groupBy("node").agg(F.min("fp").alias("fp"))
    near = near.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    links = link(found, max_bits=max_bits, n_blocks=max_bits + 3).unionAll(near)
    # the first row of each fingerprint, then of each class: a fingerprint that many rows share never meets in a join
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("k")
    kept = found.groupBy("fp").agg(first).join(_rooted(found, links), "fp").groupBy("root").agg(F.min("k").alias("k"))
    kept = kept.select(F.struct(F.col("k.doc_id").alias("i"), F.col("k.h").alias("h")).alias(fp_col))
    # the key is a struct that is never null itself, so one exchange by it serves the join and the removal of repeated rows
    return marked.join(kept, marked[key] == kept[fp_col], "left_semi").dropDuplicates([key]).drop(key)


def _fingerprints_with_key(marked: DataFrame, id_col: str, text_col: str, key: str, words: int) -> DataFrame:
    """(doc_id, fp, h, node, keys) of each row: node and keys as shingled.link() takes them."""
    small_batches(marked.sparkSession)
    rows = marked.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(f"{key}.h").alias("h"))

    def run(batches):
        for batch in batches:
            fps, nodes, keys = np.empty(batch.num_rows, np.uint64), np.empty(batch.num_rows, np.uint64), []
            for k, text in enumerate(_texts(batch.column(1))):
                parts = shingled.split(text)
                fps[k], nodes[k] = fingerprint(text, words), shingled.node_of(parts)
                keys.append(shingled.keys_of(shingled.shingle_set(parts, words)).view(np.int64))
            ends = pa.array(np.r_[0, np.cumsum([len(x) for x in keys])].astype(np.int32))
            keys = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2), pa.array(nodes.view(np.int64)), keys], names=["doc_id", "fp", "h", "node", "keys"])

    return rows.mapInArrow(tidy(run), "doc_id long, fp long, h long, node long, keys array<long>")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """fingerprint and class of every document."""
    rows = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
