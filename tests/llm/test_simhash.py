import itertools
import random

import numpy as np
import xxhash
from common import ODD, clash, directory, docs, frame, plain, smallest

from farside.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    long = " ".join(f"w{k % 700}" for k in range(40_000))
    for t in [None, "", "One", "one TWO", "a b c d", "x " * 1000, "É é b c", long]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_links_are_all_found(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    fps = set(base)
    for x in base[:10]:
        for _ in range(12):
            bits = rng.choice(64, rng.integers(1, 4), replace=False)
            fps.add(x ^ int(sum(1 << int(b) for b in bits)))
    fps |= {base[0] ^ (1 << k) for k in range(64)} | {base[1] | k for k in range(1500)}  # a dense bucket is cut again
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.classes(df).collect()}
    arr = np.array(signed, np.int64).view(np.uint64)
    links = [(i, int(j)) for i in range(len(arr)) for j in np.flatnonzero(np.bitwise_count(arr[i] ^ arr[i + 1 :]) <= 2) + i + 1]
    assert got == smallest(links, range(len(arr)))


def test_every_pair_shares_a_key():
    masks = [m & (1 << 64) - 1 for m in simhash.masks(5, 2)]
    for i, j in itertools.combinations(range(64), 2):
        assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_odd_rows_and_query(spark, tmp_path):
    rows = [*ODD, ODD[3], (7, "same text here twice", "en", "s", 1), (8, "Same TEXT here twice", "en", "t", 1), (7, "same text here twice", "en", "s", 1)]
    out = frame(simhash.op10_simhash(spark, directory(tmp_path, documents=docs(spark, rows))))
    assert len(out) == len(rows) and set(out.columns) == {"doc_id", "fingerprint", "component_id"}
    zero = out[out.fingerprint == "0" * 16]
    assert set(zero.doc_id.dropna()) == {1, 2, 3} and (zero.component_id == 1).all()
    assert (out[out.doc_id.isin([7, 8])].component_id == 7).all()
    assert out[out.doc_id.isna()].component_id.isna().all()


def test_dedup_keeps_one_of_each(spark):
    rows = [*ODD, ODD[3], (7, "same text here twice", "en", "s", 1), (8, "Same TEXT here twice", "en", "t", 1), (7, "same text here twice", "en", "s", 1)]
    df = clash(docs(spark, rows), "fp", "_row", "_kept", "component_id", "h")
    out = frame(simhash.dedup(df))
    assert list(out.columns) == df.columns
    assert sorted(out.doc_id.dropna()) == [1, 4, 5, 7] and out.doc_id.isna().sum() == 1
    assert simhash.dedup(plain(spark, [])).count() == 0


def test_dedup_reaches_the_similarity_that_it_states(spark):
    rng, rows, near, far = random.Random(8), [], set(), set()
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for k in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 100, 300]))]
        other = list(words)
        for at in rng.sample(range(len(words)), rng.choice([1, 2, 4, len(words) // 8])):
            other[at] = f"x{rng.randrange(5000)}"
        a, b = grams(words), grams(other)
        (near if len(a & b) >= 0.8 * len(a | b) else far).add(1000 + k)
        rows += [(k, " ".join(words), "en", "s", 1), (1000 + k, "\n".join(other).upper(), "en", "s", 1)]
    assert len(near) > 50 and len(far) > 20
    kept = {r.doc_id for r in simhash.dedup(docs(spark, rows)).select("doc_id").collect()}
    assert kept == set(range(150)) | far
