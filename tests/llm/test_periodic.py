"""Periodic runs against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from common import ODD, clash, docs, plain

from farside.llm import periodic as P


def brute(words, least=P.LEAST, times=P.TIMES):
    """Every maximal stretch of every period, that no shorter period fits."""
    n, found = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j + p - i
            part = words[i : i + length]
            if length >= max(least, times * p) and not any(all(part[k] == part[k + q] for k in range(length - q)) for q in range(1, p)):
                found.append((i, length, p))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def listed(runs):
    return [tuple(r) for r in runs.tolist()]


@pytest.mark.parametrize("letters,size", [(1, 30), (2, 14), (2, 60), (3, 120), (8, 200)])
def test_runs_of_random_words(letters, size):
    rng = np.random.default_rng(letters * 1000 + size)
    texts = [[b"w%d" % x for x in rng.integers(0, letters, rng.integers(0, size))] for _ in range(60)]
    for least, times in ((6, 4), (2, 2), (5, 3)):
        got = P.runs_of(texts, least, times)
        assert [listed(r) for r in got] == [brute(t, least, times) for t in texts]


def test_fibonacci_words_and_powers():
    fib = [[b"a"], [b"a", b"b"]]
    for _ in range(9):
        fib.append(fib[-1] + fib[-2])
    texts = [fib[-1], [b"a"] * 500, [b"x", b"y", b"z"] * 90, [b"a", b"b"] * 4 + [b"c"] + [b"a", b"b"] * 5, []]
    for least, times in ((6, 4), (2, 2)):
        assert [listed(r) for r in P.runs_of(texts, least, times)] == [brute(t, least, times) for t in texts]


def test_next_smaller():
    rng = np.random.default_rng(7)
    for values in (rng.permutation(500), np.arange(3000), np.arange(3000)[::-1], np.r_[0, np.arange(4000)[::-1] + 1]):
        got = P.next_smaller(values)
        want, stack = [len(values)] * len(values), []
        for i, v in enumerate(values):
            while stack and values[stack[-1]] > v:
                want[stack.pop()] = i
            stack.append(i)
        assert got.tolist() == want


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and words:
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
    runs = brute(words)
    drop = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
    return (doc_id, len(runs), *longest, sha(lines), sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_on_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in rows if len(r.text or "") < 4000]
    got = {r.doc_id: tuple(r) for r in P.op11_runs(spark, sf_dir).collect()}
    assert len(got) == len(rows) and len(short) > 150
    assert all(got[r.doc_id] == expected(r.doc_id, r.text) for r in short)
    assert sum(v[1] > 0 for v in got.values()) > 10


def test_odd_rows_repeats_and_clashes(spark):
    rows = [*ODD, (7, "a b " * 30, "en", "s", 1), (7, "a b " * 30, "en", "s", 1), (8, "x y " * 9, "en", "s", 1)]
    df = docs(spark, rows)
    got = sorted(map(tuple, P.digest(df).collect()), key=repr)
    assert got == sorted((expected(r[0], r[1]) for r in rows), key=repr)
    assert P.digest(df.limit(0)).count() == 0
    out = P.collapse(clash(df, "runs", "Collapsed"))
    assert out.columns == [*df.columns, "runs", "Collapsed", "_runs", "_collapsed"]
    by = {r.doc_id: r for r in out.collect()}
    assert [tuple(x) for x in by[7]["_runs"]] == [(0, 60, 2)] and by[7]["_collapsed"] == "a b"
    assert by[8]["_runs"][0].length == 9 and by[1]["_collapsed"] == "" and by[1]["_runs"] == []


def test_long_text(spark):
    """200,000 words, half of them one run."""
    rng = np.random.default_rng(1)
    text = " ".join(f"w{x}" for x in rng.integers(0, 50, 100_000)) + " " + " ".join(["p q r s t"] * 20_000)
    (row,) = P.collapse(plain(spark, [text])).select("runs").collect()
    assert max(r.length for r in row.runs) == 100_000 and [r.period for r in row.runs if r.length == 100_000] == [5]
