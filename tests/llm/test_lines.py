import functools
import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
from common import ODD, clash, directory, docs, frame, plain, smallest

from farside.llm import lines as L


def brute(rows):
    """{(key, place)} to remove, by all pairs of different lines."""
    places = {}
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            if L.comparable(line):
                places.setdefault(line, []).append((i, k))
    found = list(places)
    sets = [L.shingles(x) for x in found]
    links = []
    for a, b in combinations(range(len(found)), 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            links.append((a, b))
    groups = {}
    for a, r in smallest(links, range(len(found))).items():
        groups.setdefault(r, []).extend(places[found[a]])
    return {p for g in groups.values() for p in g if p != min(g)}, links


def corpus(rnd):
    letters = "abcdefgh ijklmnop é"
    fresh = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    seeds = [fresh(rnd.choice([2, 6, 20, 60, 200, 400])) for _ in range(60)]

    def varied(x):
        if rnd.random() < 0.4 or len(x) < 20:
            return x
        at = rnd.randint(0, len(x) - 1)
        return x[:at] + rnd.choice(["", "zq", "!"]) + x[at + 1 :]

    texts = []
    for _ in range(90):
        texts.append("\n".join(varied(rnd.choice(seeds)) if rnd.random() < 0.5 else fresh(rnd.randint(0, 90)) for _ in range(rnd.randint(1, 6))))
    return texts + [texts[0], "  \n\t\n", "漢字漢字漢字漢字" * 5, "漢字漢字漢字漢字" * 5 + "漢", "\n\n"]


@pytest.mark.parametrize("shard", [2048, 2])
def test_like_brute_force(spark, shard):
    texts = corpus(random.Random(5))
    want, links = brute(list(enumerate(texts)))
    out, removed = L.marked(plain(spark, texts).repartition(3), shard=shard)
    got = {(r.doc_id, k) for r in out.collect() for k in r[removed] or ()}
    assert len(links) > 40 and got == want


def test_dedup_keeps_the_rest_of_the_text(spark):
    texts = corpus(random.Random(6))
    want, _ = brute(list(enumerate(texts)))
    df = clash(plain(spark, texts), "removed", "_line_key", "_gone", "h", "pos")
    out = frame(L.dedup(df)).set_index("doc_id")
    assert list(out.columns) == df.columns[1:]
    for i, t in enumerate(texts):
        assert out.loc[i].text == "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in want)


def test_signatures():
    rnd = random.Random(2)
    lines = ["".join(rnd.choice("abcdef ") for _ in range(n)) for n in (1, 3, 4, 5, 6, 30, 500)]
    sig = L.signatures(lines, 96)
    assert (sig != 0xFFFFFFFF).all()
    for k, x in enumerate(lines):  # a line's signature doesn't depend on its neighbours
        assert (L.signatures([x], 96)[0] == sig[k]).all()
    a = "".join(rnd.choice("abcdef ") for _ in range(3000))
    b = a[:1350] + "".join(rnd.choice("xyz") for _ in range(300)) + a[1650:]
    p, q = L.shingles(a), L.shingles(b)
    agree = np.mean(L.signatures([a], 960) == L.signatures([b], 960))
    assert abs(agree - len(p & q) / len(p | q)) < 0.08


def test_recall_at_the_threshold(spark):
    """Pairs of a similarity between 0.8 and 0.85, of which banding must find nearly all."""
    rnd = random.Random(9)
    texts = []
    for _ in range(300):
        a = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300))
        b = list(a)
        for k in rnd.sample(range(300), 6):
            b[k] = "#"
        texts += [a, "".join(b)]
    p = [(L.shingles(x), L.shingles(y)) for x, y in zip(texts[::2], texts[1::2])]
    near = [k for k, (x, y) in enumerate(p) if 0.8 <= len(x & y) / len(x | y) <= 0.85]
    out, removed = L.marked(plain(spark, texts))
    gone = {r.doc_id for r in out.collect() if r[removed]}
    assert len(near) > 50 and sum(2 * k + 1 in gone for k in near) / len(near) >= 0.97


def test_odd_rows_and_query(spark, tmp_path):
    rows = [*ODD, ODD[3], ODD[4], (8, "one line of words here\nword\nx" + "y" * 200_000, "en", "s", 1), (9, "one line of words here", "en", "s", 1)]
    out = frame(L.op8_line_dedup(spark, directory(tmp_path, documents=docs(spark, rows))))
    assert len(out) == len(rows) and list(out.columns) == ["doc_id", "n_lines", "n_removed", "removed", "kept_sha256"]
    r = out[out.doc_id == 8].iloc[0]
    assert (r.n_lines, r.n_removed, list(r.removed)) == (3, 1, [1])
    assert r.kept_sha256 == hashlib.sha256(("one line of words here\nx" + "y" * 200_000).encode()).hexdigest()
    assert list(out[out.doc_id == 9].removed.iloc[0]) == [0] and sorted(out[out.doc_id == 4].n_removed) == [0, 1]
    assert out[out.doc_id == 1].n_lines.item() == 0 and out[out.doc_id == 2].n_lines.item() == 1
    assert L.dedup(plain(spark, [])).count() == 0


def test_repeated_rows_keep_one_copy(spark):
    rows = [(1, "a line that stands here\nb", "en", "s", k) for k in range(5)] + [(None, "a row without an id\nb", "en", "s", 0)] * 3 + [(2, "a line that stands here\nof its own", "en", "s", 0)]
    out = [(r.doc_id, r.text) for r in L.dedup(docs(spark, rows).repartition(3)).collect()]
    assert sorted(out, key=str) == sorted([(1, "a line that stands here")] + [(1, "")] * 4 + [(None, "a row without an id\nb")] + [(None, "")] * 2 + [(2, "of its own")], key=str)


def test_emptied_documents_can_go(spark):
    rows = [(1, "a line that stands here", "en", "s", 1), (2, "a line that stands here\n ", "en", "s", 1), (3, " \n", "en", "s", 1), (4, None, "en", "s", 1)]
    assert {r.doc_id for r in L.dedup(docs(spark, rows), drop_emptied=True).collect()} == {1, 3, 4}


def test_large_buckets_like_brute_force(spark):
    """All buckets of more than seven lines are dealt in shards of so many: groups, pivots and what lies between them."""
    rnd = random.Random(21)
    base = ["".join(rnd.choice("abcdefghij klmno") for _ in range(90)) for _ in range(4)]
    texts = []
    for k in range(260):  # chains: each line is a few letters from an earlier one
        x = list(rnd.choice(texts[-40:]) if texts and rnd.random() < 0.8 else rnd.choice(base))
        for _ in range(rnd.randint(1, 3)):
            x[rnd.randrange(len(x))] = rnd.choice("pqrstuvw")
        texts.append("".join(x))
    want, links = brute(list(enumerate(texts)))
    out, removed = L.marked(plain(spark, texts), shard=7)
    got = {(r.doc_id, k) for r in out.collect() for k in r[removed] or ()}
    assert len(links) > 80 and len(want ^ got) <= 1  # banding may miss a pair at the threshold


def test_one_bucket_of_many_different_lines(spark):
    """20,000 different lines that are near copies of one another: one stays, in time that does not grow with all pairs."""
    texts = [f"entry {k:05d} of the log: the request was served in time and the answer was sent back to the client as asked" for k in range(20_000)]
    df = spark.createDataFrame([(k, "\n".join(texts[20 * k : 20 * k + 20])) for k in range(1000)], "doc_id long, text string")
    out = L.dedup(df.repartition(4))
    assert [r.text for r in out.where("text <> ''").collect()] == [texts[0]]


@pytest.mark.parametrize("shard", [5, 40, 1000])
def test_grouping_of_a_bucket_loses_no_component(spark, tmp_path, shard):
    """One bucket of lines in chains, so that many are linked only through others, of other shards too."""
    rnd, texts = random.Random(shard), []
    for k in range(240):
        x = list(texts[-rnd.randint(1, min(9, len(texts)))] if texts and rnd.random() < 0.85 else "".join(rnd.choice("abcdefghij klmno") for _ in range(100)))
        for _ in range(rnd.randint(1, 3)):
            x[rnd.randrange(len(x))] = rnd.choice("pqrstuvw")
        texts.append("".join(x))
    texts = sorted(set(texts))
    sets = [L.shingles(x) for x in texts]
    near = [(a, b) for a, b in combinations(range(len(texts)), 2) if (both := len(sets[a] & sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - both)]
    stored = lambda df, name: (df.write.parquet(f"{tmp_path}/{name}"), spark.read.parquet(f"{tmp_path}/{name}"))[1]
    tasks = stored(spark.createDataFrame([(0, k) for k in range(len(texts))], "lead long, h long"), "tasks")
    lines = stored(spark.createDataFrame(list(enumerate(texts)), "h long, line string"), "lines")
    got = [tuple(r) for r in L.large_links(tasks, lines, 0.8, functools.partial(L.Shingles, n=5), shard).collect()]
    assert set(map(frozenset, got)) <= set(map(frozenset, near)) and len(got) < len(near)
    assert smallest(got, range(len(texts))) == smallest(near, range(len(texts)))
