import hashlib
import random

import numpy as np
import pytest
from common import ODD, clash, directory, docs, frame, plain

from farside.llm import suffixes as S


def brute(texts, length=200):
    """(removed, spans, digest) of every text."""
    count: dict[bytes, int] = {}
    raws = [(t or "").encode() for t in texts]
    for raw in raws:
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            count[w] = count.get(w, 0) + 1
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if count[raw[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for a, b in zip(b"\0" + bytes(gone), bytes(gone)) if b and not a)
        out.append((sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest()))
    return out


def corpus(rnd):
    letters = "abcdefghij klmno pé"
    fresh = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    passages = [fresh(n) for n in (198, 199, 200, 201, 260, 500, 900)]
    texts = []
    for _ in range(120):
        t = fresh(rnd.randint(0, 300))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, 40)
            t += p[a:] + fresh(rnd.choice([0, 1, 5, 150]))
        texts.append(t)
    texts += [texts[3]] * 4 + ["a" * 700, "ab" * 450, "\0" * 320, "x\0" * 130 + "\0" * 90, fresh(400) * 3, "é" * 250]
    texts += [texts[k][: len(texts[k]) // 2] + "!" + texts[k][len(texts[k]) // 2 :] for k in range(20)]
    return texts


@pytest.mark.parametrize("small", [False, True])
def test_like_brute_force(spark, monkeypatch, small):
    if small:  # many runs and ranges
        monkeypatch.setattr(S, "RUN", 40)
        monkeypatch.setattr(S, "RANGE", 60)
    texts = corpus(random.Random(11))
    df = plain(spark, texts).repartition(5)
    out = frame(S.remove_repeats(df, keep=("doc_id",), with_text=True)).set_index("doc_id").sort_index()
    want = brute(texts)
    assert [(r.n_removed, r.n_spans, r.kept_sha256) for r in out.itertuples()] == want
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in out.itertuples())
    assert sum(n for n, _, _ in want) > 10_000


def test_odd_rows_and_query(spark, tmp_path):
    rnd = random.Random(2)
    long = "".join(rnd.choice("abcd ") for _ in range(300_000))
    rows = [*ODD, ODD[3], (8, long, "en", "s", 1), (9, long[1000:1300], "en", "s", 1), (9, long[1000:1300], "en", "s", 1)]
    out = frame(S.op2_suffix_dedup(spark, directory(tmp_path, documents=docs(spark, rows))))
    assert len(out) == len(rows)
    assert (out[out.doc_id.isin([1, 2, 3, 4, 5])].n_removed == 0).all()
    assert out[out.doc_id == 8].n_removed.item() == 300 and (out[out.doc_id == 9].n_removed == 300).all()
    df = clash(docs(spark, rows), "n_bytes", "_text", "_h", "kept")
    assert S.remove_repeats(df).columns == [*df.columns, "_n_bytes", "n_removed", "n_spans", "kept_sha256", "_kept"]
    assert S.remove_repeats(plain(spark, [])).count() == 0


def test_loser_tree_merges_by_known_prefixes():
    rnd = random.Random(3)
    runs = []
    for _ in range(7):
        strings = sorted("".join(rnd.choice("ab") for _ in range(rnd.randint(0, 30))).encode() for _ in range(rnd.randint(0, 60)))
        runs.append((strings, [0] + [S.common(a, b, 0) for a, b in zip(strings, strings[1:])] if strings else []))
    order, shared = S.merge(runs)
    got = [runs[r][0][k] for r, k in order]
    assert got == sorted(x for r in runs for x in r[0])
    assert shared == [0] + [S.common(a, b, 0) for a, b in zip(got, got[1:])]
    assert S.merge([]) == ([], []) and S.merge([([b"a"], [0])]) == ([(0, 0)], [0])


def test_front_code():
    rows = np.array([list(b"abc\0"), list(b"abd\0"), list(b"abde")], np.uint8)
    shared, rest = S.front_code(rows, np.array([3, 3, 4]))
    assert shared.tolist() == [0, 2, 3] and rest == b"abc" + b"d" + b"e"


def test_equal_windows_elect_equal_anchors():
    rng = np.random.default_rng(4)
    core = rng.integers(97, 101, 400, np.uint8).tobytes()
    a = S.anchors([b"x" * 130 + core + b"y" * 70])
    b = S.anchors([core])
    inner = {(int(p) - 130, int(h)) for p, lo, hi, h in zip(*a[1:]) if p - hi >= 130 and p - lo + 200 <= 530}
    assert inner and inner <= {(int(p), int(h)) for p, h in zip(b[1], b[4])}


def test_bounds_and_parts():
    sample = [b"same start here!"] * 600 + [bytes([65 + k % 26]) * 16 for k in range(400)]
    cuts, parts = S.bounds(sample, 20)
    assert cuts == sorted(set(cuts)) and len(parts) == len(cuts) + 1 and max(parts) >= 12 and sum(parts) <= 45
    assert S.bounds([], 3) == ([], [1]) and sum(S.bounds([b"x" * 16] * 100, 500)[1]) == 500


def test_many_ranges_like_brute_force(spark, monkeypatch):
    """Ranges of a few anchors, most of whose suffixes begin alike: cut by bounds and dealt by grams."""
    monkeypatch.setattr(S, "RANGE", 20)
    monkeypatch.setattr(S, "RUN", 50)
    rnd = random.Random(31)
    pool = ["the same beginning " + "".join(rnd.choice("abcd") for _ in range(90)) for _ in range(12)] + ["".join(rnd.choice("ab") for _ in range(70)) for _ in range(8)]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(1, 6))) for _ in range(80)]
    rows = S.remove_repeats(plain(spark, texts).repartition(3), length=40, gram=16).collect()
    want = brute(texts, 40)
    assert sum(n > 0 for n, _, _ in want) > 40
    assert all((r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in rows)


def test_mass_copies_of_one_text(spark):
    """A task sends a text once and says at most once that it has another copy."""
    rnd = random.Random(8)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(300))
    other = "".join(rnd.choice("abcdefgh ") for _ in range(400))
    df = docs(spark, [(k, text, "en", "s", 1) for k in range(3000)] + [(3000, other, "en", "s", 1), (3001, other[:150], "en", "s", 1), (3002, text[:250], "en", "s", 1)]).repartition(6)
    out = frame(S.remove_repeats(df, keep=("doc_id",))).set_index("doc_id").sort_index()
    assert (out.loc[:2999].n_removed == 300).all() and out.loc[3000].n_removed == 0 and out.loc[3001].n_removed == 0 and out.loc[3002].n_removed == 250
    sent = df.selectExpr("text", "xxhash64(text) as h", "octet_length(text) as n").mapInArrow(S._once_or_twice, "text string, h long, n int")
    assert sent.count() <= 2 * 6 + 3 and sent.where("text is null").count() <= 6
