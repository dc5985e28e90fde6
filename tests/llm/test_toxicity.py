import itertools
import random
import zlib

import numpy as np
import pytest
from common import ODD, clash, directory, docs, frame, plain

from farside.llm import toxicity as T

INSULTS = ["moron", "worthless", "stupid", "lowei"]


def brute_kernel(s, t, order, decay):
    """Sum over pairs of equal subsequences of decay to the letters both span."""
    def spans(x):
        out = {}
        for at in itertools.combinations(range(len(x)), order):
            out.setdefault("".join(x[k] for k in at), []).append(at[-1] - at[0] + 1)
        return out

    a, b = spans(s), spans(t)
    return sum(decay ** (i + j) for k in a.keys() & b.keys() for i in a[k] for j in b[k])


def test_kernel():
    pairs = [("moron", "moron"), ("moxron", "moron"), ("banana", "bandana"), ("abc", "xyz"), ("ab", "ab"), ("aaaaa", "aaaa"), ("éàü", "éàü")]
    got = T.subsequence_kernel(T._codes([a for a, _ in pairs]), T._codes([b for _, b in pairs]), 3, 0.7)
    assert np.allclose(got, [brute_kernel(a, b, 3, 0.7) for a, b in pairs], rtol=1e-4)


def make(rnd, n):
    syllables = ["an", "the", "ar", "en", "is", "ti", "in", "ea", "ha", "ch"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    rows = []
    for k in range(n):
        toxic = int(k % 4 == 0)
        words = [word() + ("." if rnd.random() < 0.1 else "") for _ in range(rnd.randint(5, 60))]
        if toxic:
            words.insert(rnd.randint(0, len(words)), rnd.choice(INSULTS[:3] + [INSULTS[3] + word()]))
        rows.append((" ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = make(random.Random(1), 1600)
    return T.fit([t for t, _ in rows], [y for _, y in rows])


def score(model, text):
    reader = T.Reader(model)
    words = T.words_of(text)
    reader.learn([words])
    return reader.score(words)


def test_held_out_accuracy(model):
    rows = make(random.Random(2), 800)
    got = np.array([score(model, t) for t, _ in rows]) >= 0.5
    want = np.array([y for _, y in rows]) == 1
    assert (got == want).mean() > 0.98


def test_gaps_and_insertions(model):
    for t in ["you moron", "you mo.ron!", "a m o r o n here", "M-O-R-O-N", "stxupid", "worth less worthlless", "WORTHXLESS the"]:
        assert score(model, t) >= 0.5, t
    for t in ["", None, "the tin is on the hen", "more on the roman stupa", "x" * 5000]:
        assert score(model, t) < 0.5, t


def test_long_words_are_read_whole(model):
    assert score(model, "an" * 40 + "moron" + "en" * 40) >= 0.5


def test_without_both_kinds_nothing_is_toxic(spark):
    assert T.fit([], []) is None and T.fit(["a"], [1]) is None and T.fit(["a", "b"], [0, 1]) is None
    df = plain(spark, ["moron", None])
    assert [r.score for r in T.score(df, None).collect()] == [0.0, 0.0] and T.screen(df, None).count() == 2


def test_query_and_odd_rows(spark, tmp_path):
    made = make(random.Random(3), 1000)
    rows = [(k + 100, t, "en", "s", 1) for k, (t, _) in enumerate(made)] + [*ODD, ODD[4]]
    labels = [(k + 100, 1, y) for k, (_, y) in enumerate(made)] + [(None, 1, 1), (1, None, 1), (2, 1, None), (99999, 0, 1), (4, 0, 0), (4, 0, 0)]
    d = directory(tmp_path, documents=docs(spark, rows), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = frame(T.op7_toxicity(spark, d))
    assert len(out) == len(rows) and list(out.columns) == ["doc_id", "held_out", "score", "predicted"]
    for r in out[out.doc_id.notna()].itertuples():
        assert r.held_out == (zlib.crc32(str(int(r.doc_id)).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    want = {k + 100: y for k, (_, y) in enumerate(made)}
    held = out[out.held_out & out.doc_id.isin(want)]
    assert (held.predicted == held.doc_id.map(want)).mean() > 0.97
    assert out[out.doc_id == 4].score.nunique() == 1


def test_screen_keeps_columns(spark, model):
    df = clash(plain(spark, ["you moron", "the tin", None]), "_toxicity", "score")
    assert sorted(r.doc_id for r in T.screen(df, model).collect()) == [1, 2] and T.screen(df, model).columns == df.columns
    assert T.score(plain(spark, []), model).count() == 0


def test_scores_are_nystroem_values_of_the_kernel(model):
    """Features by hand: values of all pairs by enumeration, the inverse root of the landmarks' matrix, the best piece."""
    s = T.Settings()
    value = lambda a, b: brute_kernel(a, b, s.order, s.decay) / np.sqrt(brute_kernel(a, a, s.order, s.decay) * brute_kernel(b, b, s.order, s.decay))
    marks = T.Landmarks(["^moron", "^stupi", "^anthe", "^enti"], s)
    gram = np.array([[value(a, b) for b in marks.strings] for a in marks.strings])
    values, vectors = np.linalg.eigh(gram)
    weights, bias = np.array([1.0, 0.5, -0.25, 0.125]), -0.3
    m = T.Model(marks, np.r_[weights, bias], 2.0, 0.1)
    for text in ["moron", "the moxrxon is", "anthear stup", "m-o-r-o-n", "arenistimoronthe", "zzz qq", "an"]:
        pieces = [p for w in T.words_of(text) for p in T.pieces(w) if len(p) >= s.order]
        features = [np.array([value(p, q) for q in marks.strings]) @ vectors @ np.diag(values**-0.5) @ vectors.T for p in pieces]
        want = 1 / (1 + np.exp(-(2.0 * max([bias, *(f @ weights + bias for f in features)]) + 0.1)))
        assert abs(score(m, text) - want) < 1e-5, text


def test_letters_inserted_and_left_out(model):
    """Five letters, two more inserted or one left out: values fall but are not lost."""
    caught = [score(model, f"the {w} is") >= 0.5 for w in ("moxrxon", "mzoqron", "morxoxn", "mron", "moro", "moon", "moroxn", "xmoron")]
    assert all(caught), caught


def test_stems_with_endings_are_landmarks(model):
    assert any(x.startswith("^lowe") for x in model.strings) and score(model, "loweitharen") >= 0.5
    assert all(x.startswith(T.START) for x in model.strings[:4])


def test_repeated_ids_and_long_texts_in_the_sample(spark):
    df = docs(spark, [(1, "b", "en", "s", 1), (1, "a", "en", "s", 1), (2, "c" * 100, "en", "s", 1), (3, None, "en", "s", 1)])
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert T.sample(df, labels, T.Settings()) == (["", "c" * 100, "a"], [0, 0, 1])
    assert T.sample(df, labels, T.Settings(max_bytes=100)) == (["", "a"], [0, 1])
