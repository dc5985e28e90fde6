"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import pytest
import sentencepiece
from common import ODD, clash, docs, plain

from farside.llm import pieces

PATH = pieces.default_model()
ODD_TEXTS = [
    " ", "  ", "   a", "\n", "\t\n x", "a  b   c    d" + " " * 40, "▁", " ▁x▁▁", "123 4567.89", "<s> </s> <unk> <0x0A>", "漢字かな混じり文 и кириллица",
    "é é ​ ﻿", "\x00\x01a\x7f", "� \U0001f600\U0001f468‍\U0001f469", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "internationalization's don't", "ﬁ ½ ①",
    "the" * 300, "=" * 77 + "-" * 33, "https://example.com/a/b?c=d&e=f", "    def f(x):\n        return x\n", "x" * 5000, " " * 3000,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return pieces.Pieces(f.read())


def test_odd_texts(library, model):
    for t in ODD_TEXTS:
        ids = model.encode(t).tolist()
        assert ids == library.encode(t) and model.decode(ids) == library.decode(ids), repr(t)


def test_random_texts(library, model):
    rng = random.Random(5)
    letters = "etaoin shrdlu\n.,'" * 3 + "ABC123é漢▁ ßж\U0001f600\x07"
    common = [p.replace(pieces.MARK, " ") for p in list(model.score)[:4000]]
    for k in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(60))) if k % 2 else "".join(rng.choice(common) for _ in range(rng.randrange(12)))
        ids = model.encode(t).tolist()
        assert ids == library.encode(t) and model.decode(ids) == library.decode(ids), repr(t)


def test_any_ids_decode(library, model):
    rng = random.Random(6)
    for _ in range(2000):
        ids = [rng.choice((rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3))) for _ in range(rng.randrange(8))]
        assert model.decode(ids) == library.decode(ids), ids


def test_ties_of_scores_and_steps_that_score_higher(tmp_path):
    """A model by hand: equal scores, and a piece whose second way scores higher than the way to its half."""
    from sentencepiece import sentencepiece_model_pb2 as form

    m = form.ModelProto()
    add = lambda p, s, kind: m.pieces.add(piece=p, score=s, type=kind)
    add("<unk>", 0, 2), add("<s>", 0, 3), add("</s>", 0, 3)
    for b in range(256):
        add(f"<0x{b:02X}>", 0, 6)
    for p, s in (("ab", -1), ("ba", -1), ("bc", -9), ("abc", -3), ("cc", -3), ("aab", -2), ("bcc", -2), (f"{pieces.MARK}a", -2), ("ca", -9), ("cab", -1)):
        add(p, s, 1)
    for k, c in enumerate(f"abc{pieces.MARK}"):
        add(c, -100 - k, 1)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.trainer_spec.vocab_size = form.TrainerSpec.BPE, True, len(m.pieces)
    m.normalizer_spec.name, m.normalizer_spec.remove_extra_whitespaces = "identity", False
    path = tmp_path / "m.model"
    path.write_bytes(m.SerializeToString())
    library, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.Pieces(path.read_bytes())
    rng = random.Random(1)
    for _ in range(4000):
        t = "".join(rng.choice("aabbcc d") for _ in range(rng.randrange(14)))
        assert own.encode(t).tolist() == library.encode(t), t
    m.trainer_spec.model_type = form.TrainerSpec.UNIGRAM
    with pytest.raises(ValueError):
        pieces.Pieces(m.SerializeToString())


def expected(library, doc_id, text):
    ids = library.encode(text or "")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))


def test_query_on_documents(spark, sf_dir, library):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(expected(library, *r) for r in rows)
    assert sorted(map(tuple, pieces.op12_sentencepiece(spark, sf_dir).collect())) == want


def test_odd_rows_repeats_and_clashes(spark, library):
    rows = [*ODD, ODD[-1], ODD[-1]]
    df = docs(spark, rows)
    key = lambda r: repr(tuple(r))
    assert sorted(map(tuple, pieces.digest(df, PATH).collect()), key=key) == sorted((expected(library, r[0], r[1]) for r in rows), key=key)
    assert pieces.digest(df.limit(0), PATH).count() == 0
    out = pieces.decode(pieces.encode(clash(df, "ids"), PATH, ids_col="Ids"), PATH, ids_col="_Ids")
    assert out.columns == [*df.columns, "ids", "_Ids", "decoded"]
    assert all(r.decoded == (r.text or "") for r in out.collect())


def test_small_tables_stay_right(spark, library, model, monkeypatch):
    monkeypatch.setattr(pieces, "WORDS", 3)
    monkeypatch.setattr(pieces, "PAIRS", 5)
    monkeypatch.setattr(pieces, "PREFIXES", 9)
    fresh = pieces.Pieces(open(PATH, "rb").read())
    for t in ("one two three four five six seven " * 3, *ODD_TEXTS[:12]):
        assert fresh.encode(t).tolist() == library.encode(t)
    text = "a text that is long " * 20_000
    (row,) = pieces.encode(plain(spark, [text]), PATH).collect()
    assert row.ids == library.encode(text)
