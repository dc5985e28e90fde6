import hashlib
import random

import numpy as np
import pytest
from common import ODD, clash, directory, docs, frame, plain
from tokenizers import Tokenizer, pre_tokenizers

from farside.llm import bpe

PATH = bpe.default_tokenizer()


@pytest.fixture(scope="module")
def ours():
    return bpe.Automaton(open(PATH, "rb").read(), cache_words=500)


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


ALPHABETS = ["ab", "aA '", "the an", "\n\t \r\x0b\x1c\x85 x", "éüß漢字а𝔘1²½९", "lstrd' ", "aaaa", "0123 ", "͸Ᲊa ", "_-=~"]


def test_like_the_library(ours, theirs):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(a) for _ in range(rnd.randint(0, 60))) for a in ALPHABETS for _ in range(300)]
    texts += ["<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "x" * 5000, "ab" * 3000, "", "supercalifragilisticexpialidocious " * 50]
    for t in texts:
        want = theirs.encode(t, add_special_tokens=False).ids
        got = np.frombuffer(ours.encode(t), "<u4").tolist()
        assert got == want, t[:80]
        assert ours.decode(got) == theirs.decode(want, skip_special_tokens=False)


def test_splits_at_every_character_like_the_library(ours):
    library = pre_tokenizers.ByteLevel(add_prefix_space=False)
    for c in [*range(0x3000), *range(0x3000, 0xD800, 7), *range(0xE000, 0x110000, 97)]:
        s = f"a{chr(c)}1{chr(c)}.{chr(c)}{chr(c)}a {chr(c)}"
        assert ours.split(s) == [s[a:b] for _, (a, b) in library.pre_tokenize_str(s)], hex(c)


def test_every_token_decodes_and_most_encode_to_themselves(ours, theirs):
    for i in random.Random(1).sample(range(50_256), 2000):
        assert ours.decode([i]) == theirs.decode([i], skip_special_tokens=False)
        assert ours.encode_word(ours.labels[i]) == [i] or i not in ours.readable


def test_round_trip_of_columns(spark):
    df = clash(docs(spark, ODD), "ids", "decoded2")
    out = bpe.decode(bpe.encode(df, PATH), PATH, ids_col="_ids")
    assert out.columns == [*df.columns, "_ids", "decoded"]
    assert all(r.decoded == (r.text or "") for r in out.collect())
    assert bpe.encode(plain(spark, []), PATH).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), PATH).first().decoded == ""


def test_query(spark, tmp_path, theirs):
    rows = [*ODD, ODD[5], (9, "long " * 30_000, "en", "s", 1)]
    out = frame(bpe.op4_bpe(spark, directory(tmp_path, documents=docs(spark, rows))))
    assert len(out) == len(rows)
    for r in rows:
        ids = theirs.encode(r[1] or "", add_special_tokens=False).ids
        got = out[out.doc_id == r[0]] if r[0] is not None else out[out.doc_id.isna()]
        assert (got.n_tokens == len(ids)).all() and (got.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()).all()
        assert (got.decoded_sha256 == hashlib.sha256((r[1] or "").encode()).hexdigest()).all()


def test_a_file_too_large_is_refused(spark, tmp_path, monkeypatch):
    (tmp_path / "v.json").write_text("{}" * 10)
    monkeypatch.setattr(bpe, "MAX_FILE_MB", 0)
    with pytest.raises(ValueError):
        bpe.encode(plain(spark, ["a"]), str(tmp_path / "v.json"))


def test_arcs_are_pairs_that_encode_to_themselves(ours, theirs):
    """The table against the library: an arc from x to y is there exactly if the bytes of both encode to x, y."""
    rnd, readable = random.Random(3), sorted(ours.readable)
    seen = [0, 0]
    for _ in range(4000):
        x, y = rnd.choice(readable), rnd.choice(readable)
        word = (ours.labels[x] + ours.labels[y]).decode("utf-8", "ignore")
        if word.encode() == ours.labels[x] + ours.labels[y] and len(ours.split(word)) == 1:
            arc = ours.arc(x, y)
            seen[arc] += 1
            assert arc == (theirs.encode(word, add_special_tokens=False).ids == [x, y])
    assert min(seen) > 20


def test_settings_without_an_automaton_are_refused():
    import json

    spec = json.loads(open(PATH, "rb").read())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"ignore_merges": True}}):
        with pytest.raises(ValueError):
            bpe.Automaton(json.dumps(spec | change).encode())
