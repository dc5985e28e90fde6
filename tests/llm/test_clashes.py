"""Every operator, and every stage of the pipeline, on tables whose other columns bear all names used inside, and on
repeated rows: the columns come back unchanged and no row is lost or doubled."""

import re
from pathlib import Path

import corpus_pipeline
import pytest
from common import directory, docs

from farside.llm import bpe, lines, media, mixing, periodic, pieces, pii, simhash, suffixes, toxicity, urls

HERE = Path(bpe.__file__).parent
#: Every string in the subpackage's code that could name a column, apart from those of the tables themselves.
NAMES = sorted(
    {n.lower(): n for p in [*HERE.glob("*.py"), HERE.parent.parent / "corpus_pipeline.py"] for n in re.findall(r'"([A-Za-z_][A-Za-z0-9_]{0,24})"', p.read_text())}.values()
)
OWN = {"doc_id", "text", "lang", "source", "n_chars", "url", "media", "page_id"}
EXTRA = [n for n in NAMES if n.lower() not in OWN]
TEXTS = ["a line of its own that is long enough", "you moron of the tin", "a line of its own that is long enough\nand another", "", None, "card 4111 1111 1111 1111 of 2001-02-03"]


def crowded(spark, with_text=True):
    rows = [(k, t, "en", f"src{k % 2}", k) for k, t in enumerate(TEXTS)] + [(0, TEXTS[0], "en", "src0", 0)] * 2 + [(None, TEXTS[1], None, None, None)] * 2
    df = docs(spark, rows)
    return df.selectExpr("*", *(f"concat('{n}', coalesce(doc_id, -1)) as `{n}`" for n in EXTRA))


OPERATORS = {
    "bpe": lambda df: bpe.encode(df, bpe.default_tokenizer()),
    "digest": lambda df: bpe.digest(df, bpe.default_tokenizer(), keep=tuple(df.columns)),
    "lines": lambda df: lines.dedup(df),
    "marked": lambda df: lines.marked(df)[0],
    "mix": lambda df: mixing.mix(df),
    "mixed": lambda df: mixing.mixed(df),
    "pii": lambda df: pii.pseudonymise(df, "key"),
    "suffixes": lambda df: suffixes.remove_repeats(df, length=20, gram=8),
    "pieces": lambda df: pieces.encode(df, pieces.default_model()),
    "runs": lambda df: periodic.collapse(df),
    "score": lambda df: toxicity.score(df, None),
    "media": lambda df: media.to_pcm(df.selectExpr("*", "cast(text as binary) as media")).drop("media"),
    "urls": lambda df: urls.judge(df.selectExpr("*", "concat('http://a.net/', text) as url")).drop("url"),
}


def shown(df, columns):
    return sorted((tuple(map(str, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_all_columns_come_back(spark, name):
    df = crowded(spark)
    out = OPERATORS[name](df)
    assert len(EXTRA) > 150 and out.columns[: len(df.columns)] == df.columns
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    same = [c for c in df.columns if c != "text" or name not in ("lines", "pii")]
    assert shown(out, same) == shown(df, same)


def test_dedup_keeps_columns(spark):
    df = crowded(spark)
    out = simhash.dedup(df)
    assert out.columns == df.columns and set(shown(out, df.columns)) <= set(shown(df, df.columns)) and out.count() == len(TEXTS) - 1


def test_stages_keep_columns(spark, tmp_path):
    df = crowded(spark)
    d = directory(tmp_path, documents=df, labels=spark.createDataFrame([(1, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, d)
        assert out.columns == df.columns and out.count() > 0, name
    assert corpus_pipeline.run(spark, d).count() > 0
