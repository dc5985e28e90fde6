import numpy as np
import pytest
from common import smallest

from farside.llm import util


def test_forest_keeps_components():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 60, 50), rng.integers(0, 60, 50)
    x, y = util.forest(a, b)
    nodes = set(a) | set(b)
    assert smallest(zip(x, y), nodes) == smallest(zip(a, b), nodes)
    assert len(util.forest(a[:0], b[:0])[0]) == 0


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none"])
def test_components(spark, kind):
    rng = np.random.default_rng(5)
    links = {
        "random": list(zip(*rng.integers(-40, 40, (2, 60)).tolist())),
        "chain": [(k, k + 1) for k in range(200)],
        "star": [(k, 500) for k in range(100)],
        "none": [],
    }[kind]
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    got = {r.node: r.root for r in util.components(df).collect()}
    nodes = {x for p in links for x in p}
    want = {n: r for n, r in smallest(links, nodes).items() if n != r}
    assert got == want


def test_nulls_and_loops_are_no_links(spark):
    df = spark.createDataFrame([(1, 1), (None, 2), (3, None)], "a long, b long")
    assert util.components(df).count() == 0


def test_bloom_loses_nothing(spark):
    df = spark.createDataFrame([(int(x),) for x in np.random.default_rng(1).integers(-(2**62), 2**62, 400)], "id long")
    some = df.limit(100)
    hit, miss = util.split_by_bloom(df, "id", some)
    assert hit.join(some, "id", "left_semi").count() == 100 and hit.count() + miss.count() == 400
    bits = util.bloom_bits(some)
    ids = np.array([r.id for r in some.collect()], np.int64).view(np.uint64)
    assert util.bloom_has(bits, ids).all()


def test_filters_beyond_their_bound_keep_all(spark, monkeypatch):
    assert util.filter_words(1000, 1 << 20) * 64 >= 8000 and util.filter_words(1 << 40, 1 << 20) is None
    monkeypatch.setattr(util, "ARRAY_WORDS", 1)
    monkeypatch.setattr(util, "TABLE_WORDS", 1)
    df = spark.createDataFrame([(x,) for x in range(100)], "id long")
    hit, miss = util.split_by_bloom(df, "id", df.limit(5))
    assert hit.count() == 100 and miss.count() == 0
    assert util.bloom_bits(df) is None and util.bloom_has(None, np.arange(3, dtype=np.uint64)).all()


def test_hot_join(spark):
    rows = spark.createDataFrame([(k % 7 if k < 300 else 99, k) for k in range(1000)], "k long, v long")
    table = spark.createDataFrame([(k, str(k), n) for k, n in ((0, 43), (1, 43), (2, 43), (99, 700))], "k long, w string, n long")
    want = sorted(map(tuple, rows.join(table.drop("n"), "k").collect()))
    for least in (10, 10_000):
        assert sorted(map(tuple, util.hot_join(rows, table, "k", "n", parts=4, least=least).select("k", "v", "w").collect())) == want
