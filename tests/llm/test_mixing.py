from collections import Counter
from fractions import Fraction

import duckdb
import pytest
from common import ODD, clash, directory, docs, frame, plain

from farside.llm import mixing


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 97, "b": 1, "c": 1, "d": 50}, {f"s{k}": k + 1 for k in range(20)}])
def test_every_prefix_is_within_one_block(weights):
    total = sum(weights.values())
    slots = mixing.period(weights)
    assert Counter(slots) == weights
    seen = Counter()
    for t, s in enumerate(slots * 3, 1):
        seen[s] += 1
        assert all(abs(Fraction(w * t, total) - seen[n]) < 1 for n, w in weights.items())


def test_deadlines_hold():
    weights = {"a": 5, "b": 3, "c": 3, "d": 1}
    seen = Counter()
    for t, s in enumerate(mixing.period(weights)):
        k, w = seen[s], weights[s]
        assert k * 12 // w <= t < -(-(k + 1) * 12 // w)
        seen[s] += 1


def test_mix_of_rows(spark):
    rows = [(k, f"t{k}", "en", "abc"[min(2, k % 7 // 3)], 1) for k in range(700)]
    out = frame(mixing.mix(docs(spark, rows).repartition(4), {"a": 3, "b": 2}, 1, 4)).sort_values("position")
    assert len(out) == 700 and out.position.is_unique and sorted(out.doc_id) == list(range(700))
    total = Counter(out.source)
    for n in range(1, 41):  # slots of four rows while no source has ended
        taken = Counter(out.source[: 4 * n])
        assert all(abs(Fraction(w * n, 6) - Fraction(taken[s], 4)) < 1 for s, w in {"a": 3, "b": 2, "c": 1}.items())
    assert total == Counter(r[3] for r in rows)
    for s, part in out.groupby("source"):
        assert sorted(part.source_rank) == list(range(len(part)))


def test_mixed_order_of_files(spark, tmp_path):
    rows = [(k, f"t{k}", "en", "ab"[k % 2], 1) for k in range(200)]
    df = docs(spark, rows)
    mixing.mixed(df, weights={"a": 1}, block=1).write.parquet(f"{tmp_path}/out")
    order = [r.doc_id for p in sorted((tmp_path / "out").glob("part-*")) for r in spark.read.parquet(str(p)).collect()]
    want = [r.doc_id for r in mixing.mix(df, {"a": 1}, 1, 1).orderBy("position").collect()]
    assert order == want and all(a % 2 != b % 2 for a, b in zip(order, order[1:]))


def test_odd_rows(spark):
    df = clash(docs(spark, [*ODD, ODD[3], ODD[4], (None, None, None, None, None)]), "slot", "block", "_source", "_hash")
    out = frame(mixing.mix(df))
    assert len(out) == 9 and list(out.columns) == [*df.columns, "source_rank", "_block", "_slot", "position"]
    assert out.position.is_unique
    assert mixing.mix(plain(spark, [])).count() == 0 and mixing.mixed(plain(spark, [])).count() == 0
    for wrong in ({"weights": {"s": 0}}, {"weights": {"s": 1.5}}, {"block": 0}):
        with pytest.raises(ValueError):
            mixing.mix(df, **wrong)


def test_query_like_sql(spark, tmp_path):
    rows = [(k, f"t{k}", "en", f"src{k % 23 % 6}" if k % 31 else None, 1) for k in range(900)]
    d = directory(tmp_path, documents=docs(spark, rows))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    ours = mixing.op6_mixing(spark, d)
    names = sorted(ours.columns)
    assert sorted(map(tuple, ours.select(*names).collect()), key=str) == sorted(con.sql(mixing.SQL).select(*names).fetchall(), key=str)
