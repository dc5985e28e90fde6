"""Prefix trees of conversations against brute force and SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from farside.llm import tries

COLUMNS = "conv_id long, turn long, role string, text string"
EXPECTED = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [t for *_, t in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    for node in members:
        below, todo = [], [node]
        while todo:
            n = todo.pop()
            below.append(n)
            todo += children[n]
        ends = sorted(c for c in members[node] if len(convs[c]) == len(node))
        out.append((
            min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]),
            sum(not children[n] for n in below), sum((len(members[n]) - 1) * len(n[-1][1].encode().split()) for n in below if n),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def shown(df):
    assert df.columns == EXPECTED
    return sorted((tuple(r) for r in df.collect()), key=repr)


def some_rows(seed, n=150, letters=2, depth=7):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.randrange(1, depth)):
            rows.append((c, t, rng.choice(("user", None)), rng.choice(("a b", "c", "", None)[: letters + 1])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [1, 3, 40])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_trees_over_many_ranges(spark, parts, seed, monkeypatch):
    monkeypatch.setattr(tries, "CHUNK", 3)
    rows = some_rows(seed)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, COLUMNS)
        assert shown(tries.nodes(tries.rebuilt(tries.turns_of(df)))) == brute(rebuilt(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_cuts_between_ranges_anywhere():
    """The sums do not depend on where sorted keys are cut, down to one key a range."""
    convs = rebuilt(some_rows(3, 40))
    turns = [(c, [{"digest": hashlib.sha256(repr(t).encode()).digest()[:16], "words": len(t[1].split())} for t in v]) for c, v in convs.items()]
    import pyarrow as pa

    (batch,) = tries._keys([pa.RecordBatch.from_arrays([pa.array([c for c, _ in turns]), pa.array([t for _, t in turns], pa.list_(pa.struct([("digest", pa.binary()), ("words", pa.int32())])))], names=["c", "t"])])
    keys = sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    want = brute(convs)
    rng = random.Random(9)
    for size in (1, 2, 3, 7, 100):
        cuts = sorted(rng.sample(range(1, len(keys)), min(len(keys) - 1, len(keys) // size))) if size < 100 else []
        sums, closed, before = defaultdict(lambda: [0, 0, 0, 0]), [], None
        for part in (keys[a:b] for a, b in zip([0, *cuts], [*cuts, len(keys)])):
            tree = tries._Tree()
            for k in part:
                tree.put(*k)
            tree.finish()
            found = list(tree.rows)
            if before is not None:
                for b in tries._seams([pa.RecordBatch.from_arrays([pa.array([part[0][0]]), pa.array([before])], names=["a", "b"])]):
                    found += [tuple(r.values()) for r in b.to_pylist()]
            before = part[-1][0]
            for r in found:
                if r[0] == tries.PART:
                    sums[r[1], r[3]] = [x + y for x, y in zip(sums[r[1], r[3]], r[6:10])]
                elif r[0] == tries.EDGE:
                    closed += [(r[3] - len(r[4]) + 1 + k, r[6], r[7] if k == len(r[4]) - 1 else 1, r[8], r[9] + (r[6] - 1) * m) for k, m in enumerate(r[4])]
        got = sorted([(d, *v) for (_, d), v in sums.items()] + closed)
        assert got == sorted((r[1], *r[3:7]) for r in want)


def test_query_and_sql(spark, sf_dir):
    got = shown(tries.op13_prefix_trie(spark, sf_dir))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == brute(rebuilt(rows))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    theirs = con.sql(tries.SQL)
    assert theirs.columns == EXPECTED and sorted(theirs.fetchall(), key=repr) == got


def test_hot_beginning_copies_and_a_long_conversation(spark):
    """A common first turn, one conversation copied a thousand times, one of 3,000 turns."""
    rows = [(c, t, "u", "hello" if t == 0 else f"{c} {t}" if c % 3 else f"same {t}") for c in range(1500) for t in range(2)]
    rows += [(9000, t, "u", "hello" if t == 0 else f"long {t}") for t in range(3000)]
    df = spark.createDataFrame(rows, COLUMNS)
    got = {(r.conv_id, r.depth): r for r in tries.prefix_trie(df).collect()}
    assert len(got) == 1 + 1 + 1000 + 1 + 2999
    root, hello, same = got[0, 0], got[0, 1], got[0, 2]
    assert (root.n_convs, root.n_children, root.n_leaves) == (1501, 1, 1002) and (hello.n_convs, hello.n_children) == (1501, 1002)
    assert same.n_convs == 500 and same.ends_sha256 == hashlib.sha256(",".join(str(c) for c in range(0, 1500, 3)).encode()).hexdigest()
    assert root.saved_tokens == 1500 + 499 * 2 and got[9000, 3000].parent_conv_id == 9000 and got[9000, 2].parent_conv_id == 0


def test_odd_rows(spark):
    rows = [(None, 1, "u", "x"), (3, None, None, None), (3, 2, "u", " \n"), (3, 2, "u", " \n"), (3, 1, "u", "x y"), (7, 1, None, ""), (7, None, None, "")]
    df = spark.createDataFrame(rows, COLUMNS)
    crowded = df.selectExpr("*", "'a' as key", "'b' as kind", "1L as depth", "2 as turns")
    assert shown(tries.nodes(tries.rebuilt(tries.turns_of(crowded)))) == brute(rebuilt(rows))
    assert tries.prefix_trie(df.limit(0)).count() == 0
