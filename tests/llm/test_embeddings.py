import numpy as np
import pytest
from common import directory, frame, smallest

from farside.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """n_links and component of every row, rows being (id, vector, label) with vectors and ids that can link."""
    x = np.array([v for _, v, _ in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    labels = np.array([r[2] for r in rows])
    close = (x @ x.T >= 0.98) & (labels[:, None] == labels)
    np.fill_diagonal(close, False)
    ids = [r[0] for r in rows]
    comp = smallest([(ids[i], ids[j]) for i, j in zip(*np.nonzero(close))], set(ids))
    return {r[0]: (int(n), comp[r[0]]) for r, n in zip(rows, close.sum(axis=1))}


def made(rng, n=600, dim=16):
    rows = []
    for k in range(n):
        if k % 3 and rows:
            seed = rows[rng.integers(0, len(rows))]
            v = np.array(seed[1]) + (0 if k % 9 == 1 else rng.normal(0, rng.choice([0.01, 0.04, 0.06]), dim))
            label = seed[2] if k % 5 else int(rng.integers(0, 3))
        else:
            v, label = rng.normal(0, 1, dim), int(rng.integers(0, 3))
        rows.append((k, [float(np.float32(z)) for z in v], label))
    return rows


@pytest.mark.parametrize("settings", [{}, {"n_lists": 3, "block": 32}, {"n_lists": 60, "n_parts": 4, "sample_rows": 256}])
def test_all_links_of_equal_labels(spark, settings):
    rows = made(np.random.default_rng(4))
    out = frame(E.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), **settings))
    want = brute(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in out.itertuples()} == want
    assert (out.kept == (out.vec_id == out.component_id)).all() and sum(n for n, _ in want.values()) > 500


def test_index_recall_of_sampled_fit(spark):
    """Fitted on a sample of 256 rows, every row is filed and all links are found: recall 1, above the 0.9 asked for."""
    rows = made(np.random.default_rng(8), 900)
    out = frame(E.near_duplicates(spark.createDataFrame(rows, SCHEMA), sample_rows=256))
    assert out.n_links.sum() / sum(n for n, _ in brute(rows).values()) == 1.0


def test_odd_rows_and_query(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 0.0, 0.0]]
    rows = [(k, v, 1) for k, v in enumerate(odd)]
    rows += [(20, [1.0, 0.0], None), (21, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    rows += [(30, [1.0, 0.0], 1), (31, [2.0, 0.0], 1), (32, [1.0, 0.0], 1), (33, [1.0, 0.0], 2), (40, [0.0, 5.0], 1), (40, [0.0, 5.0], 1), (50, [3e38, 3e38], 1)]
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", n_links int")
    out = frame(E.op1_embedding_dedup(spark, directory(tmp_path, embeddings=df)))
    assert len(out) == len(rows)
    for i in [*range(7), 20, 21, 33, 50]:
        r = out[out.vec_id == i].iloc[0]
        assert (r.n_links, r.component_id, r.kept) == (0, i, True)
    assert out[out.vec_id.isna()].kept.all() and (out[out.vec_id.isna()].n_links == 0).all()
    near = out[out.vec_id.isin([30, 31, 32])]
    assert (near.n_links == 2).all() and (near.component_id == 30).all() and near.kept.sum() == 1
    assert (out[out.vec_id == 40].n_links == 1).all()
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_an_id_of_several_vectors_links_its_classes(spark):
    """Two different vectors under one id, linked with each other and with others: counts are those of vectors."""
    rows = [(1, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.1, 0.0], 1), (1, [0.0, 1.0, 0.0], 1), (2, [1.0, 0.05, 0.0], 1), (3, [0.0, 1.0, 0.05], 1), (4, [0.0, 0.0, -1.0], 1)]
    out = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 0, 4, True)]
