"""Every query of the imaging chain against its SQL."""

import math

import duckdb
import pytest

from farside.plans.oracle import ORACLE_SQL
from farside.plans.queries import QUERIES

TABLES = "part embeddings".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame):
    clean = lambda v: None if v is None or v != v else v + 0.0 if isinstance(v, float) else bool(v) if isinstance(v, bool) else v
    return sorted((tuple(clean(v) for v in r) for r in frame), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf_dir, db, name):
    ours = QUERIES[name](spark, sf_dir)
    theirs = db.sql(ORACLE_SQL[name])
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    a = rows(ours.select(*names).collect())
    b = rows(theirs.select(*names).fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and math.isclose(p, q, abs_tol=1e-12)) for p, q in zip(x, y)), (x, y)
