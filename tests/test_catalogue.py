"""Every query against its SQL on the smallest tables, and the entry point."""

import math
import os

import pytest

from lorekiln.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    found = duck.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
