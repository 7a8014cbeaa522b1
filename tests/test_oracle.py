"""Every registered query of the library against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from quillstream.plans.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    own = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in SQL:
        assert own
        return
    found = duck.sql(SQL[name])
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    assert sorted(df.columns) == sorted(found.columns)
    assert sorted(own, key=repr) == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
