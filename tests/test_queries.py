"""Every registered query against its DuckDB twin on the smallest tables."""

import math
from datetime import date
from decimal import Decimal

import duckdb
import pytest

from skyledger.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    fix = lambda x: float(x) if isinstance(x, Decimal) else x.isoformat() if isinstance(x, date) else x
    return sorted((tuple(map(fix, r)) for r in rows), key=lambda r: [(x is None, str(x) if isinstance(x, (str, bool)) or x is None else f"{x:030.6f}") for x in r])


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    if name not in registry.ORACLE_SQL:
        assert got
        return
    res = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in res.fetchall()]
    for a, b in zip(plain(got), plain(want), strict=True):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
