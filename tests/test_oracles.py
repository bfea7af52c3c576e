"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from quarry.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows, names, order):
    at = [names.index(n) for n in order]
    return sorted((tuple(round(v, 5) if isinstance(v, float) and not math.isnan(v) else v for v in (r[i] for i in at)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    sql = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in sql.description]
    assert sorted(df.columns) == sorted(names)
    want, got = plain(sql.fetchall(), names, sorted(names)), plain(df.collect(), df.columns, sorted(names))
    assert want and got == want
