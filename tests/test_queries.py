"""Every registered query of the engine runs on the smallest tables and agrees with its SQL."""

import os

import duckdb
import pytest

from tsymbol.plans import queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events", "documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    spark.catalog.clearCache()
    if name in q.ORACLE_SQL:
        cursor = duck.execute(q.ORACLE_SQL[name])
        names = [d[0] for d in cursor.description]
        want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
        assert rows == want
    else:
        assert rows
