"""Every query with SQL against that SQL on the smallest test tables."""

import os

import pytest

from quillgraph.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def shown(rows):
    return sorted(tuple("~" if x is None or x != x else f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    cursor = duck.execute(f"SELECT {', '.join(cols)} FROM ({registry.ORACLES[name]})")
    assert shown(map(tuple, got)) == shown(cursor.fetchall())


def test_every_query_has_sql_or_a_reason():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"p1_found", "p1_flags"}
