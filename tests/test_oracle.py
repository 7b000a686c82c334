"""Every query of the engine against its SQL, on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from skeinwork.plans import oracle, queries  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = ("orders", "events", "documents", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return f"{float(v):.9g}" if type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(oracle.STATEMENTS))
def test_query_matches_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    found = duck.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    expected = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert got == expected


def test_every_statement_has_its_query():
    assert set(oracle.STATEMENTS) <= set(queries.queries())
