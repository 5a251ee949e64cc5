import math
import os
from decimal import Decimal

import pytest

from corpusloom import queries as q
from corpusloom import files, jobs, reports, runs

assert files and jobs and reports and runs  # register their queries
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _row(names, row):
    fix = lambda v: round(float(v), 6) if isinstance(v, float | Decimal) else v
    return tuple(fix(v) for _, v in sorted(zip(names, row, strict=True)))


def _key(row):
    return tuple((v is None, "" if v is None else str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = q.queries()[name](spark, SF)
    rel = duck.sql(q.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got = sorted((_row(df.columns, r) for r in df.collect()), key=_key)
    want = sorted((_row(rel.columns, r) for r in rel.fetchall()), key=_key)
    assert len(got) == len(want) and len(want) > 0
    for a, b in zip(got, want, strict=True):
        assert all((isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=2e-6)) or x == y for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_query_has_rows(spark, name):
    assert q.queries()[name](spark, SF).count() > 0
