"""Every registered query against its DuckDB oracle at sf0.001 (the driver
does the same at sf0.01), plus the entry() smoke check."""

import decimal
import os
import re

import duckdb
import pytest

import __spark_entry__ as E

from conftest import SF_SMALL


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "orders", "part", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["vendor_id", "product_id", "year", "month", "day", "quantity", "name"]


# The numbered queries are optional and have tests of their own.
NAMES = sorted(n for n in E.queries() if n != "pipeline" and not re.match(r"op\d+_", n))


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    sql = E.oracle_sql()[name]
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    want = sorted((tuple(norm(v) for v in r) for r in con.sql(
        f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql})").fetchall()), key=repr)
    assert got == want
