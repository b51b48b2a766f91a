"""Every query of the reference's operators against its SQL, values rounded to 6 places."""

import math
import os
from collections import Counter

import duckdb
import pytest

from terragrid.plans import queries as base

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: None if v is None else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "is_integer") and not isinstance(v, bool) else v
    assert all(not (isinstance(v, float) and math.isnan(v)) for r in rows for v in r)
    return sorted(c.lower() for c in columns), Counter(tuple(show(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(base.QUERIES))
def test_query(spark, duck, name):
    df = base.QUERIES[name](spark, SF)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in base.ORACLE:
        assert got[1]
        return
    want = duck.execute(base.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert got == _rows(columns, want.fetchall())
