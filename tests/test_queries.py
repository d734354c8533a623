import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from recordspark import plans

SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, (decimal.Decimal, float)) and not (isinstance(x, float) and math.isnan(x)):
        return round(float(x), 4)
    if isinstance(x, datetime.datetime) and (x.hour, x.minute, x.second, x.microsecond) == (0, 0, 0, 0):
        return x.date().isoformat()
    if isinstance(x, (datetime.date, datetime.datetime)):
        return x.isoformat()
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    got = sorted([tuple(map(plain, (r[c] for c in sorted(df.columns)))) for r in df.collect()], key=str)
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    res = duck.execute(sql)
    columns = [d[0] for d in res.description]
    at = [columns.index(c) for c in sorted(columns)]
    expected = sorted([tuple(plain(r[i]) for i in at) for r in res.fetchall()], key=str)
    assert sorted(columns) == sorted(df.columns)
    assert len(got) == len(expected)
    assert [[(c, a, b) for c, a, b in zip(sorted(df.columns), *x, strict=True) if a != b] for x in zip(got, expected, strict=True) if x[0] != x[1]][:3] == []
