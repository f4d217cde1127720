"""Every registered query against its SQL twin on the smallest supplied tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from checks.registry import all_checks

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables are missing")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if isinstance(value, (float, Decimal)):
        return None if math.isnan(value) else float(f"{float(value):.10g}")
    return value


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(all_checks()))
def test_query(spark, duck, name):
    item = all_checks()[name]
    df = item.run(spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if item.sql is None:
        return
    found = duck.execute(item.sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    wanted = [tuple(plain(r[i]) for i in places) for r in found.fetchall()]
    assert in_order(rows) == in_order(wanted)
