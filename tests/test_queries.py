"""Every registered crosswalk query against its SQL, on the smallest folder."""

import os

import duckdb
import pytest

from cartulary import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables():
    con = duckdb.connect()
    for n in os.listdir(SF):
        con.execute(f"create view {n.removesuffix('.parquet')} as from '{SF}/{n}'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(round(r[i], 5) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, tables, name):
    df = plans.queries()[name](spark, SF)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if name in plans.oracle_sql():
        want = tables.execute(plans.oracle_sql()[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        assert got == _rows(names, want.fetchall())
