"""Every query of the ledger against its SQL, on the smallest tables."""

import duckdb
import pytest

from tallyforge import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([str(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in found.collect()]
    if name not in catalog.SQL:
        assert rows
        return
    want = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(found.columns)
    assert canonical(rows, found.columns) == canonical(want.fetchall(), columns)
