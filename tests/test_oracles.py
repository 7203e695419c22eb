"""Every query with SQL gives the SQL's rows."""

import duckdb
import pytest

from tributary.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = sorted(x[0] for x in want.description)
    assert sorted(got.columns) == columns
    index = {x[0]: k for k, x in enumerate(want.description)}
    order = lambda rows: sorted(rows, key=repr)
    left = order([tuple(r[c] for c in columns) for r in got.collect()])
    right = order([tuple(r[index[c]] for c in columns) for r in want.fetchall()])
    assert left, "an empty result tests nothing"
    assert left == right
