"""Every registered query of the library proper against its DuckDB SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from docloom.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    num = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
    return sorted(tuple(repr(float(x)) if num(x) else repr(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = con.execute(ORACLES[name])
    at = [[d[0] for d in found.description].index(c) for c in cols]
    want = plain([tuple(r[i] for i in at) for r in found.fetchall()])
    assert plain([tuple(r[c] for c in cols) for r in df.collect()]) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
