"""Every registered query with SQL against DuckDB, on whole tables."""

import math
import os

import duckdb
import pytest
from weftgraph import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(found):
    return sorted(([round(x, 9) if isinstance(x, float) and not math.isnan(x) else x for x in r] for r in found), key=repr)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = db.execute(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert rows(map(list, df.select(*cols).collect())) == rows(map(list, want))
    assert want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
