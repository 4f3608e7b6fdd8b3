"""Every catalogue query gives the rows and types of its SQL on an independent engine."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tessera import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def rows(table):
    df = table.to_pandas()
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def types(schema):
    return {f.name: str(f.type).replace("large_", "") for f in schema}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    found = QUERIES[name](spark, sf_dir).toArrow()
    if name not in ORACLES:
        assert found.num_rows > 0
        return
    wanted = duck.sql(ORACLES[name]).to_arrow_table()
    assert types(found.schema) == types(wanted.schema)
    assert rows(found) == rows(wanted)
