"""Every query with a SQL form against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from relata.plans.queries import ORACLES, QUERIES

TABLES = Path("/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in TABLES.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.skipif(not TABLES.exists(), reason="no generated tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, str(TABLES))
    columns = sorted(df.columns)
    found = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    relation = duck.sql(ORACLES[name])
    assert {c: TYPES[df.schema[c].dataType.simpleString()] for c in columns} == dict(zip(relation.columns, map(str, relation.types)))
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert found == sorted(map(repr, duck.sql(f"select {quoted} from ({ORACLES[name]})").fetchall()))
