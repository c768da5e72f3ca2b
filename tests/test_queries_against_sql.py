"""Every registered query against its SQL on the smallest tables."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from attestor.plans import oracles
from attestor.plans import queries as registry

SF = Path("/root/testdata/sf0.001")
QUERIES, CHECKS = registry.registered(), oracles.all_checks()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float, decimal.Decimal)):
        return (2, repr(float(value)))
    return (3, str(value))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, str(SF))
    result = tables.execute(CHECKS[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    expected = _rows(columns, result.fetchall())
    assert _rows(df.columns, df.collect()) == expected
    assert expected or name == "ledger_lookup"
