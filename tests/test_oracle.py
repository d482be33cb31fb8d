"""Every registered query against its SQL oracle, run by an independent engine."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

TESTDATA = "/root/testdata"
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
    "boolean": "BOOLEAN",
}
QUERIES, ORACLES = entry.report_queries(), entry.report_oracles()


def comparable(value):
    return round(value, 9) if isinstance(value, float) else value


def tables(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(comparable(r[i]) for i in order) for r in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, name, scale):
    folder = f"{TESTDATA}/sf{scale}"
    found = QUERIES[name](spark, folder)
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
        expected = db.sql(ORACLES[name])
        types = dict(zip(expected.columns, map(str, expected.types)))
        expected_rows = expected.fetchall()
    assert {f.name: TYPES[f.dataType.simpleString()] for f in found.schema} == types
    assert tables(found.columns, found.collect()) == tables(list(types), expected_rows)


def test_flagship(spark):
    assert len(entry.entry(spark).collect()) == 40
