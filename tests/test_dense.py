"""The oracle comparison again, over events made dense, tied and incomplete.

The test table spreads its events over a month, so that the default windows of
half an hour and an hour see next to nothing. Here the same events fall into the
last three hours at whole minutes, and many lack a time, a user or a value.
"""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import sluicewatch as sw
from tests.test_oracle import ORACLES, QUERIES, TESTDATA, tables

@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("dense"))
    events = sw.read_events(spark, f"{TESTDATA}/sf0.01/events.parquet")
    minute = F.make_dt_interval(mins=(F.pmod(F.xxhash64("event_id"), F.lit(181))).cast("int"))

    def missing(column, every, rest):
        return F.when(F.col("event_id") % every != rest, F.col(column)).alias(column)

    dense = events.select(
        "event_id",
        F.when(
            F.col("event_id") % 23 != 5, F.expr(f"timestamp_ntz'{entry.AS_OF}'") - minute
        ).alias("ts"),
        missing("user_id", 7, 3),
        "event_type",
        missing("value", 5, 2),
        "props",
    )
    dense.coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, folder, name):
    found = QUERIES[name](spark, folder)
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
        expected = db.sql(ORACLES[name])
        columns, rows = expected.columns, expected.fetchall()
    assert tables(found.columns, found.collect()) == tables(columns, rows)


@pytest.mark.parametrize("name", ["high_error_runtimes_30min", "stopped_processors_1h"])
def test_default_windows_are_not_empty(spark, folder, name):
    assert len(QUERIES[name](spark, folder).collect()) > 2
