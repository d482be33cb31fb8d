"""Registered queries against SQL, where SQL can express them."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from sluicewatch.llm import queries

TABLES = ("documents", "pages", "benchmark", "labels", "conversations", "embeddings")
QUERIES, ORACLES = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    folder = "/root/testdata/sf0.001"
    found = QUERIES[name](spark, folder)
    with duckdb.connect() as db:
        for table in TABLES:
            db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
        expected = db.sql(ORACLES[name])
        columns, rows = expected.columns, expected.fetchall()
    assert sorted(found.columns) == sorted(columns)
    assert Counter(map(tuple, found.select(columns).collect())) == Counter(rows)


@pytest.mark.parametrize("name", ["op3_toxicity", "op9_line_crf"])
def test_held_out_accuracy(spark, name):
    folder = "/root/testdata/sf0.1"
    label = {"op3_toxicity": "toxic", "op9_line_crf": "quality"}[name]
    marks = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", label)
    rows = QUERIES[name](spark, folder).join(marks, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r[label] for r in rows) / len(rows)
    assert len(rows) > 300 and right > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
