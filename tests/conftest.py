from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import SparkSession

from sluicewatch import TELEMETRY_SCHEMA, signals

AS_OF = datetime(2024, 3, 14, 12, 0, 0)  # a Thursday


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def ago(**span) -> datetime:
    return AS_OF - timedelta(**span)


def row(
    at=AS_OF, runtime="runtime-a", component="c", kind="METRIC", metric=None, value=None
) -> tuple:
    """One telemetry row; None leaves the attribute out."""
    return (
        at,
        kind,
        {} if runtime is None else {"k8s.namespace.name": runtime},
        {} if component is None else {"name": component},
        ((metric,),),
        value,
    )


def log(at=AS_OF, runtime="runtime-a", level="ERROR", logger="p", message="m") -> tuple:
    fields = {"level": level, "loggerName": logger, "formattedMessage": message}
    text = json.dumps({key: value for key, value in fields.items() if value is not None})
    return row(at, runtime, None, "LOG", None, text)


@pytest.fixture(scope="session")
def telemetry(spark):
    return lambda rows: spark.createDataFrame(rows, TELEMETRY_SCHEMA)


@pytest.fixture(scope="session")
def sig(telemetry):
    return lambda rows: signals(telemetry(rows))


def values(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def bag(df) -> list[tuple]:
    return sorted(values(df), key=repr)
