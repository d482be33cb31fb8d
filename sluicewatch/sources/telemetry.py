"""The telemetry table: one row per log record or metric sample."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicewatch.functions.timewin import AsOf, ntz, resolve_as_of
from sluicewatch.functions.vocabulary import (
    COMPONENT_KEY,
    LOG,
    METRIC,
    QUEUED_BYTES,
    QUEUED_DURATION,
    RUN_STATUS,
    RUNTIME_KEY,
)

TELEMETRY_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("resource_attributes", T.MapType(T.StringType(), T.StringType())),
        T.StructField("record_attributes", T.MapType(T.StringType(), T.StringType())),
        T.StructField(
            "record",
            T.StructType(
                [
                    T.StructField(
                        "metric", T.StructType([T.StructField("name", T.StringType())])
                    )
                ]
            ),
        ),
        T.StructField("value", T.StringType()),
    ]
)

EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def telemetry_table(spark: SparkSession, name: str) -> DataFrame:
    """Telemetry registered in the catalog; the name is the caller's to configure."""
    return spark.table(name)


def read_telemetry(spark: SparkSession, *paths: str) -> DataFrame:
    """Telemetry stored as Parquet."""
    return spark.read.parquet(*paths)


def telemetry_since(
    telemetry: DataFrame, as_of: AsOf = None, hours: float = 24, until: AsOf = None
) -> DataFrame:
    """Telemetry later than ``as_of - hours`` (strictly), for reports on windows up to that.

    Signals count time as UTC wall clock, computed from the instants of a ``TIMESTAMP``
    column, which hides the reports' windows from the scan. This bound is on the instants
    themselves, the same in any session time zone, and reaches the scan: row groups, and
    partitions of a table that knows how, are skipped by it. ``until`` is an inclusive
    upper bound, for a past moment as it looked then; by default there is none.
    """
    start = resolve_as_of(as_of) - timedelta(hours=hours)
    kind = telemetry.schema["timestamp"].dataType
    found = telemetry.where(F.col("timestamp") > _moment(start, kind))
    return found if until is None else found.where(F.col("timestamp") <= _moment(resolve_as_of(until), kind))


def _moment(moment: datetime, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.lit(moment.replace(tzinfo=timezone.utc))
    return ntz(moment)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The ``events`` test table; its schema is given, so nothing is inferred."""
    return spark.read.schema(EVENTS_SCHEMA).parquet(path)


def telemetry_from_events(events: DataFrame) -> DataFrame:
    """Telemetry derived row by row from the ``events`` test table."""
    return events.selectExpr(
        "ts AS timestamp",
        f"CASE WHEN {_IS_LOG} THEN '{LOG}' ELSE '{METRIC}' END AS record_type",
        f"map('{RUNTIME_KEY}', {_RUNTIME}) AS resource_attributes",
        f"map('{COMPONENT_KEY}', {_COMPONENT}) AS record_attributes",
        f"named_struct('metric', named_struct('name', {_METRIC_NAME})) AS record",
        f"CASE WHEN {_IS_LOG} THEN {_LOG_TEXT} ELSE string({_SAMPLE}) END AS value",
    )


_IS_LOG = "event_type IN ('error', 'click')"
_RUNTIME = """CASE
    WHEN user_id % 20 = 0 THEN NULL
    WHEN user_id % 10 = 1 THEN concat('system-', user_id % 3)
    ELSE concat('runtime-', user_id % 6) END"""
_COMPONENT = "CASE WHEN event_id % 50 <> 0 THEN concat('conn-', event_id % 7) END"
_METRIC_NAME = f"""CASE event_type
    WHEN 'view' THEN '{QUEUED_BYTES}'
    WHEN 'purchase' THEN '{QUEUED_DURATION}'
    WHEN 'signup' THEN '{RUN_STATUS}' END"""
_SAMPLE = """CASE event_type
    WHEN 'view' THEN floor(value * 1000000)
    WHEN 'purchase' THEN floor(value * 60000)
    WHEN 'signup' THEN event_id % 2 END"""
_LOG_TEXT = """concat(
    '{"level":"', if(event_type = 'error', 'ERROR', 'INFO'),
    '","loggerName":"proc-', event_id % 9,
    '","formattedMessage":"Failure code ', user_id, ' step ', event_id % 13,
    if(event_id % 97 = 0, '', '"}'))"""
