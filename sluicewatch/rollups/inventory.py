"""Inventory and current state from roll-ups: no report here reads signals.

``INVENTORY`` has the first and last event of every runtime and date. ``CURRENT`` has three
marks per processor that tell its latest run status, one row for each processor however
long its history is. Minima and maxima merge in any order.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicewatch.functions.predicates import in_runtimes
from sluicewatch.functions.timewin import AsOf, ntz, resolve_as_of
from sluicewatch.functions.vocabulary import RUN_STATUS
from sluicewatch.operators.status import (
    described_runtimes,
    is_stopped,
    run_status_marks,
    stopped_per_runtime,
)
from sluicewatch.rollups.table import Rollup

_MARKS = ("last_seen", "last_zero", "last_positive")


def _first_and_last(sig: DataFrame) -> DataFrame:
    """Of every runtime and date, rows without a runtime or a time included."""
    return sig.groupBy("runtime", "event_date").agg(
        F.min("timestamp").alias("first_event"), F.max("timestamp").alias("last_event")
    )


INVENTORY = Rollup(
    _first_and_last,
    T.StructType(
        [
            T.StructField("runtime", T.StringType()),
            T.StructField("event_date", T.DateType()),
            T.StructField("first_event", T.TimestampNTZType()),
            T.StructField("last_event", T.TimestampNTZType()),
        ]
    ),
    {"first_event": "min", "last_event": "max"},
)

CURRENT = Rollup(
    lambda sig: run_status_marks(sig.where(F.col("metric_name") == RUN_STATUS)),
    T.StructType(
        [
            T.StructField("runtime", T.StringType()),
            T.StructField("component", T.StringType()),
            *(T.StructField(mark, T.TimestampNTZType()) for mark in _MARKS),
        ]
    ),
    dict.fromkeys(_MARKS, "max"),
)


def known_runtimes(inventory: DataFrame) -> DataFrame:
    """As :func:`sluicewatch.known_runtimes`, from rows of an ``INVENTORY`` table."""
    return _spans(inventory).select("name", "created_on")


def last_events(inventory: DataFrame) -> DataFrame:
    """As :func:`sluicewatch.last_events`, from rows of an ``INVENTORY`` table."""
    return _spans(inventory).select("name", "last_event_time")


def active_runtimes(
    inventory: DataFrame, as_of: AsOf = None, inactivity_hours: float = 24
) -> DataFrame:
    """As :func:`sluicewatch.active_runtimes`; reads the dates from the cutoff on."""
    cutoff = resolve_as_of(as_of) - timedelta(hours=inactivity_hours)
    recent = (F.col("event_date") >= F.lit(cutoff.date())) & (F.col("last_event") > ntz(cutoff))
    return inventory.where(recent).select(F.col("runtime").alias("active_runtime_name")).distinct()


def runtime_status(
    inventory: DataFrame,
    as_of: AsOf = None,
    inactivity_hours: float = 24,
    user_only: bool = True,
) -> DataFrame:
    """As :func:`sluicewatch.runtime_status`, from rows of an ``INVENTORY`` table."""
    return described_runtimes(_spans(inventory), as_of, inactivity_hours, user_only)


def processor_status(
    current: DataFrame, as_of: AsOf = None, hours: float = 1, runtimes: Sequence[str] | None = None
) -> DataFrame:
    """As :func:`sluicewatch.processor_status`, from rows of a ``CURRENT`` table.

    A processor that reported within the last hours did so last within these, and its
    last report is what its marks tell.
    """
    cutoff = ntz(resolve_as_of(as_of) - timedelta(hours=hours))
    latest = CURRENT.merged(current.where(in_runtimes(runtimes)))
    return latest.where(F.col("last_seen") > cutoff).select(
        "runtime",
        F.col("component").alias("processor"),
        "last_seen",
        is_stopped().alias("is_stopped"),
    )


def stopped_processors(
    current: DataFrame, as_of: AsOf = None, hours: float = 1, runtimes: Sequence[str] | None = None
) -> DataFrame:
    """As :func:`sluicewatch.stopped_processors`, from rows of a ``CURRENT`` table."""
    return stopped_per_runtime(processor_status(current, as_of, hours, runtimes))


def _spans(inventory: DataFrame) -> DataFrame:
    known = inventory.where(F.col("runtime").isNotNull())
    merged = INVENTORY.merged(known, F.col("runtime").alias("name"))
    return merged.withColumnsRenamed({"first_event": "created_on", "last_event": "last_event_time"})
