"""State of processors and runtimes."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicewatch.functions.predicates import in_runtimes, is_user_runtime
from sluicewatch.functions.timewin import AsOf, ntz, resolve_as_of, within
from sluicewatch.functions.vocabulary import (
    ACTIVE,
    INACTIVE,
    INTERNAL,
    RUN_STATUS,
    USER_CREATED,
)


def run_status_marks(samples: DataFrame, *keys: Column, more: Sequence[Column] = ()) -> DataFrame:
    """Three marks per processor (and per further ``keys``) that tell its latest run status.

    ``more`` aggregates come along. Rows without a timestamp leave no mark.

    The latest sample decides; among samples of the same instant the largest
    value does, NULL being the smallest. So a processor is stopped exactly when
    its newest instant holds a zero and no positive value. Maxima of timestamps
    combine map-side in a hash aggregate: a processor with most of the samples
    shuffles one row per task, and nothing is sorted.
    """
    value, seen = F.col("value_num"), F.col("timestamp")
    return samples.groupBy(*keys, "runtime", "component").agg(
        F.max(seen).alias("last_seen"),
        F.max(F.when(value == 0, seen)).alias("last_zero"),
        F.max(F.when(value > 0, seen)).alias("last_positive"),
        *more,
    )


def is_stopped() -> Column:
    """Whether :func:`run_status_marks` show a stopped processor."""
    seen, zero, positive = F.col("last_seen"), F.col("last_zero"), F.col("last_positive")
    return F.coalesce((zero == seen) & (positive.isNull() | (positive < seen)), F.lit(False))


def processor_status(
    sig: DataFrame, as_of: AsOf = None, hours: float = 1, runtimes: Sequence[str] | None = None
) -> DataFrame:
    """Processors that reported a run status in the last hours, and whether they stopped."""
    samples = sig.where(
        (F.col("metric_name") == RUN_STATUS)
        & within(as_of, timedelta(hours=hours))
        & in_runtimes(runtimes)
    )
    return run_status_marks(samples).select(
        "runtime",
        F.col("component").alias("processor"),
        "last_seen",
        is_stopped().alias("is_stopped"),
    )


def stopped_processors(
    sig: DataFrame, as_of: AsOf = None, hours: float = 1, runtimes: Sequence[str] | None = None
) -> DataFrame:
    """Stopped processors per runtime.

    A processor that reported nothing in the last hours is not counted.
    """
    return stopped_per_runtime(processor_status(sig, as_of, hours, runtimes))


def stopped_per_runtime(processors: DataFrame) -> DataFrame:
    """How many of each runtime's processors are stopped, where any is."""
    stopped = processors.where("is_stopped").groupBy("runtime")
    return stopped.agg(F.count("*").alias("stopped_count"))


def known_runtimes(sig: DataFrame) -> DataFrame:
    """Every runtime ever seen, with its first event as ``created_on``."""
    return (
        sig.where(F.col("runtime").isNotNull())
        .groupBy(F.col("runtime").alias("name"))
        .agg(F.min("timestamp").alias("created_on"))
    )


def last_events(sig: DataFrame) -> DataFrame:
    """Last event of every runtime ever seen."""
    return (
        sig.where(F.col("runtime").isNotNull())
        .groupBy(F.col("runtime").alias("name"))
        .agg(F.max("timestamp").alias("last_event_time"))
    )


def active_runtimes(
    sig: DataFrame, as_of: AsOf = None, inactivity_hours: float = 24
) -> DataFrame:
    """Runtimes with an event within the inactivity threshold; may include NULL."""
    return (
        sig.where(within(as_of, timedelta(hours=inactivity_hours)))
        .select(F.col("runtime").alias("active_runtime_name"))
        .distinct()
    )


def runtime_status(
    sig: DataFrame, as_of: AsOf = None, inactivity_hours: float = 24, user_only: bool = True
) -> DataFrame:
    """Inventory of all runtimes ever seen: type, activity, first and last event.

    One pass gives all of it: having an event later than the cutoff is the same
    as having the last event later than the cutoff.
    """
    known = (
        sig.where(F.col("runtime").isNotNull())
        .groupBy(F.col("runtime").alias("name"))
        .agg(
            F.min("timestamp").alias("created_on"),
            F.max("timestamp").alias("last_event_time"),
        )
    )
    return described_runtimes(known, as_of, inactivity_hours, user_only)


def described_runtimes(
    known: DataFrame, as_of: AsOf, inactivity_hours: float, user_only: bool
) -> DataFrame:
    """The inventory of runtimes (``name``, ``created_on``, ``last_event_time``)."""
    cutoff = ntz(resolve_as_of(as_of) - timedelta(hours=inactivity_hours))
    active = F.col("last_event_time") > cutoff
    user_created = is_user_runtime("name")
    return (known.where(user_created) if user_only else known).select(
        "name",
        F.when(user_created, USER_CREATED).otherwise(INTERNAL).alias("type"),
        F.when(active, ACTIVE).otherwise(INACTIVE).alias("status"),
        F.coalesce(active, F.lit(False)).alias("is_active"),
        "created_on",
        "last_event_time",
    )


def runtime_status_totals(status: DataFrame) -> DataFrame:
    """How many of the runtimes displayed are active and inactive."""
    total, active = F.count("*"), F.count_if("is_active")
    return status.agg(
        total.alias("total_runtimes"),
        active.alias("active_runtimes"),
        (total - active).alias("inactive_runtimes"),
    )
