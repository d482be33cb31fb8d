"""Queue metrics, and the joint trend of errors and queue times."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicewatch.functions.predicates import in_runtimes, is_metric, is_user_runtime
from sluicewatch.functions.timewin import AsOf, bucket_for, bucket_start, within
from sluicewatch.functions.vocabulary import ERROR, LOG, METRIC, QUEUED_BYTES, QUEUED_DURATION
from sluicewatch.plans.topk import top_k

MS_PER_MINUTE = 60000
BYTES_PER_MIB = 1024 * 1024


def total_errors() -> Column:
    """Rows of level ERROR in a group, whatever their record type; never NULL."""
    return F.count_if(F.col("level") == ERROR)


def max_queue_minutes() -> Column:
    """Longest queue time of a group in minutes.

    Rows of other metrics contribute 0, so a group of only such rows gives 0;
    samples without a number are left out.
    """
    minutes = F.col("value_num") / MS_PER_MINUTE
    return F.max(F.when(F.col("metric_name") == QUEUED_DURATION, minutes).otherwise(F.lit(0.0)))


def kpi_trend(
    sig: DataFrame,
    as_of: AsOf = None,
    window_hours: float = 24,
    runtimes: Sequence[str] | None = None,
) -> DataFrame:
    """Errors and longest queue time per time bucket and user-created runtime.

    Buckets without rows are absent. The bucket's parts are the grouping keys;
    its timestamp is put together once per group.
    """
    parts = ["event_date"] + ["event_hour"] * (bucket_for(window_hours) == "hour")
    return (
        sig.where(
            F.col("record_type").isin(LOG, METRIC)
            & is_user_runtime()
            & within(as_of, timedelta(hours=window_hours))
            & in_runtimes(runtimes)
        )
        .groupBy(*parts, "runtime")
        .agg(
            total_errors().alias("total_errors"),
            max_queue_minutes().alias("max_queue_minutes"),
        )
        .select(
            bucket_start(*parts).alias("time_bucket"),
            "runtime",
            "total_errors",
            "max_queue_minutes",
        )
        .orderBy("time_bucket", "runtime")
    )


def backpressure(
    sig: DataFrame,
    as_of: AsOf = None,
    window_hours: float = 24,
    min_mib: float = 0,
    k: int = 15,
    runtimes: Sequence[str] | None = None,
) -> DataFrame:
    """Connections with most data waiting, in MiB at the peak."""
    peak = F.max("value_num") / BYTES_PER_MIB
    return _worst_connections(
        sig, QUEUED_BYTES, peak, "peak_queued_mib", min_mib, k, as_of, window_hours, runtimes
    )


def queue_times(
    sig: DataFrame,
    as_of: AsOf = None,
    window_hours: float = 24,
    min_minutes: float = 0,
    k: int = 15,
    runtimes: Sequence[str] | None = None,
) -> DataFrame:
    """Connections with the longest waits, in minutes at the peak."""
    peak = F.max(F.col("value_num") / MS_PER_MINUTE)
    return _worst_connections(
        sig,
        QUEUED_DURATION,
        peak,
        "max_queue_minutes",
        min_minutes,
        k,
        as_of,
        window_hours,
        runtimes,
    )


def _worst_connections(
    sig: DataFrame,
    metric: str,
    peak: Column,
    name: str,
    threshold: float,
    k: int,
    as_of: AsOf,
    window_hours: float,
    runtimes: Sequence[str] | None,
) -> DataFrame:
    """Connections whose peak exceeds the threshold (strictly), highest first.

    Samples that lack the runtime or the connection form one NULL connection.
    """
    connection = F.concat("runtime", F.lit(" | "), "component")
    peaks = (
        sig.where(
            is_metric(metric)
            & within(as_of, timedelta(hours=window_hours))
            & in_runtimes(runtimes)
        )
        .groupBy(connection.alias("runtime_connection"))
        .agg(peak.alias(name))
        .where(F.col(name) > threshold)
    )
    return top_k(peaks, k, F.desc(name), F.asc_nulls_last("runtime_connection"))
