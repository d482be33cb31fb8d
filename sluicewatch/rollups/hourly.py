"""Hourly roll-up, and reports over windows whose edge lies inside an hour.

Whole hours come from the roll-up. Only the hour that a window cuts is read from signals,
from its edge on: windows are open at their lower end and have no upper one. Counts add
up and peaks are maxima, so both parts merge into what a scan of all signals gives.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicewatch.functions.predicates import in_runtimes, is_error, is_user_runtime
from sluicewatch.functions.timewin import AsOf, bucket_for, bucket_start, hours_after, ntz, resolve_as_of, the_hour_of
from sluicewatch.functions.vocabulary import LOG, METRIC
from sluicewatch.operators.heatmap import heatmap_of
from sluicewatch.operators.metrics import max_queue_minutes, total_errors
from sluicewatch.plans.topk import top_k
from sluicewatch.rollups.table import Rollup


def _per_hour(sig: DataFrame) -> DataFrame:
    """Logs and samples of every hour and runtime; the error reports count logs only."""
    return (
        sig.where(F.col("record_type").isin(LOG, METRIC))
        .groupBy("event_date", "event_hour", "runtime")
        .agg(
            total_errors().alias("total_errors"),
            F.count_if(is_error()).alias("error_logs"),
            max_queue_minutes().alias("max_queue_minutes"),
        )
    )


HOURLY = Rollup(
    _per_hour,
    T.StructType(
        [
            T.StructField("event_date", T.DateType()),
            T.StructField("event_hour", T.IntegerType()),
            T.StructField("runtime", T.StringType()),
            T.StructField("total_errors", T.LongType()),
            T.StructField("error_logs", T.LongType()),
            T.StructField("max_queue_minutes", T.DoubleType()),
        ]
    ),
    {"total_errors": "sum", "error_logs": "sum", "max_queue_minutes": "max"},
)


def _window(
    hourly: DataFrame, sig: DataFrame, as_of: AsOf, window_hours: float, keep: Column
) -> DataFrame:
    """Rows of ``HOURLY`` for the window: whole hours of the roll-up, and what signals have
    of the hour that holds the window's edge."""
    edge = resolve_as_of(as_of) - timedelta(hours=window_hours)
    cut = sig.where(keep & the_hour_of(edge) & (F.col("timestamp") > ntz(edge)))
    names = HOURLY.schema.names
    return hourly.where(keep & hours_after(edge)).select(*names).unionByName(_per_hour(cut))


def kpi_trend(
    hourly: DataFrame,
    sig: DataFrame,
    as_of: AsOf = None,
    window_hours: float = 24,
    runtimes: Sequence[str] | None = None,
) -> DataFrame:
    """As :func:`sluicewatch.kpi_trend`, from an ``HOURLY`` table and one hour of signals."""
    parts = ["event_date"] + ["event_hour"] * (bucket_for(window_hours) == "hour")
    rows = _window(hourly, sig, as_of, window_hours, is_user_runtime() & in_runtimes(runtimes))
    return (
        rows.groupBy(*parts, "runtime")
        .agg(F.sum("total_errors").alias("total_errors"), F.max("max_queue_minutes").alias("max_queue_minutes"))
        .select(bucket_start(*parts).alias("time_bucket"), "runtime", "total_errors", "max_queue_minutes")
        .orderBy("time_bucket", "runtime")
    )


def error_heatmap(
    hourly: DataFrame,
    sig: DataFrame,
    as_of: AsOf = None,
    window_hours: float = 24,
    runtime: str | None = None,
    runtimes: Sequence[str] | None = None,
) -> DataFrame:
    """As :func:`sluicewatch.error_heatmap`, from an ``HOURLY`` table and one hour of signals."""
    chosen = in_runtimes(runtimes if runtime is None else [runtime])
    return heatmap_of(_window(hourly, sig, as_of, window_hours, chosen), F.sum("error_logs"))


def top_error_runtimes(
    hourly: DataFrame,
    sig: DataFrame,
    as_of: AsOf = None,
    window_hours: float = 24,
    k: int = 10,
    runtimes: Sequence[str] | None = None,
) -> DataFrame:
    """As :func:`sluicewatch.top_error_runtimes`, from an ``HOURLY`` table and one hour of signals."""
    counts = (
        _window(hourly, sig, as_of, window_hours, in_runtimes(runtimes))
        .groupBy("runtime")
        .agg(F.sum("error_logs").alias("error_count"))
        .where(F.col("error_count") > 0)
    )
    return top_k(counts, k, F.desc("error_count"), F.asc_nulls_last("runtime"))
