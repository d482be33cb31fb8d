"""Error logs: where they come from, and what they say."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicewatch.functions.predicates import in_runtimes, is_error, message_matches
from sluicewatch.functions.timewin import AsOf, between, within
from sluicewatch.plans.topk import top_k, top_k_of_scan

Runtimes = Sequence[str] | None


def error_logs(
    sig: DataFrame,
    as_of: AsOf = None,
    window_hours: float = 24,
    runtimes: Runtimes = None,
) -> DataFrame:
    """Signals of level ERROR in the window.

    The result has the signals columns, so it can be persisted and handed to the
    other functions of this module in place of ``sig``.
    """
    return _errors_within(sig, as_of, timedelta(hours=window_hours), runtimes)


def high_error_runtimes(
    sig: DataFrame,
    as_of: AsOf = None,
    minutes: float = 30,
    min_errors: int = 5,
    runtimes: Runtimes = None,
) -> DataFrame:
    """Runtimes with more than ``min_errors`` errors in the last minutes.

    Errors without a runtime count as a runtime of their own (NULL).
    """
    return (
        _errors_within(sig, as_of, timedelta(minutes=minutes), runtimes)
        .groupBy("runtime")
        .agg(F.count("*").alias("error_count"))
        .where(F.col("error_count") > min_errors)
    )


def top_error_runtimes(
    sig: DataFrame,
    as_of: AsOf = None,
    window_hours: float = 24,
    k: int = 10,
    runtimes: Runtimes = None,
) -> DataFrame:
    """Runtimes with most errors, most first; ties by name."""
    counts = (
        error_logs(sig, as_of, window_hours, runtimes)
        .groupBy("runtime")
        .agg(F.count("*").alias("error_count"))
    )
    return top_k(counts, k, F.desc("error_count"), F.asc_nulls_last("runtime"))


def error_runtimes(
    sig: DataFrame, as_of: AsOf = None, window_hours: float = 24, runtimes: Runtimes = None
) -> DataFrame:
    """Every runtime that logged an error in the window."""
    return error_logs(sig, as_of, window_hours, runtimes).select("runtime").distinct()


def processor_errors(
    sig: DataFrame, as_of: AsOf = None, *, runtime: str, window_hours: float = 24, k: int = 10
) -> DataFrame:
    """Processors of one runtime with most errors, and their shares.

    ``pct_of_total`` is the share of the errors listed, that is of the top ``k``,
    not of all errors of the runtime.
    """
    order = (F.desc("error_count"), F.asc_nulls_last("processor"))
    counts = (
        error_logs(sig, as_of, window_hours, [runtime])
        .groupBy(F.col("logger").alias("processor"))
        .agg(F.count("*").alias("error_count"))
    )
    listed = F.sum("error_count").over(Window.partitionBy())  # over k rows at most
    return (
        top_k(counts, k, *order)
        .withColumn("pct_of_total", F.col("error_count") / listed * 100)
        .orderBy(*order)
    )


def error_time_range(
    sig: DataFrame,
    as_of: AsOf = None,
    *,
    runtime: str,
    processor: str | None = None,
    null_processor: bool = False,
    window_hours: float = 24,
) -> DataFrame:
    """First and last error of a runtime: always one row, NULLs if it has none.

    A range of a single instant is widened by one second.
    """
    first, last = F.min("timestamp"), F.max("timestamp")
    one_second = F.make_dt_interval(secs=F.lit(1))
    return (
        error_logs(sig, as_of, window_hours, [runtime])
        .where(_of_processor(processor, null_processor))
        .agg(
            first.alias("min_ts"),
            F.when(first == last, last + one_second).otherwise(last).alias("max_ts"),
        )
    )


def search_error_logs(
    sig: DataFrame,
    *,
    runtime: str,
    processor: str | None = None,
    null_processor: bool = False,
    time_range: tuple[AsOf, AsOf] | None = None,
    term: str = "",
    limit: int = 200,
) -> DataFrame:
    """Newest error messages of a runtime that contain ``term``.

    Looks at all history unless ``time_range`` (both ends included) is given.
    Ties are ordered by processor, then message.
    """
    found = sig.where(
        (between(*time_range) if time_range else F.lit(True))
        & in_runtimes([runtime])
        & is_error()
        & _of_processor(processor, null_processor)
        & message_matches(term)
    ).select("timestamp", F.col("logger").alias("processor"), "message")
    order = (
        F.desc("timestamp"),
        F.asc_nulls_last("processor"),
        F.asc("message"),
    )
    return top_k_of_scan(found, limit, order)


def _errors_within(
    sig: DataFrame, as_of: AsOf, span: timedelta, runtimes: Runtimes
) -> DataFrame:
    # Cheap conditions first: over raw telemetry the level comes out of JSON.
    return sig.where(within(as_of, span) & in_runtimes(runtimes) & is_error())


def _of_processor(processor: str | None, null_processor: bool) -> Column:
    """One processor, the records naming none, or (by default) all of them."""
    if null_processor:
        return F.col("logger").isNull()
    return F.lit(True) if processor is None else F.col("logger") == processor
