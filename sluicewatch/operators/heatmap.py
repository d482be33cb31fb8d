"""Errors by weekday and hour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicewatch.functions.timewin import AsOf, iso_weekday, weekday_name
from sluicewatch.operators.errors import error_logs

HOURS = 24
CELLS = 7 * HOURS


def error_heatmap(
    sig: DataFrame,
    as_of: AsOf = None,
    window_hours: float = 24,
    runtime: str | None = None,
    runtimes: Sequence[str] | None = None,
) -> DataFrame:
    """Error counts of all 168 weekday and hour cells, zeros included.

    A ``runtime`` given replaces the ``runtimes`` selection. ``day_index`` (1 for
    Monday) sorts the days.
    """
    chosen = runtimes if runtime is None else [runtime]
    return heatmap_of(error_logs(sig, as_of, window_hours, chosen), F.count("*"))


def heatmap_of(rows: DataFrame, errors: Column) -> DataFrame:
    """The 168 cells of rows dated by ``event_date`` and ``event_hour``."""
    counts = rows.groupBy(
        iso_weekday(F.col("event_date")).alias("day_index"),
        F.col("event_hour").alias("hour_of_day"),
    ).agg(errors.alias("counted"))
    spark = rows.sparkSession
    cell = F.col("id").cast("int")
    grid = spark.range(0, CELLS, 1, 1).select(
        (F.floor(cell / HOURS) + 1).cast("int").alias("day_index"),
        (cell % HOURS).alias("hour_of_day"),
    )
    # The counts have at most one row per cell, so broadcasting them is bounded
    # by 168 rows; the planner cannot know that from the size of the scan.
    return (
        grid.join(F.broadcast(counts), ["day_index", "hour_of_day"], "left")
        .select(
            weekday_name(F.col("day_index")).alias("day_of_week"),
            "day_index",
            "hour_of_day",
            F.coalesce("counted", F.lit(0)).alias("error_count"),
        )
    )
