"""Sliding error alerts from panes: short windows that all sliding ones are made of.

``PANES`` counts the errors of every runtime in 5 minutes. An error is one row there; only
counts are copied to the windows they lie in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicewatch.functions.predicates import is_error
from sluicewatch.rollups.table import Rollup

PANE_MINUTES = 5


def _per_pane(sig: DataFrame) -> DataFrame:
    pane = F.window("timestamp", f"{PANE_MINUTES} minutes")
    counts = sig.where(is_error()).groupBy(pane.alias("pane"), "runtime").agg(F.count("*").alias("error_count"))
    return counts.select(F.col("pane.start").alias("pane_start"), "runtime", "error_count")


PANES = Rollup(
    _per_pane,
    T.StructType(
        [
            T.StructField("pane_start", T.TimestampNTZType()),
            T.StructField("runtime", T.StringType()),
            T.StructField("error_count", T.LongType()),
        ]
    ),
    {"error_count": "sum"},
)


def error_alerts(
    panes: DataFrame, minutes: int = 30, slide_minutes: int = 5, min_errors: int = 5
) -> DataFrame:
    """Windows in which a runtime logged more than ``min_errors`` errors, from a ``PANES`` table.

    ``minutes`` and ``slide_minutes`` must be multiples of a pane's.
    """
    if minutes % PANE_MINUTES or slide_minutes % PANE_MINUTES:
        raise ValueError(f"windows must be multiples of {PANE_MINUTES} minutes")
    merged = PANES.merged(panes)  # before the copies, of which there are minutes / slide_minutes
    window = F.window("pane_start", f"{minutes} minutes", f"{slide_minutes} minutes")
    return (
        merged.groupBy(window.alias("window"), "runtime")
        .agg(F.sum("error_count").alias("error_count"))
        .where(F.col("error_count") > min_errors)
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "runtime",
            "error_count",
        )
    )
