"""Live forms of the error alert, the trend and the processor status.

Each takes a streaming (or batch) signals frame and returns windowed aggregates
under a watermark: state is one row per key and open window, whatever the number
of events. In append mode a window is emitted once, when the watermark passes its
end, and rows behind the watermark are left out, which a row dated in the future moves
for all; in update mode, which the alerts can't have, it is emitted as it changes. :func:`partials_to_table` stores a
report without a watermark, and leaves out nothing; what runs for long belongs into a
:class:`sluicewatch.rollups.table.RollupTable`, which also merges what it has stored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from sluicewatch.functions.predicates import is_error, is_user_runtime
from sluicewatch.functions.vocabulary import LOG, METRIC, RUN_STATUS
from sluicewatch.operators.metrics import max_queue_minutes, total_errors
from sluicewatch.operators.status import is_stopped, run_status_marks


def error_alerts(
    sig: DataFrame,
    minutes: int = 30,
    slide_minutes: int = 5,
    min_errors: int = 5,
    delay: str = "10 minutes",
) -> DataFrame:
    """Windows in which a runtime logged more than ``min_errors`` errors.

    Errors are counted in panes first, the longest that windows and their starts are
    multiples of; what is copied to all the windows that slide over a pane is its count.
    """
    pane = F.window("event_time", f"{math.gcd(minutes, slide_minutes)} minutes")
    panes = (
        _timed(sig.where(is_error()), delay)
        .groupBy(pane.alias("pane"), "runtime")
        .agg(F.count("*").alias("errors"))
    )
    within = F.window(F.window_time("pane"), f"{minutes} minutes", f"{slide_minutes} minutes")
    return (
        panes.groupBy(within.alias("window"), "runtime")
        .agg(F.sum("errors").alias("error_count"))
        .where(F.col("error_count") > min_errors)
        .select(*_bounds(), "runtime", "error_count")
    )


def kpi_rollup(sig: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The hourly trend of user-created runtimes, over all time."""
    samples = sig.where(F.col("record_type").isin(LOG, METRIC) & is_user_runtime())
    return (
        _timed(samples, delay)
        .groupBy(F.window("event_time", "1 hour").alias("window"), "runtime")
        .agg(
            total_errors().alias("total_errors"),
            max_queue_minutes().alias("max_queue_minutes"),
        )
        .select(
            F.col("window.start").cast("timestamp_ntz").alias("time_bucket"),
            "runtime",
            "total_errors",
            "max_queue_minutes",
        )
    )


def run_status_rollup(sig: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Run-status marks of every processor per hour.

    Marks are maxima, so those of several hours, or of an hour seen twice, merge
    into the marks of all of them: see :func:`latest_processor_status`.
    """
    samples = _timed(sig.where(F.col("metric_name") == RUN_STATUS), delay)
    return run_status_marks(
        samples, F.window("event_time", "1 hour").alias("window")
    ).select(*_bounds(), "runtime", "component", "last_seen", "last_zero", "last_positive")


def latest_processor_status(marks: DataFrame) -> DataFrame:
    """Latest status per processor from stored :func:`run_status_rollup` rows."""
    merged = marks.groupBy("runtime", "component").agg(
        *[F.max(mark).alias(mark) for mark in ("last_seen", "last_zero", "last_positive")]
    )
    return merged.select(
        "runtime",
        F.col("component").alias("processor"),
        "last_seen",
        is_stopped().alias("is_stopped"),
    )


def append_to_table(
    result: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()
) -> StreamingQuery:
    """Store rows or closed windows as Parquet: all that is available, then stop.

    Both folders have to be shared by all executors. A restart with the same
    checkpoint goes on where the last run stopped. Signals themselves can be
    stored like this, partitioned by ``PARTITIONS``, to keep their table up to
    date. A table should be written either by streams or by batches, not both,
    since readers trust the stream's log of files. :func:`rows_left_out` tells how many
    rows were too late for their windows.
    """
    return (
        result.writeStream.outputMode("append")
        .format("parquet")
        .partitionBy(*partition_by)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def rows_left_out(query: StreamingQuery) -> int:
    """Rows that the batches a query still remembers left out behind its watermark.

    Counted are rows as they reach the state: a batch is aggregated before, by key and
    window. A query remembers ``spark.sql.streaming.numRecentProgressUpdates`` batches.
    """
    states = (state for batch in query.recentProgress for state in batch["stateOperators"])
    return sum(state["numRowsDroppedByWatermark"] for state in states)


def partials_to_table(
    sig: DataFrame,
    report: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    continuous: str | None = None,
) -> StreamingQuery:
    """Store what each batch adds to each window of a report, as Parquet; no row is too late.

    The report runs over every batch on its own and keeps no state, so it has no
    watermark: a row dated in the future closes no window, and rows of any age count.
    It must keep all its groups, as counts are only whole once merged (for
    :func:`error_alerts` ``min_errors=0``, and the bound on reading).

    Each batch writes its own folder ``batch=n`` anew, so a batch that is repeated
    after a failure leaves the same rows: read them with :func:`merged_rows`. All that
    is available, then stop; or every ``continuous``, such as "1 minute".
    """

    def write(batch: DataFrame, number: int) -> None:
        report(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    trigger = {"processingTime": continuous} if continuous else {"availableNow": True}
    return (
        sig.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


#: Columns of the reports that add up over batches; maxima of the others merge.
SUMS = ("error_count", "total_errors")


def merged_rows(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """Of a table of :func:`partials_to_table` the whole row of each key."""
    stored = spark.read.schema(StructType([*schema, StructField("batch", LongType())])).parquet(path)
    others = [name for name in schema.names if name not in keys]
    merged = [(F.sum if name in SUMS else F.max)(name).alias(name) for name in others]
    return stored.groupBy(*keys).agg(*merged).select(*schema.names)


def _timed(sig: DataFrame, delay: str) -> DataFrame:
    """Signals with a watermark, which needs a ``TIMESTAMP`` column.

    Read as UTC the wall clock names the same instant; another session time zone
    would shift the windows, or lose an hour of them.
    """
    zone = sig.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT"):
        raise ValueError(f"streams need spark.sql.session.timeZone=UTC, not {zone}")
    return sig.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark(
        "event_time", delay
    )


def _bounds() -> tuple[Column, Column]:
    return (
        F.col("window.start").cast("timestamp_ntz").alias("window_start"),
        F.col("window.end").cast("timestamp_ntz").alias("window_end"),
    )
