"""Findings: what needs attention now, in words."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicewatch.functions.predicates import in_runtimes, is_error
from sluicewatch.functions.timewin import AsOf, resolve_as_of, within
from sluicewatch.functions.vocabulary import HIGH_ERROR_FINDING, RUN_STATUS, STOPPED_FINDING
from sluicewatch.operators.status import is_stopped, run_status_marks


def findings(
    sig: DataFrame,
    as_of: AsOf = None,
    runtimes: Sequence[str] | None = None,
    *,
    minutes: int = 30,
    min_errors: int = 5,
    stopped_hours: float = 1,
) -> DataFrame:
    """High error rates, then stopped processors (``rank`` 1 and 2), one row each.

    One scan of the longer window gives both: per runtime and processor the errors of
    the one window and the run-status marks of the other, then both counts per runtime.
    Errors are one group per runtime, whatever their component.
    """
    moment = resolve_as_of(as_of)
    spans = timedelta(minutes=minutes), timedelta(hours=stopped_hours)
    erred = is_error() & within(moment, spans[0])
    reported = (F.col("metric_name") == RUN_STATUS) & within(moment, spans[1])
    seen = sig.where(within(moment, max(spans)) & in_runtimes(runtimes) & (erred | reported))
    # A row can be both, since only its record type makes it an error.
    told = seen.select(
        "runtime",
        F.when(reported, F.col("component")).alias("component"),
        F.when(reported, F.col("timestamp")).alias("timestamp"),
        "value_num",
        F.coalesce(erred, F.lit(False)).alias("erred"),
    )
    marks = run_status_marks(told, more=[F.count_if("erred").alias("errors")])
    counts = marks.groupBy("runtime").agg(
        F.sum("errors").alias("errors"), F.count_if(is_stopped()).alias("stopped")
    )
    noisy = _worded(1, HIGH_ERROR_FINDING, F.col("errors"), F.col("errors") > min_errors, minutes=minutes)
    halted = _worded(2, STOPPED_FINDING, F.col("stopped"), F.col("stopped") > 0)
    both = counts.select(F.explode(F.array_compact(F.array(noisy, halted))).alias("finding"))
    return both.select("finding.*").orderBy("rank", "runtime")


def findings_total(found: DataFrame) -> DataFrame:
    """Number of findings, as one row."""
    return found.agg(F.count("*").alias("findings"))


def _worded(rank: int, finding: dict, count: Column, found: Column, **values) -> Column:
    """The finding as a struct, NULL if there is none."""
    name = F.coalesce("runtime", F.lit("None"))
    text = F.format_string(finding["text"].format(**values), name, count)
    said = F.struct(
        F.lit(rank).alias("rank"),
        F.col("runtime").alias("runtime"),
        F.lit(finding["type"]).alias("type"),
        F.lit(finding["icon"]).alias("icon"),
        F.lit(finding["title"]).alias("title"),
        text.alias("text"),
        F.lit(finding["action"]).alias("action"),
        F.lit(finding["urgency"]).alias("urgency"),
    )
    return F.when(found, said)
