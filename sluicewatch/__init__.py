"""Health reports over pipeline telemetry, as Spark DataFrames."""

from sluicewatch.functions.timewin import bucket_for, resolve_as_of
from sluicewatch.operators.errors import (
    error_logs,
    error_runtimes,
    error_time_range,
    high_error_runtimes,
    processor_errors,
    search_error_logs,
    top_error_runtimes,
)
from sluicewatch.operators.findings import findings, findings_total
from sluicewatch.operators.heatmap import error_heatmap
from sluicewatch.operators.metrics import backpressure, kpi_trend, queue_times
from sluicewatch.operators.runtimes import recent_runtimes
from sluicewatch.operators.status import (
    active_runtimes,
    known_runtimes,
    last_events,
    processor_status,
    runtime_status,
    runtime_status_totals,
    stopped_processors,
)
from sluicewatch.plans.board import HealthBoard
from sluicewatch.sources.signals import (
    SIGNALS_SCHEMA,
    read_signals,
    seen_by,
    signals,
    write_signals,
)
from sluicewatch.sources.telemetry import (
    TELEMETRY_SCHEMA,
    read_events,
    read_telemetry,
    telemetry_from_events,
    telemetry_since,
    telemetry_table,
)

__all__ = [
    "SIGNALS_SCHEMA",
    "TELEMETRY_SCHEMA",
    "HealthBoard",
    "active_runtimes",
    "backpressure",
    "bucket_for",
    "error_heatmap",
    "error_logs",
    "error_runtimes",
    "error_time_range",
    "findings",
    "findings_total",
    "high_error_runtimes",
    "known_runtimes",
    "kpi_trend",
    "last_events",
    "processor_errors",
    "processor_status",
    "queue_times",
    "read_events",
    "read_signals",
    "read_telemetry",
    "recent_runtimes",
    "resolve_as_of",
    "runtime_status",
    "runtime_status_totals",
    "search_error_logs",
    "seen_by",
    "signals",
    "stopped_processors",
    "telemetry_from_events",
    "telemetry_since",
    "telemetry_table",
    "top_error_runtimes",
    "write_signals",
]
