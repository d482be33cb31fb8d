"""All reports of one table under one set of filters."""

from __future__ import annotations

from datetime import timedelta

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from sluicewatch.functions.timewin import AsOf, resolve_as_of, within
from sluicewatch.operators import errors, heatmap, metrics, runtimes, status
from sluicewatch.operators import findings as finding_reports

ERROR_COLUMNS = (
    "timestamp",
    "event_date",
    "event_hour",
    "runtime",
    "record_type",
    "level",
    "logger",
)


@dataclass(frozen=True)
class HealthBoard:
    """Reports over ``signals`` that share a moment, a window and a selection.

    The moment is fixed once, when the board is made, so that all reports of a
    board describe the same time. Every method returns a lazy DataFrame.
    """

    signals: DataFrame
    as_of: AsOf = None
    window_hours: float = 24
    runtimes: Sequence[str] | None = None
    cached_errors: DataFrame | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        moment: datetime = resolve_as_of(self.as_of)
        object.__setattr__(self, "as_of", moment)

    def with_cached_errors(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> HealthBoard:
        """The same board with the window's error logs persisted.

        Five reports start from them, and none needs the messages, which are most
        of a log. They are kept for all runtimes, because some reports leave the
        runtime selection out. Call ``board.cached_errors.unpersist()`` when done.
        """
        logs = errors.error_logs(self.signals, self.as_of, self.window_hours)
        return replace(self, cached_errors=logs.select(*ERROR_COLUMNS).persist(level))

    def recent_runtimes(self, include_internal: bool = False) -> DataFrame:
        return runtimes.recent_runtimes(
            self.signals, self.as_of, include_internal=include_internal
        )

    def findings(self) -> DataFrame:
        return finding_reports.findings(self.signals, self.as_of, self.runtimes)

    def findings_total(self) -> DataFrame:
        return finding_reports.findings_total(self.findings())

    def high_error_runtimes(self, minutes: float = 30, min_errors: int = 5) -> DataFrame:
        return errors.high_error_runtimes(
            self.signals, self.as_of, minutes, min_errors, self.runtimes
        )

    def processor_status(self, hours: float = 1) -> DataFrame:
        return status.processor_status(self.signals, self.as_of, hours, self.runtimes)

    def stopped_processors(self, hours: float = 1) -> DataFrame:
        return status.stopped_processors(self.signals, self.as_of, hours, self.runtimes)

    def kpi_trend(self) -> DataFrame:
        return metrics.kpi_trend(self.signals, self.as_of, self.window_hours, self.runtimes)

    def top_error_runtimes(self, k: int = 10) -> DataFrame:
        return errors.top_error_runtimes(
            self._error_source(), self.as_of, self.window_hours, k, self.runtimes
        )

    def error_runtimes(self) -> DataFrame:
        return errors.error_runtimes(
            self._error_source(), self.as_of, self.window_hours, self.runtimes
        )

    def processor_errors(self, runtime: str, k: int = 10) -> DataFrame:
        return errors.processor_errors(
            self._error_source(),
            self.as_of,
            runtime=runtime,
            window_hours=self.window_hours,
            k=k,
        )

    def error_time_range(
        self, runtime: str, processor: str | None = None, null_processor: bool = False
    ) -> DataFrame:
        return errors.error_time_range(
            self._error_source(),
            self.as_of,
            runtime=runtime,
            processor=processor,
            null_processor=null_processor,
            window_hours=self.window_hours,
        )

    def search_error_logs(
        self,
        runtime: str,
        processor: str | None = None,
        null_processor: bool = False,
        time_range: tuple[AsOf, AsOf] | None = None,
        term: str = "",
        limit: int = 200,
        all_history: bool = False,
    ) -> DataFrame:
        """Searches the board's window, or all history if asked to."""
        window = within(self.as_of, timedelta(hours=self.window_hours))
        return errors.search_error_logs(
            self.signals if all_history else self.signals.where(window),
            runtime=runtime,
            processor=processor,
            null_processor=null_processor,
            time_range=time_range,
            term=term,
            limit=limit,
        )

    def backpressure(self, min_mib: float = 0) -> DataFrame:
        return metrics.backpressure(
            self.signals, self.as_of, self.window_hours, min_mib, runtimes=self.runtimes
        )

    def queue_times(self, min_minutes: float = 0) -> DataFrame:
        return metrics.queue_times(
            self.signals, self.as_of, self.window_hours, min_minutes, runtimes=self.runtimes
        )

    def error_heatmap(self, runtime: str | None = None) -> DataFrame:
        return heatmap.error_heatmap(
            self._error_source(), self.as_of, self.window_hours, runtime, self.runtimes
        )

    def known_runtimes(self) -> DataFrame:
        return status.known_runtimes(self.signals)

    def last_events(self) -> DataFrame:
        return status.last_events(self.signals)

    def active_runtimes(self, inactivity_hours: float = 24) -> DataFrame:
        return status.active_runtimes(self.signals, self.as_of, inactivity_hours)

    def runtime_status(self, inactivity_hours: float = 24, user_only: bool = True) -> DataFrame:
        return status.runtime_status(self.signals, self.as_of, inactivity_hours, user_only)

    def runtime_status_totals(
        self, inactivity_hours: float = 24, user_only: bool = True
    ) -> DataFrame:
        return status.runtime_status_totals(self.runtime_status(inactivity_hours, user_only))

    def _error_source(self) -> DataFrame:
        return self.signals if self.cached_errors is None else self.cached_errors
