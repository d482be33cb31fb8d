"""Row predicates shared by the operators; all act on the signals columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicewatch.functions.vocabulary import ERROR, LOG, METRIC, USER_PREFIX


def is_error() -> Column:
    """Log records of level ERROR (case-sensitive)."""
    return (F.col("record_type") == LOG) & (F.col("level") == ERROR)


def is_metric(name: str) -> Column:
    """Samples of one metric."""
    return (F.col("record_type") == METRIC) & (F.col("metric_name") == name)


def is_user_runtime(runtime: Column | str = "runtime") -> Column:
    """Runtimes somebody created, as opposed to internal ones."""
    column = F.col(runtime) if isinstance(runtime, str) else runtime
    return column.startswith(USER_PREFIX)


def in_runtimes(runtimes: Sequence[str] | None) -> Column:
    """Selected runtimes; no selection, or an empty one, keeps every row.

    A real selection also drops rows without a runtime.
    """
    chosen = [runtimes] if isinstance(runtimes, str) else list(runtimes or ())
    return F.col("runtime").isin(chosen) if chosen else F.lit(True)


def search_pattern(term: str) -> str:
    """``LIKE`` pattern of texts that contain ``term``."""
    return "%" + term.replace("\\", "\\\\") + "%"


def message_matches(term: str) -> Column:
    """Case-insensitive search inside the message.

    ``%`` and ``_`` in the term are wildcards; a backslash is an ordinary
    character. Rows without a message never match, not even the empty term.
    """
    return F.col("message").ilike(search_pattern(term))
