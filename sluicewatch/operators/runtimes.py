"""The runtimes a user can pick from."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicewatch.functions.predicates import is_user_runtime
from sluicewatch.functions.timewin import AsOf, within


def recent_runtimes(
    sig: DataFrame, as_of: AsOf = None, hours: float = 24, include_internal: bool = False
) -> DataFrame:
    """Runtimes seen in the last hours, by name; user-created ones by default."""
    seen = sig.where(F.col("runtime").isNotNull() & within(as_of, timedelta(hours=hours)))
    if not include_internal:
        seen = seen.where(is_user_runtime())
    return seen.select("runtime").distinct().orderBy("runtime")
