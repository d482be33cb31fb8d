"""Event-time helpers.

All event times are ``TIMESTAMP_NTZ`` holding UTC wall-clock time. Nothing here
goes through ``TIMESTAMP``, so results do not depend on the session time zone.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicewatch.functions.vocabulary import WEEKDAYS

AsOf = datetime | str | None


def resolve_as_of(as_of: AsOf = None) -> datetime:
    """The moment a report speaks about, as naive UTC; the current time by default."""
    if as_of is None:
        as_of = datetime.now(timezone.utc)
    elif isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of)
    if as_of.tzinfo is not None:
        as_of = as_of.astimezone(timezone.utc).replace(tzinfo=None)
    return as_of


def ntz(moment: datetime) -> Column:
    """``moment`` as a ``TIMESTAMP_NTZ`` literal (folded before the scan is planned)."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def within(as_of: AsOf, span: timedelta) -> Column:
    """Rows later than ``as_of - span`` (strictly); rows dated after ``as_of`` count.

    The bound on date and hour follows from the one on the timestamp. It is
    spelled out because it is what prunes the partitions of a stored signals
    table: Spark neither derives it, nor skips Parquet row groups by
    ``TIMESTAMP_NTZ`` bounds.
    """
    start = resolve_as_of(as_of) - span
    return (F.col("timestamp") > ntz(start)) & _from_hour_of(start)


def not_after(moment: AsOf) -> Column:
    """Rows up to and including ``moment``."""
    end = resolve_as_of(moment)
    return (F.col("timestamp") <= ntz(end)) & _to_hour_of(end)


def between(start: AsOf, end: AsOf) -> Column:
    """Rows from ``start`` to ``end``, both included."""
    first, last = resolve_as_of(start), resolve_as_of(end)
    in_range = F.col("timestamp").between(ntz(first), ntz(last))
    return in_range & _from_hour_of(first) & _to_hour_of(last)


def _from_hour_of(moment: datetime) -> Column:
    day, hour, date = F.col("event_date"), F.col("event_hour"), F.lit(moment.date())
    return (day > date) | ((day == date) & (hour >= moment.hour))


def _to_hour_of(moment: datetime) -> Column:
    day, hour, date = F.col("event_date"), F.col("event_hour"), F.lit(moment.date())
    return (day < date) | ((day == date) & (hour <= moment.hour))


def the_hour_of(moment: datetime) -> Column:
    """Rows of the hour that holds ``moment``."""
    return (F.col("event_date") == F.lit(moment.date())) & (F.col("event_hour") == moment.hour)


def hours_after(moment: datetime) -> Column:
    """Rows of all hours that begin after ``moment``'s hour."""
    day, hour, date = F.col("event_date"), F.col("event_hour"), F.lit(moment.date())
    return (day > date) | ((day == date) & (hour > moment.hour))


def bucket_for(window_hours: float) -> str:
    """Width of a trend bucket: hours up to two days, whole days beyond."""
    return "hour" if window_hours <= 48 else "day"


def bucket_start(date: str, hour: str | None = None) -> Column:
    """First instant of a day, or of one hour of it, from the columns named."""
    midnight = F.col(date).cast("timestamp_ntz")
    return midnight if hour is None else midnight + F.make_dt_interval(hours=F.col(hour))


def iso_weekday(event_date: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(event_date) + F.lit(1)


def weekday_name(iso_day: Column) -> Column:
    """Short English name of an ISO weekday number."""
    return F.element_at(F.array(*[F.lit(name) for name in WEEKDAYS]), iso_day)
