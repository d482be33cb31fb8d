from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from sluicewatch import backpressure, bucket_for, kpi_trend, queue_times
from sluicewatch.functions.vocabulary import QUEUED_BYTES, QUEUED_DURATION
from tests.conftest import AS_OF, ago, log, row, values

HOUR = datetime(2024, 3, 14, 11)


def wait(value, at=HOUR, runtime="runtime-a", component="c", kind="METRIC"):
    return row(at, runtime, component, kind, QUEUED_DURATION, value)


def depth(value, at=HOUR, runtime="runtime-a", component="c"):
    return row(at, runtime, component, "METRIC", QUEUED_BYTES, value)


def trend_of(sig, rows, **kwargs):
    return [r[1:] for r in values(kpi_trend(sig(rows), AS_OF, **kwargs))]


@pytest.mark.parametrize("hours, bucket", [(1, "hour"), (47, "hour"), (48, "hour"), (49, "day")])
def test_bucket_width(hours, bucket):
    assert bucket_for(hours) == bucket


def test_only_info_logs_give_zeros(sig):
    assert trend_of(sig, [log(HOUR, level="INFO")]) == [("runtime-a", 0, 0.0)]


def test_only_metrics_give_no_errors(sig):
    assert trend_of(sig, [wait("120000")]) == [("runtime-a", 0, 2.0)]


def test_missing_number_is_ignored(sig):
    assert trend_of(sig, [wait(None)]) == [("runtime-a", 0, None)]
    assert trend_of(sig, [wait("n/a"), wait("60000")]) == [("runtime-a", 0, 1.0)]


def test_zero_floor_needs_another_row(sig):
    assert trend_of(sig, [wait("-60000")]) == [("runtime-a", 0, -1.0)]
    assert trend_of(sig, [wait("-60000"), log(HOUR)]) == [("runtime-a", 1, 0.0)]


def test_error_level_counts_in_any_record_of_the_two_types(sig):
    error = '{"level":"ERROR"}'
    rows = [
        row(HOUR, kind="METRIC", value=error),
        row(HOUR, kind="SPAN", value=error),
        row(HOUR, kind=None, value=error),
    ]
    assert trend_of(sig, rows) == [("runtime-a", 1, 0.0)]


def test_internal_and_missing_runtimes_are_left_out(sig):
    rows = [log(HOUR, "system"), log(HOUR, None), log(HOUR, "Runtime-x"), log(HOUR, "runtime-")]
    assert trend_of(sig, rows) == [("runtime-", 1, 0.0)]


def test_selection(sig):
    rows = [log(HOUR, "runtime-a"), log(HOUR, "runtime-b")]
    assert trend_of(sig, rows, runtimes=["runtime-b"]) == [("runtime-b", 1, 0.0)]


def test_bucket_edges_and_order(sig):
    edge = datetime(2024, 3, 14, 10)
    rows = [log(edge), log(edge - timedelta(microseconds=1)), log(datetime(2024, 3, 13, 23))]
    assert [r[0] for r in values(kpi_trend(sig(rows), AS_OF, 48))] == [
        datetime(2024, 3, 13, 23),
        datetime(2024, 3, 14, 9),
        datetime(2024, 3, 14, 10),
    ]
    assert [(r[0], r[2]) for r in values(kpi_trend(sig(rows), AS_OF, 49))] == [
        (datetime(2024, 3, 13), 1),
        (datetime(2024, 3, 14), 2),
    ]


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_trend_ignores_the_session_time_zone(spark, sig, zone):
    """02:30 does not exist in New York that day; it does in UTC."""
    rows = [log(datetime(2024, 3, 10, 2, 30)), log(datetime(2024, 3, 10, 0, 10))]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        found = [r[0] for r in values(kpi_trend(sig(rows), "2024-03-10 12:00:00", 24))]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found == [datetime(2024, 3, 10, 0), datetime(2024, 3, 10, 2)]


def test_peaks_are_numeric(sig):
    found = values(queue_times(sig([wait("9"), wait("10")]), AS_OF))
    assert found == [("runtime-a | c", 10 / 60000)]


def test_thresholds_are_strict(sig):
    mib = 1024 * 1024
    rows = [depth(str(n * mib), component=f"c{n}") for n in (0, 4, 5, 6)] + [
        depth(None, component="none")
    ]
    assert values(backpressure(sig(rows), AS_OF, min_mib=5)) == [("runtime-a | c6", 6.0)]
    assert values(backpressure(sig(rows), AS_OF)) == [
        ("runtime-a | c6", 6.0),
        ("runtime-a | c5", 5.0),
        ("runtime-a | c4", 4.0),
    ]
    waits = [wait(str(60000 * n), component=f"c{n}") for n in (1, 2)]
    assert values(queue_times(sig(waits), AS_OF, min_minutes=1)) == [("runtime-a | c2", 2.0)]


def test_incomplete_names_form_one_connection(sig):
    rows = [
        wait("60000", runtime=None),
        wait("120000", component=None),
        wait("180000", component="c"),
    ]
    assert values(queue_times(sig(rows), AS_OF)) == [("runtime-a | c", 3.0), (None, 2.0)]


def test_other_records_and_times_are_left_out(sig):
    rows = [wait("60000", kind="LOG"), wait("60000", at=ago(hours=24)), depth("60000")]
    assert values(queue_times(sig(rows), AS_OF)) == []


def test_top_15_with_ties_by_name(sig):
    rows = [wait("60000", component=f"c{i:02}") for i in range(17)]
    assert [r[0] for r in values(queue_times(sig(rows), AS_OF))] == [
        f"runtime-a | c{i:02}" for i in range(15)
    ]
