from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

import sluicewatch as sw
from sluicewatch.functions.vocabulary import QUEUED_DURATION, RUN_STATUS
from sluicewatch.sources.signals import PARTITIONS
from sluicewatch.streaming import live
from tests.conftest import ago, bag, log, row


@pytest.fixture
def stream(spark, telemetry, tmp_path):
    """Feeds batches of rows, one file each, through a live report into a table."""
    source = f"{tmp_path}/source"

    def run(report, *batches, name="out"):
        schema = telemetry([]).schema
        for batch in batches:
            telemetry(batch).coalesce(1).write.mode("append").parquet(source)
            events = spark.readStream.schema(schema).parquet(source)
            result = report(sw.signals(events))
            live.append_to_table(
                result, f"{tmp_path}/{name}", f"{tmp_path}/{name}-checkpoint"
            ).awaitTermination()
        return spark.read.schema(result.schema).parquet(f"{tmp_path}/{name}")

    return run


PUSH = [log(ago(minutes=0) + timedelta(days=2), "runtime-push")]  # moves the watermark on


def test_alerts_equal_batch_over_closed_windows(stream, sig):
    rows = [log(ago(minutes=m), f"runtime-{m % 2}") for m in range(40)]
    first, late = rows[20:], rows[:20]
    found = stream(live.error_alerts, first, late, PUSH)
    expected = live.error_alerts(sig(rows + PUSH))
    assert expected.count() > 0
    assert bag(found) == bag(expected)


def test_alert_windows_slide(stream):
    rows = [log(ago(minutes=14), "runtime-a")] * 6 + [log(ago(minutes=14), "runtime-b")] * 5
    found = stream(live.error_alerts, rows, PUSH)
    assert found.select("runtime").distinct().collect() == [("runtime-a",)]
    starts = sorted(r.window_start for r in found.collect())
    assert starts == [ago(minutes=m) for m in (40, 35, 30, 25, 20, 15)]


def test_rows_behind_the_watermark_are_left_out(stream):
    on_time, too_late = [log(ago(minutes=14))] * 6, [log(ago(minutes=14), "runtime-late")] * 9
    found = stream(live.error_alerts, on_time, PUSH, too_late)
    assert {r.runtime for r in found.collect()} == {"runtime-a"}


def test_rows_left_out_are_counted(spark, telemetry, tmp_path):
    source, counts = f"{tmp_path}/source", []
    events = spark.readStream.schema(telemetry([]).schema)
    for batch in ([log(ago(minutes=14))] * 6, PUSH, [log(ago(minutes=14), "runtime-late")] * 9):
        telemetry(batch).coalesce(1).write.mode("append").parquet(source)
        rollup = live.kpi_rollup(sw.signals(events.parquet(source)))
        query = live.append_to_table(rollup, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        query.awaitTermination()
        counts.append(live.rows_left_out(query))
    assert counts[:2] == [0, 0] and counts[2] > 0


def test_rollup_equals_hourly_trend(stream, sig):
    rows = [
        row(ago(hours=h), metric=QUEUED_DURATION, value=str(60000 * h)) for h in range(1, 9)
    ] + [log(ago(minutes=50 * m), f"runtime-{m % 3}") for m in range(1, 9)]
    rows.append(log(ago(hours=1), "system"))
    rows.sort(key=lambda r: r[0])
    found = stream(live.kpi_rollup, rows[:8], rows[8:], PUSH)
    expected = sw.kpi_trend(sig(rows), ago(minutes=0), 24)
    assert bag(found) == bag(expected)


def test_latest_status_from_hourly_marks(stream, sig):
    rows = [
        row(ago(minutes=17 * m), f"runtime-{m % 2}", f"c{m % 5}", metric=RUN_STATUS, value=v)
        for m, v in enumerate("0101100111010110100101")
    ]
    push = [row(ago(hours=-48), "runtime-push", "c", metric=RUN_STATUS, value="1")]
    marks = stream(live.run_status_rollup, rows[11:], rows[:11], push)
    found = live.latest_processor_status(marks)
    expected = sw.processor_status(sig(rows), ago(minutes=0), 24)
    assert bag(found) == bag(expected)
    twice = live.latest_processor_status(marks.union(marks))
    assert bag(twice) == bag(expected)
    assert found.where("is_stopped").count() > 0


def test_restart_goes_on_where_it_stopped(stream, spark):
    """Each batch above is a query of its own on one checkpoint; nothing repeats."""
    rows = [log(ago(minutes=14))] * 6
    found = stream(live.error_alerts, rows, PUSH, PUSH)
    assert found.count() == found.distinct().count() == 6


def test_streamed_signals_table(spark, telemetry, sig, tmp_path):
    source, table, checkpoint = (f"{tmp_path}/{n}" for n in ("source", "table", "checkpoint"))
    rows = [log(ago(days=d), f"runtime-{d}") for d in range(4)]
    for batch in (rows[:3], rows[3:]):
        telemetry(batch).write.mode("append").parquet(source)
        stream = sw.signals(spark.readStream.schema(telemetry([]).schema).parquet(source))
        live.append_to_table(stream, table, checkpoint, PARTITIONS).awaitTermination()
    stored = sw.read_signals(spark, table)
    assert bag(stored) == bag(sig(rows))
    recent = sw.error_runtimes(stored, ago(minutes=-1), 24)
    assert bag(recent) == [("runtime-0",)]


def test_streams_need_utc(spark, sig):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        with pytest.raises(ValueError, match="UTC"):
            live.kpi_rollup(sig([log()]))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_state_is_one_row_per_key_and_open_window(stream, sig):
    grouped = live.kpi_rollup(sig([log(ago(minutes=m)) for m in range(3)] * 50))
    assert grouped.select(F.count("*")).first()[0] == 2


def test_streams_keep_one_row_of_state_per_key_and_open_window(spark, telemetry, tmp_path):
    source = f"{tmp_path}/source"
    rows = [log(ago(minutes=m), f"runtime-{m % 2}") for m in range(3)] * 50
    telemetry(rows).coalesce(1).write.parquet(source)
    events = spark.readStream.schema(telemetry([]).schema).parquet(source)
    query = live.append_to_table(live.kpi_rollup(sw.signals(events)), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    # Rows of 11:58, 11:59 and 12:00 of two runtimes: three runtime hours.
    assert max(state) == 3


def test_future_and_late_rows_lose_nothing(spark, telemetry, sig, tmp_path):
    """A row of the far future in the first batch; what follows is older, and all of it counts."""
    def some(minutes, runtime):
        at = ago(minutes=minutes)
        return [
            *[log(at, runtime)] * 2,
            row(at, runtime, metric=QUEUED_DURATION, value=str(60000 * minutes)),
            row(at, runtime, metric=RUN_STATUS, value=str(minutes % 2)),
        ]
    future = [(r[0] + timedelta(days=30000), *r[1:]) for r in some(5, "runtime-future")]
    batches = [some(14, "runtime-a") + future, some(15, "runtime-a") + some(300, "runtime-b"), some(13, "runtime-a")]
    reports = {
        "alerts": (lambda s: live.error_alerts(s, min_errors=0), ["window_start", "window_end", "runtime"]),
        "trend": (live.kpi_rollup, ["time_bucket", "runtime"]),
        "status": (live.run_status_rollup, ["window_start", "window_end", "runtime", "component"]),
    }
    source = f"{tmp_path}/source"
    for batch in batches:
        telemetry(batch).coalesce(1).write.mode("append").parquet(source)
        stream = sw.signals(spark.readStream.schema(telemetry([]).schema).parquet(source))
        for name, (report, _) in reports.items():
            live.partials_to_table(stream, report, f"{tmp_path}/{name}", f"{tmp_path}/{name}-checkpoint").awaitTermination()
    for name, (report, keys) in reports.items():
        found = live.merged_rows(spark, f"{tmp_path}/{name}", report(stream).schema, keys)
        assert bag(found) == bag(report(sig(sum(batches, []))))
