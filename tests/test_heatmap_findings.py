from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

import sluicewatch as sw
from sluicewatch import HealthBoard, error_heatmap, findings, findings_total
from sluicewatch.functions.vocabulary import RUN_STATUS, WEEKDAYS
from tests.conftest import AS_OF, ago, bag, log, row, values

SUNDAY, MONDAY = datetime(2024, 3, 10, 23, 59), datetime(2024, 3, 11, 0, 1)


def hot_cells(df):
    return sorted(values(df.where("error_count > 0")))


def test_empty_input_gives_every_cell(sig):
    cells = values(error_heatmap(sig([log(level="INFO")]), AS_OF))
    assert sorted((d, h) for _, d, h, _ in cells) == [
        (d, h) for d in range(1, 8) for h in range(24)
    ]
    assert all(name == WEEKDAYS[d - 1] and n == 0 for name, d, _, n in cells)


def test_weekdays_and_hours(sig):
    rows = [log(SUNDAY), log(SUNDAY), log(MONDAY), log(ago(days=8))]
    assert hot_cells(error_heatmap(sig(rows), AS_OF, 168)) == [
        ("Mon", 1, 0, 1),
        ("Sun", 7, 23, 2),
    ]


def test_chosen_runtime_replaces_the_selection(sig):
    rows = [log(SUNDAY, "runtime-a"), log(MONDAY, "runtime-b"), log(MONDAY, None)]
    flat = sig(rows)
    chosen = error_heatmap(flat, AS_OF, 168, runtime="runtime-a", runtimes=["runtime-b"])
    assert hot_cells(chosen) == [("Sun", 7, 23, 1)]
    assert hot_cells(error_heatmap(flat, AS_OF, 168, runtimes=["runtime-b"])) == [
        ("Mon", 1, 0, 1)
    ]
    assert hot_cells(error_heatmap(flat, AS_OF, 168)) == [("Mon", 1, 0, 2), ("Sun", 7, 23, 1)]


TROUBLE = (
    [log(ago(minutes=5), None)] * 6
    + [log(ago(minutes=5), "runtime-a")] * 8
    + [row(ago(minutes=5), "runtime-b", f"c{i}", metric=RUN_STATUS, value="0") for i in range(3)]
)


def test_findings(sig):
    found = findings(sig(TROUBLE), AS_OF)
    rows = values(found.select("rank", "runtime", "type", "icon", "title", "text", "urgency"))
    assert rows == [
        (
            1,
            None,
            "error",
            "🔥",
            "High Error Rate Detected",
            "Runtime **None** has produced **6 errors** in the last 30 minutes.",
            "High (Investigate Now)",
        ),
        (
            1,
            "runtime-a",
            "error",
            "🔥",
            "High Error Rate Detected",
            "Runtime **runtime-a** has produced **8 errors** in the last 30 minutes.",
            "High (Investigate Now)",
        ),
        (
            2,
            "runtime-b",
            "warning",
            "🛑",
            "Stopped Processors Found",
            "Runtime **runtime-b** has **3 processor(s)** in a stopped state.",
            "Medium (Review Soon)",
        ),
    ]
    assert all("runtime's flow" in r.action for r in found.where("rank = 2").collect())
    assert values(findings_total(found)) == [(3,)]


def test_no_findings(sig):
    calm = findings(sig([log(ago(hours=2))]), AS_OF)
    assert values(calm) == []
    assert values(findings_total(calm)) == [(0,)]


def test_findings_selection(sig):
    assert [r.runtime for r in findings(sig(TROUBLE), AS_OF, ["runtime-b"]).collect()] == [
        "runtime-b"
    ]


def test_board_reports_share_filters(sig):
    rows = TROUBLE + [log(SUNDAY, "runtime-a"), row(ago(hours=2), "system")]
    board = HealthBoard(sig(rows), AS_OF, 168, ["runtime-a"])
    cached = board.with_cached_errors()
    for report in (
        lambda b: b.top_error_runtimes(),
        lambda b: b.error_runtimes(),
        lambda b: b.processor_errors("runtime-a"),
        lambda b: b.error_time_range("runtime-a"),
        lambda b: b.error_heatmap(),
        lambda b: b.error_heatmap("runtime-a"),
    ):
        assert bag(report(cached)) == bag(report(board))
    cached.cached_errors.unpersist()
    assert values(board.top_error_runtimes()) == [("runtime-a", 9)]
    assert [r.runtime for r in board.findings().collect()] == ["runtime-a"]
    assert len(board.kpi_trend().collect()) == 2
    assert values(board.recent_runtimes()) == [("runtime-a",), ("runtime-b",)]
    assert values(board.recent_runtimes(include_internal=True))[-1] == ("system",)
    assert board.runtime_status().where(F.col("is_active")).count() == 2
    assert values(board.runtime_status_totals(user_only=False)) == [(3, 3, 0)]
    assert board.search_error_logs("runtime-a", term="M").count() == 9
    assert values(board.backpressure()) == values(board.queue_times()) == []


def test_board_serves_every_report(sig):
    """Each public report over signals has a method, which passes the board's filters on."""
    flat = sig(TROUBLE + [log(SUNDAY, "runtime-a"), row(ago(hours=2), "system")])
    board = HealthBoard(flat, AS_OF, 168, ["runtime-b", "system"])
    chosen = ["runtime-b", "system"]
    for found, expected in (
        (board.findings_total(), sw.findings_total(findings(flat, AS_OF, chosen))),
        (board.high_error_runtimes(60, 0), sw.high_error_runtimes(flat, AS_OF, 60, 0, chosen)),
        (board.processor_status(2), sw.processor_status(flat, AS_OF, 2, chosen)),
        (board.stopped_processors(2), sw.stopped_processors(flat, AS_OF, 2, chosen)),
        (board.known_runtimes(), sw.known_runtimes(flat)),
        (board.last_events(), sw.last_events(flat)),
        (board.active_runtimes(1), sw.active_runtimes(flat, AS_OF, 1)),
    ):
        assert bag(found) == bag(expected)
    assert values(board.findings_total()) == [(1,)]
    reports = {n for n in sw.__all__ if n[0].islower()} - {
        "bucket_for", "resolve_as_of", "error_logs", "seen_by", "signals", "read_signals", "write_signals",
        "read_events", "read_telemetry", "telemetry_from_events", "telemetry_since", "telemetry_table",
    }
    assert reports <= set(dir(board))


def test_board_fixes_its_moment(sig):
    board = HealthBoard(sig([log()]))
    assert isinstance(board.as_of, datetime) and board.as_of.tzinfo is None
