from __future__ import annotations

import random
from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from sluicewatch import (
    active_runtimes,
    known_runtimes,
    last_events,
    processor_status,
    recent_runtimes,
    runtime_status,
    runtime_status_totals,
    stopped_processors,
)
from sluicewatch.functions.vocabulary import RUN_STATUS
from tests.conftest import AS_OF, ago, bag, log, row, values


def state(value, minutes, component="c", runtime="runtime-a", kind="METRIC"):
    return row(ago(minutes=minutes), runtime, component, kind, RUN_STATUS, value)


def stopped_by_rank(flat, as_of, hours):
    """The same question asked with a ranking window."""
    latest = Window.partitionBy("runtime", "component").orderBy(
        F.desc("timestamp"), F.desc_nulls_last("value_num")
    )
    return (
        flat.where(F.col("metric_name") == RUN_STATUS)
        .where(F.col("timestamp") > F.lit(as_of - timedelta(hours=hours)).cast("timestamp_ntz"))
        .withColumn("rn", F.row_number().over(latest))
        .where("rn = 1 AND value_num = 0")
        .groupBy("runtime")
        .agg(F.count("*").alias("stopped_count"))
    )


def test_latest_status_decides(sig):
    rows = [
        state("1", 30, "stopped"),
        state("0", 10, "stopped"),
        state("0", 30, "restarted"),
        state("1", 10, "restarted"),
        state("0", 30, "unknown"),
        state(None, 10, "unknown"),
        state("0", 10, "tied"),
        state("1", 10, "tied"),
        state("0", 10, "tied with nothing"),
        state(None, 10, "tied with nothing"),
        state("0", 10, "tied with negative"),
        state("-1", 10, "tied with negative"),
        state("0", 60, "silent"),
        state("0", 10, None),
        state("0", 10, "of a log", kind="LOG"),
    ]
    found = {r.processor: r.is_stopped for r in processor_status(sig(rows), AS_OF).collect()}
    assert found == {
        "stopped": True,
        "restarted": False,
        "unknown": False,
        "tied": False,
        "tied with nothing": True,
        "tied with negative": True,
        None: True,
        "of a log": True,
    }
    assert values(stopped_processors(sig(rows), AS_OF)) == [("runtime-a", 5)]


def test_stopped_processors_agree_with_ranking(sig):
    rng = random.Random(7)
    rows = [
        state(
            rng.choice(["0", "0", "1", "-2", None, "x", "0.0", "NaN"]),
            rng.randrange(0, 90, 10),
            rng.choice(["a", "b", "c", "d", "e", None]),
            rng.choice(["runtime-1", "runtime-2", "runtime-3", "system", None]),
        )
        for _ in range(600)
    ]
    for size in (40, 90, 200, 600):
        flat = sig(rows[:size])
        assert bag(stopped_processors(flat, AS_OF)) == bag(stopped_by_rank(flat, AS_OF, 1))


def test_selection(sig):
    rows = [state("0", 1, runtime=r) for r in ("runtime-a", "runtime-b", None)]
    assert bag(stopped_processors(sig(rows), AS_OF)) == [
        ("runtime-a", 1),
        ("runtime-b", 1),
        (None, 1),
    ]
    assert bag(stopped_processors(sig(rows), AS_OF, runtimes=["runtime-b"])) == [("runtime-b", 1)]


INVENTORY = [
    log(ago(days=400), "runtime-old"),
    log(ago(days=40), "runtime-edge"),
    log(ago(hours=24), "runtime-edge"),
    log(ago(hours=24) + timedelta(microseconds=1), "runtime-live"),
    row(ago(hours=1), "system"),
    row(AS_OF + timedelta(days=1), "runtime-future"),
    row(ago(hours=1), None),
]


def test_runtime_status(sig):
    found = {r.name: r for r in runtime_status(sig(INVENTORY), AS_OF, user_only=False).collect()}
    assert {name: (r.type, r.status, r.is_active) for name, r in found.items()} == {
        "runtime-old": ("User Created", "🔴 Inactive", False),
        "runtime-edge": ("User Created", "🔴 Inactive", False),
        "runtime-live": ("User Created", "🟢 Active", True),
        "runtime-future": ("User Created", "🟢 Active", True),
        "system": ("Internal", "🟢 Active", True),
    }
    edge = found["runtime-edge"]
    assert (edge.created_on, edge.last_event_time) == (ago(days=40), ago(hours=24))


def test_status_totals_follow_the_filter(sig):
    flat = sig(INVENTORY)
    assert values(runtime_status_totals(runtime_status(flat, AS_OF))) == [(4, 2, 2)]
    everything = runtime_status(flat, AS_OF, user_only=False)
    assert values(runtime_status_totals(everything)) == [(5, 3, 2)]
    none = runtime_status(sig([row(runtime=None)]), AS_OF)
    assert values(runtime_status_totals(none)) == [(0, 0, 0)]


def test_one_pass_equals_the_three_part_form(sig):
    flat = sig(INVENTORY)
    active = active_runtimes(flat, AS_OF, 24)
    parts = (
        known_runtimes(flat)
        .join(last_events(flat), "name", "left")
        .join(active, F.col("name") == F.col("active_runtime_name"), "left")
        .select(
            "name",
            F.col("active_runtime_name").isNotNull().alias("is_active"),
            "created_on",
            "last_event_time",
        )
    )
    fused = runtime_status(flat, AS_OF, 24, user_only=False)
    assert bag(fused.select(parts.columns)) == bag(parts)
    assert (None,) in values(active)


def test_recent_runtimes(sig):
    rows = [row(ago(hours=1), r) for r in ("runtime-b", "system", "runtime-a", None, "Zed")]
    rows += [row(ago(hours=1), "runtime-a"), row(ago(hours=24), "runtime-gone")]
    flat = sig(rows)
    assert values(recent_runtimes(flat, AS_OF)) == [("runtime-a",), ("runtime-b",)]
    assert values(recent_runtimes(flat, AS_OF, include_internal=True)) == [
        ("Zed",),
        ("runtime-a",),
        ("runtime-b",),
        ("system",),
    ]
