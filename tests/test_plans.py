"""The plans the reports should have over a stored table."""

from __future__ import annotations

import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import sluicewatch as sw
from sluicewatch.functions.vocabulary import QUEUED_BYTES, QUEUED_DURATION, RUN_STATUS
from sluicewatch.plans.shared import SETTING, shared_folder
from sluicewatch.plans.topk import top_k_of_scan
from tests.conftest import AS_OF, ago, bag, log, row

REPORTS = {
    "recent_runtimes": lambda s: sw.recent_runtimes(s, AS_OF),
    "high_error_runtimes": lambda s: sw.high_error_runtimes(s, AS_OF),
    "stopped_processors": lambda s: sw.stopped_processors(s, AS_OF),
    "kpi_trend": lambda s: sw.kpi_trend(s, AS_OF),
    "top_error_runtimes": lambda s: sw.top_error_runtimes(s, AS_OF),
    "error_runtimes": lambda s: sw.error_runtimes(s, AS_OF),
    "processor_errors": lambda s: sw.processor_errors(s, AS_OF, runtime="runtime-a"),
    "error_time_range": lambda s: sw.error_time_range(s, AS_OF, runtime="runtime-a"),
    "search_error_logs": lambda s: sw.search_error_logs(
        s, runtime="runtime-a", processor="p", time_range=(ago(days=1), AS_OF), term="m"
    ),
    "backpressure": lambda s: sw.backpressure(s, AS_OF),
    "queue_times": lambda s: sw.queue_times(s, AS_OF),
    "error_heatmap": lambda s: sw.error_heatmap(s, AS_OF),
    "runtime_status": lambda s: sw.runtime_status(s, AS_OF),
    "findings": lambda s: sw.findings(s, AS_OF),
}
ALL_HISTORY = {"runtime_status"}


@pytest.fixture(scope="module")
def tables(spark, telemetry, tmp_path_factory):
    """The same rows as a telemetry table and as a signals table."""
    folder = tmp_path_factory.mktemp("tables")
    rows = [log(ago(hours=h), f"runtime-{'abc'[h % 3]}") for h in range(0, 120, 5)]
    rows += [
        row(ago(hours=h), metric=m, value=str(h * 60000))
        for h in range(0, 72, 7)
        for m in (QUEUED_BYTES, QUEUED_DURATION, RUN_STATUS)
    ]
    telemetry(rows).write.parquet(f"{folder}/telemetry")
    raw = sw.read_telemetry(spark, f"{folder}/telemetry")
    sw.write_signals(sw.signals(raw), f"{folder}/signals")
    return raw, sw.read_signals(spark, f"{folder}/signals")


def plan(df, mode="formatted") -> str:
    jvm = df.sparkSession._jvm
    explain = jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    return df._jdf.queryExecution().explainString(explain)


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_same_result_over_telemetry_and_stored_signals(tables, name):
    raw, stored = tables
    direct = REPORTS[name](sw.signals(raw, error_level_only=True))
    assert bag(REPORTS[name](stored)) == bag(direct)


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_stored_signals_prune(tables, name):
    """Date partitions are pruned, and the scan reads no column the report does not use."""
    text = plan(REPORTS[name](tables[1]))
    scans = re.findall(r"ReadSchema: struct<(.*)>", text)
    most = 7 if name == "findings" else 6  # findings has both kinds of records in one scan
    assert scans and all(scan.count(":") <= most for scan in scans)
    assert "value_num" not in "".join(scans) or name not in (
        "top_error_runtimes",
        "error_heatmap",
        "search_error_logs",
    )
    if name not in ALL_HISTORY:
        assert re.search(r"PartitionFilters: \[.*event_date.*event_hour.*>=", text)


@pytest.fixture(scope="module")
def skewed(spark):
    """40,000 rows on 8 tasks, more than a third of them of one runtime and processor."""
    n = F.col("id")
    hot = F.pmod(F.xxhash64("id"), F.lit(5)) < 2
    return (
        spark.range(0, 40000, 1, 8)
        .select(
            (F.expr("timestamp_ntz'2024-03-14 12:00:00'") - F.make_dt_interval(secs=n % 1700)).alias(
                "timestamp"
            ),
            F.when(hot, "runtime-a").otherwise(F.concat(F.lit("runtime-"), n % 20)).alias("runtime"),
            F.when(hot, "c-hot").otherwise(F.concat(F.lit("c-"), n % 3)).alias("component"),
            F.when(n % 2 == 0, "LOG").otherwise("METRIC").alias("record_type"),
            F.when(n % 6 == 1, RUN_STATUS)
            .when(n % 6 == 3, QUEUED_BYTES)
            .when(n % 6 == 5, QUEUED_DURATION)
            .alias("metric_name"),
            F.when(n % 6 == 1, 0.0).otherwise(n % 7).cast("double").alias("value_num"),
            F.when(n % 2 == 0, "ERROR").alias("level"),
            F.when(hot, "p").otherwise(F.concat(F.lit("p-"), n % 6)).alias("logger"),
            F.concat(F.lit("message "), n).alias("message"),
        )
        .withColumn("event_date", F.col("timestamp").cast("date"))
        .withColumn("event_hour", F.hour("timestamp"))
        .select(*sw.SIGNALS_SCHEMA.fieldNames())
    )


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_a_hot_key_shuffles_no_more_rows_than_any_other(spark, skewed, name):
    """What crosses a shuffle depends on tasks and keys, not on the rows of a key."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps the metrics at hand
    try:
        report = REPORTS[name](skewed)
        assert report.collect()
        nodes, written = [report._jdf.queryExecution().executedPlan()], []
        while nodes:
            node = nodes.pop()
            metric = node.metrics().get("shuffleRecordsWritten")
            written += [metric.get().value()] if metric.isDefined() else []
            nodes += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    keys = 200 if name == "search_error_logs" else 21 * 4 * 2
    assert written and max(written) <= 8 * keys


def test_short_windows_read_few_hours(spark, tables):
    """Of the five days stored, half an hour lies in two hours at most."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps the scan's metrics at hand
    try:
        report = sw.high_error_runtimes(tables[1], AS_OF, 30, 0)
        assert report.count() == 1
        read = report._jdf.queryExecution().executedPlan()
        report.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    scan = read.collectLeaves().apply(0)
    assert 1 <= scan.metrics().apply("numPartitions").value() <= 2


@pytest.mark.parametrize("source", [0, 1])
def test_findings_scan_once(tables, source):
    sig = sw.signals(tables[0], error_level_only=True) if source == 0 else tables[1]
    text = plan(REPORTS["findings"](sig), "simple")
    assert text.count("FileScan") == 1 and "Union" not in text


def test_error_predicates_reach_the_scan(tables):
    text = plan(REPORTS["search_error_logs"](tables[1]))
    pushed = re.search(r"PushedFilters: \[(.*)\]", text).group(1)
    for column in ("record_type,LOG", "level,ERROR", "runtime,runtime-a", "logger,p"):
        assert f"EqualTo({column})" in pushed


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_no_python_no_cross_join(tables, name):
    for source in (sw.signals(tables[0], error_level_only=True), tables[1]):
        text = plan(REPORTS[name](source))
        for operator in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "SortMergeJoin"):
            assert operator not in text


@pytest.mark.parametrize(
    "name", ["top_error_runtimes", "processor_errors", "backpressure", "queue_times"]
)
def test_top_k_reports_do_not_sort_everything(tables, name):
    text = plan(REPORTS[name](tables[1]), "simple")
    assert "TakeOrderedAndProject" in text
    assert "rangepartitioning" not in text


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_aggregates_hash_and_combine_before_the_shuffle(tables, name):
    text = plan(REPORTS[name](tables[1]), "simple")
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text
    if name != "search_error_logs":
        assert "partial_" in text or "HashAggregate(keys=[runtime" in text


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_generated_methods_stay_small_enough_to_be_compiled(tables, name):
    """HotSpot leaves methods over 8000 bytes of bytecode interpreted."""
    for source in (sw.signals(tables[0], error_level_only=True), tables[1]):
        report = REPORTS[name](source)
        report.collect()
        sizes = re.findall(r"maxMethodCodeSize:(\d+)", plan(report, "codegen"))
        assert all(int(size) < 8000 for size in sizes), sizes


@pytest.mark.parametrize("limit", [200, 5000])
def test_search_limits_before_and_after_one_shuffle(tables, limit):
    found = sw.search_error_logs(tables[1], runtime="runtime-2", limit=limit)
    text = plan(found, "simple")
    assert "Window" not in text
    assert text.count("Exchange") == 1
    before, after = text[text.index("Exchange") :], text[: text.index("Exchange")]
    assert re.search(r"Filter .*__place.* < ", before) and re.search(r"Filter .*__place.* < ", after)


@pytest.mark.parametrize("k", [60, 1500])
@pytest.mark.parametrize("groups", [1, 3, 128])
def test_top_k_of_scan_is_exact(spark, groups, k):
    rows = spark.range(0, 5000, 1, 23).select(
        F.pmod(F.xxhash64("id"), F.lit(700)).alias("a"), F.pmod(F.col("id"), F.lit(3)).alias("b")
    )
    order = (F.desc("a"), F.asc("b"))
    expected = sorted((tuple(r) for r in rows.collect()), key=lambda r: (-r[0], r[1]))[:k]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", groups)
    try:
        found = [tuple(r) for r in top_k_of_scan(rows, k, order).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == expected


def session(master, **settings):
    conf = SimpleNamespace(get=lambda key, default: settings.get(key, default))
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_shared_folder_is_the_one_the_session_names():
    named = {SETTING: "/shared/folder"}
    assert shared_folder(session("yarn", **named)) == "/shared/folder"
    assert shared_folder(session("local[8]", **named)) == "/shared/folder"


def test_shared_folder_of_a_session_that_names_none():
    assert shared_folder(session("local[8]")) != shared_folder(session("local[8]"))
    with pytest.raises(ValueError, match=SETTING):
        shared_folder(session("yarn"))
