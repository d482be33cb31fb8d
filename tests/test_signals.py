from __future__ import annotations

import json
import re
from collections import Counter
from datetime import date, datetime
from functools import reduce

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluicewatch import read_signals, signals, telemetry_since, write_signals
from sluicewatch.sources import signals as signals_source
from sluicewatch.sources.signals import SIGNALS_SCHEMA, _may_say
from tests.conftest import ago, bag, log, row

JSON_EDGES = [
    ('{"level":"ERROR","loggerName":"p","formattedMessage":"m"}', ("ERROR", "p", "m")),
    ('{"LEVEL":"ERROR"}', (None, None, None)),
    ('{"level":"error"}', ("error", None, None)),
    ('{"level":"ERROR"', (None, None, None)),
    ("17", (None, None, None)),
    ('"ERROR"', (None, None, None)),
    ("null", (None, None, None)),
    ('{"level":null}', (None, None, None)),
    ('{"level":5}', ("5", None, None)),
    ('{"level":"INFO","level":"ERROR"}', (None, None, None)),
    ('{"a":{"level":"ERROR"}}', (None, None, None)),
    ('["level","ERROR"]', (None, None, None)),
    ("", (None, None, None)),
    ('{"level":"ERROR"} tail', ("ERROR", None, None)),
    ("{'level':'ERROR'}", (None, None, None)),
    ('  {"level" : "ERROR"}', ("ERROR", None, None)),
    ('{"level":"\\u0045RROR"}', ("ERROR", None, None)),
    (None, (None, None, None)),
]


@pytest.mark.parametrize("error_level_only", [False, True])
def test_json_edges(telemetry, error_level_only):
    rows = [row(component=str(i), kind="LOG", value=v) for i, (v, _) in enumerate(JSON_EDGES)]
    flat = signals(telemetry(rows), error_level_only=error_level_only)
    found = {
        int(r.component): (r.level, r.logger, r.message)
        for r in flat.select("component", "level", "logger", "message").collect()
    }
    for i, (text, expected) in enumerate(JSON_EDGES):
        if error_level_only and expected[0] != "ERROR":
            assert found[i][0] != "ERROR", text
        else:
            assert found[i] == expected, text


def test_numbers(sig):
    texts = ["12", "-1.5", "1e3", " 7 ", "abc", "", None, '{"level":"ERROR"}', "[1]"]
    rows = [row(component=str(i), value=v) for i, v in enumerate(texts)]
    found = {int(r.component): r.value_num for r in sig(rows).collect()}
    assert [found[i] for i in range(len(texts))] == [
        12.0,
        -1.5,
        1000.0,
        7.0,
        None,
        None,
        None,
        None,
        None,
    ]


def test_schema_and_missing_attributes(sig):
    flat = sig([row(ago(days=1), None, None, "METRIC", None, "1")])
    assert [(f.name, f.dataType) for f in flat.schema] == [
        (f.name, f.dataType) for f in SIGNALS_SCHEMA
    ]
    got = flat.first()
    assert (got.runtime, got.component, got.metric_name) == (None, None, None)
    assert (got.event_date, got.event_hour) == (date(2024, 3, 13), 12)


@pytest.mark.parametrize("shape", ["struct", "json", "variant"])
def test_other_attribute_types(spark, telemetry, shape):
    plain = telemetry([row(runtime="runtime-x", metric="m", value="3"), log(message='say "hi"')])
    if shape == "struct":
        other = plain
        keys = {"resource_attributes": "k8s.namespace.name", "record_attributes": "name"}
        for column, key in keys.items():
            other = other.withColumn(column, F.struct(F.col(column)[key].alias(key)))
    else:
        other = plain
        for column in ("resource_attributes", "record_attributes", "record"):
            other = other.withColumn(column, F.to_json(column))
            if shape == "variant":
                other = other.withColumn(column, F.parse_json(column))
        if shape == "variant":
            # Numbers and JSON texts as a warehouse keeps them in one VARIANT column.
            other = other.withColumn(
                "value",
                F.when(
                    F.col("record_type") == "LOG", F.to_variant_object(F.array("value"))
                ).otherwise(F.parse_json("value")),
            ).withColumn(
                "value",
                F.coalesce(F.try_variant_get("value", "$[0]", "variant"), F.col("value")),
            )
    assert bag(signals(other)) == bag(signals(plain))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_instants_become_utc_wall_clock(spark, telemetry, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        instants = telemetry([row()]).withColumn(
            "timestamp", F.expr("timestamp '2024-03-10 07:30:00.123456 UTC'")
        )
        got = signals(instants).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got.timestamp == datetime(2024, 3, 10, 7, 30, 0, 123456)
    assert got.event_date == date(2024, 3, 10)


escapes = st.sampled_from(["E", "R", "O", "\\u0045", "\\u0052", "\\u004f", "\\u004F", "\\n", "x"])


@settings(max_examples=1, deadline=None)
@given(st.lists(st.lists(escapes, min_size=3, max_size=7), min_size=400, max_size=400))
def test_error_guard_never_hides_an_error(spark, spellings):
    texts = ['{"level":"' + "".join(parts) + '"}' for parts in spellings]
    texts += ['{"level":"' + "".join(p) + '"}' for p in zip("ERROR")]
    texts += ['{"level":"ERR\\u004fR"}', '{"level":"ERROR"}']
    guarded = spark.createDataFrame([(t,) for t in texts], "t string").where(
        ~_may_say(F.col("t"), "ERROR")
    )
    assert all(json.loads(r.t)["level"] != "ERROR" for r in guarded.collect())


@pytest.mark.parametrize("partition_by", [["event_date", "event_hour"], ["event_date"]])
@pytest.mark.parametrize("compact", [None, False, True])
def test_stored_signals_round_trip(spark, sig, tmp_path, partition_by, compact):
    rows = [log(ago(days=i), f"runtime-{i}") for i in range(4)] + [
        row(ago(days=1), metric="m", value="4")
    ]
    rows.append(row(None, metric="m", value="5"))
    flat, path = sig(rows), str(tmp_path / "signals")
    write_signals(flat, path, partition_by=partition_by, compact=compact)
    assert bag(read_signals(spark, path)) == bag(flat)
    assert read_signals(spark, path).columns == SIGNALS_SCHEMA.fieldNames()


def test_overwrite_replaces_only_its_partitions(spark, sig, tmp_path):
    path = str(tmp_path / "signals")
    write_signals(sig([log(ago(days=1)), log(ago(days=2))]), path)
    again = sig([log(ago(days=1), message="new")])
    write_signals(again, path, mode="overwrite")
    stored = {(r.event_date, r.message) for r in read_signals(spark, path).collect()}
    assert stored == {(date(2024, 3, 13), "new"), (date(2024, 3, 12), "m")}


def test_compact_splits_a_hot_hour(spark, sig, tmp_path):
    """An hour with nearly all rows is written by several tasks, and nothing is lost."""
    path = str(tmp_path / "signals")
    flat = sig([row(ago(days=1))]).select(
        *[c for c in SIGNALS_SCHEMA.fieldNames() if c not in ("message", "runtime")]
    )
    many = (
        spark.range(0, 40000, 1, 8)
        .crossJoin(F.broadcast(flat))
        .withColumn("runtime", F.sha2(F.col("id").cast("string"), 512))
        .withColumn("message", F.sha2(F.col("runtime"), 512))
        .withColumn("event_date", F.expr("if(id < 10, date'2024-01-01', event_date)"))
        .select(*SIGNALS_SCHEMA.fieldNames())
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1MB")
    try:
        write_signals(many, path, compact=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    stored = spark.read.parquet(path)
    files = stored.where("event_date = date'2024-03-13'").select(F.input_file_name()).distinct()
    assert stored.count() == 40000
    assert files.count() > 1


def test_only_plain_decimals_are_numbers(sig):
    texts = ["5d", "5f", "0x1p3", "NaN", "Infinity", "-inf", "1e3", " 7 ", "-.5", "+2.", "1.2.3", ""]
    rows = [row(value=t, component=t) for t in texts]
    found = {r.component: r.value_num for r in sig(rows).collect()}
    assert {k: v for k, v in found.items() if v is not None} == {"1e3": 1000, " 7 ": 7, "-.5": -0.5, "+2.": 2}


@pytest.fixture(scope="module")
def disordered(spark):
    """40,000 rows over 50 hours on 16 tasks, in no order, three quarters of them in one hour."""
    hour = F.when(F.xxhash64("id") % 4 != 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(50)))
    at = F.expr("timestamp_ntz'2024-03-10 00:00:00'") + F.make_dt_interval(hours=hour.cast("int"), secs=F.col("id") % 3600)
    return spark.range(0, 40000, 1, 16).select(
        F.when(F.col("id") % 1000 != 3, at).alias("timestamp"),
        *(F.lit(None).cast("string").alias(c) for c in ("runtime", "component", "record_type", "metric_name")),
        F.col("id").cast("double").alias("value_num"),
        *(F.lit(None).cast("string").alias(c) for c in ("level", "logger", "message")),
    ).withColumn("event_date", F.col("timestamp").cast("date")).withColumn("event_hour", F.hour("timestamp")).select(
        *SIGNALS_SCHEMA.fieldNames()
    )


@pytest.mark.parametrize("partition_by", [["event_date", "event_hour"], ["event_date"]])
def test_writer_splits_hot_hours_itself(spark, disordered, tmp_path, partition_by):
    """Files of bounded size, few of them, whatever the order and without adaptive execution."""
    path, target = str(tmp_path / "signals"), 3000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        write_signals(disordered, path, partition_by=partition_by, rows_per_file=target)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    stored = spark.read.parquet(path)
    files = stored.groupBy(*partition_by, F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()
    sizes = Counter()
    for r in files:
        sizes[tuple(r[: len(partition_by)])] += r.n
    assert sum(sizes.values()) == 40000 and max(sizes.values()) > 25000
    assert all(r.n <= target for r in files)
    for place, rows in sizes.items():
        assert sum(tuple(r[: len(partition_by)]) == place for r in files) <= -(-rows // (0.92 * target)) + 2, place
    assert bag(read_signals(spark, path).select("value_num")) == bag(disordered.select("value_num"))


def test_writer_spreads_a_hot_hour_evenly(spark, disordered):
    placed = signals_source._placed(disordered, ["event_date", "event_hour"], 3000)
    sizes = [r.n for r in placed.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 15 and max(sizes) <= 3000
    text = placed._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in text and "BroadcastNestedLoop" not in text


def test_writer_with_more_partitions_than_it_counts(spark, disordered, tmp_path, monkeypatch):
    monkeypatch.setattr(signals_source, "COUNTED_PARTITIONS", 10)
    path = str(tmp_path / "signals")
    write_signals(disordered, path, rows_per_file=3000)
    assert bag(read_signals(spark, path).select("value_num")) == bag(disordered.select("value_num"))
    rows = spark.read.parquet(path).groupBy(F.input_file_name()).count()
    assert rows.agg(F.max("count")).first()[0] <= 3000


def test_writer_refuses_signals_that_know_errors_only(spark, telemetry, tmp_path):
    partly = signals(telemetry([log(level="INFO"), log()]), error_level_only=True)
    for frame in (partly, partly.where("runtime = 'runtime-a'")):
        with pytest.raises(ValueError, match="error_level_only"):
            write_signals(frame, str(tmp_path / "signals"))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_bounds_on_instants_reach_the_scan(spark, telemetry, tmp_path, zone):
    """TIMESTAMP telemetry is cut at the exact instant, before it is flattened."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        times = ["2024-03-10 06:59:59.999999", "2024-03-10 07:00:00", "2024-03-10 07:00:00.000001", "2024-03-10 08:30:00", "2024-03-10 08:30:00.000001"]
        one = telemetry([row()]).drop("timestamp")
        rows = [one.withColumn("timestamp", F.expr(f"timestamp '{t} UTC'")) for t in times]
        frame = reduce(lambda a, b: a.unionByName(b), rows)
        frame.coalesce(1).write.parquet(f"{tmp_path}/instants")
        stored = spark.read.parquet(f"{tmp_path}/instants")
        recent = telemetry_since(stored, "2024-03-11 07:00:00", 24)
        got = [r.timestamp for r in signals(recent).orderBy("timestamp").collect()]
        until = telemetry_since(stored, "2024-03-11 07:00:00", 24, until="2024-03-10 08:30:00")
        assert signals(until).count() == 2
        text = signals(recent)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [t.isoformat(sep=" ") for t in got] == times[2:]
    assert re.search(r"PushedFilters: \[[^]]*GreaterThan\(timestamp,2024-03-10", text)


def test_bounds_on_wall_clocks(telemetry):
    rows = [row(ago(hours=h)) for h in (23, 24, 25)] + [row(ago(hours=-5)), row(None)]
    assert telemetry_since(telemetry(rows), ago(), 24).count() == 2


#: JSON of a VARIANT value, and the level, logger, message and number it stands for.
VARIANTS = [
    ('{"level":"ERROR","loggerName":"p","formattedMessage":"m"}', ("ERROR", "p", "m", None)),
    ('{"level":"INFO","formattedMessage":5,"other":[1]}', ("INFO", None, "5", None)),
    ('{"loggerName":null}', (None, None, None, None)),
    ('{"LEVEL":"ERROR"}', (None, None, None, None)),
    ("{}", (None, None, None, None)),
    (json.dumps('{"level":"ERROR","loggerName":"text"}'), ("ERROR", "text", None, None)),
    (json.dumps('{"level":"\\u0045RROR"}'), ("ERROR", None, None, None)),
    (json.dumps('{"level":"ERROR"'), (None, None, None, None)),
    (json.dumps(" 12.5 "), (None, None, None, 12.5)),
    (json.dumps("5d"), (None, None, None, None)),
    ("17", (None, None, None, 17.0)),
    ("-1.5", (None, None, None, -1.5)),
    ("1e3", (None, None, None, 1000.0)),
    ("true", (None, None, None, None)),
    ("null", (None, None, None, None)),
    ('[{"level":"ERROR"}]', (None, None, None, None)),
    (None, (None, None, None, None)),
]


@pytest.mark.parametrize("error_level_only", [False, True])
@pytest.mark.parametrize("stored", [False, True])
def test_variant_values(spark, telemetry, tmp_path, error_level_only, stored):
    rows = [row(component=str(i), kind="LOG", value=v) for i, (v, _) in enumerate(VARIANTS)]
    frame = telemetry(rows).withColumn("value", F.parse_json("value"))
    if stored:
        frame.write.parquet(f"{tmp_path}/variants")
        frame = spark.read.parquet(f"{tmp_path}/variants")
    flat = signals(frame, error_level_only=error_level_only)
    for r in flat.collect():
        value, expected = VARIANTS[int(r.component)]
        got = (r.level, r.logger, r.message, r.value_num)
        if error_level_only and expected[0] != "ERROR":
            assert got[0] != "ERROR" and got[1:] == expected[1:], value
        else:
            assert got == expected, value


def test_variants_are_parsed_once_at_most(spark, telemetry):
    frame = telemetry([log()]).withColumn("value", F.parse_json("value"))
    frame.createOrReplaceTempView("variant_values")
    source = spark.table("variant_values").repartition(2)  # hides the literal rows from the optimizer
    for only in (False, True):
        text = signals(source, error_level_only=only)._jdf.queryExecution().optimizedPlan().toString()
        above = text[: text.index("Repartition")]
        assert above.lower().count("parse_json") + above.count("parseJson") <= 1


def test_variants_are_stored_shredded(spark, telemetry, tmp_path):
    """Fields of objects that most rows have become columns, which a scan reads alone."""
    many = [log(message=f"m{i}") for i in range(200)]
    telemetry(many).withColumn("value", F.parse_json("value")).coalesce(1).write.parquet(f"{tmp_path}/shredded")
    file = next((tmp_path / "shredded").glob("*.parquet"))
    assert "typed_value" in str(pq.read_schema(file))
    stored = spark.read.parquet(f"{tmp_path}/shredded")
    assert {r.message for r in signals(stored).collect()} == {f"m{i}" for i in range(200)}
