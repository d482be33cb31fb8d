"""Roll-up tables: batches, merging behind readers, and reports equal to those of signals."""

from __future__ import annotations

import json
import random
import re
from datetime import timedelta
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import sluicewatch as sw
from sluicewatch.functions.vocabulary import QUEUED_DURATION, RUN_STATUS
from sluicewatch.rollups import alerts, hourly, inventory
from sluicewatch.rollups.table import FAN, RollupTable
from sluicewatch.streaming import live
from tests.conftest import AS_OF, ago, bag, log, row
from tests.test_plans import plan


def mixed_rows(seed=1, n=400):
    """Logs and samples of many runtimes over days, with ties, gaps and a far future."""
    dice = random.Random(seed)
    rows = []
    for _ in range(n):
        at = ago(minutes=dice.choice([0, 1, 30, 60, 61, 1439, 1440, 1441, *range(0, 9000, 37)]), seconds=dice.choice([0, 0, 1]))
        runtime = dice.choice([None, "runtime-a", "runtime-b", "runtime-c", "system-1"])
        component = dice.choice([None, "c1", "c2"])
        rows.append(dice.choice([
            log(at, runtime), log(at, runtime, "INFO"),
            row(at, runtime, component, metric=QUEUED_DURATION, value=dice.choice(["60000", "5", "x", None, "-3"])),
            row(at, runtime, component, metric=RUN_STATUS, value=dice.choice(["0", "1", None])),
            row(at, runtime, component, "OTHER", value='{"level":"ERROR"}'),
        ]))
    rows.append((rows[0][0] + timedelta(days=30000), *rows[0][1:]))
    rows.append(row(None, "runtime-timeless", metric="m", value="1"))
    return rows


@pytest.fixture(scope="module")
def rows():
    return mixed_rows()


@pytest.fixture
def table(spark, tmp_path):
    return lambda rollup, name="table": RollupTable(spark, f"{tmp_path}/{name}", rollup)


ROLLUPS = {"inventory": inventory.INVENTORY, "current": inventory.CURRENT, "hourly": hourly.HOURLY, "panes": alerts.PANES}


@pytest.mark.parametrize("name", sorted(ROLLUPS))
def test_batches_merge_into_the_whole(sig, rows, table, name):
    """In any order, put twice, merged in between, and put again afterwards."""
    rollup = ROLLUPS[name]
    whole = bag(rollup.partials(sig(rows)).select(*rollup.schema.names))
    parts = [rows[k::4] for k in range(4)]
    kept = table(rollup)
    assert bag(kept.rows()) == []
    kept.put(sig(rows[:50]), 3)
    kept.put(sig(parts[3]), 3)
    kept.put(sig(parts[1]), 1, writer="other")
    assert kept.compact()
    kept.put(sig(parts[1]), 1, writer="other")
    kept.put(sig(parts[0]), 1)
    kept.put(sig(parts[2]), 7)
    assert not kept.compact(least=3)
    assert bag(kept.rows()) == whole
    assert kept.compact(least=2) and not kept.compact()
    assert bag(kept.rows()) == whole and kept.partials().count() >= len(whole)


def fake_batches(table, batches):
    """Finished batches, a file each, as a writer leaves them."""
    at = Path(table.folder.path) / "batches" / "stream"
    for number in batches:
        folder = at / str(number)
        folder.mkdir(parents=True)
        one = {"runtime": [f"runtime-{number % 3}", None], "component": ["c", "c"]}
        for k, mark in enumerate(("last_seen", "last_zero", "last_positive")):
            values = [AS_OF + timedelta(minutes=number * (k + 1) % 97), AS_OF - timedelta(minutes=number)]
            one[mark] = pa.array(values, pa.timestamp("us"))
        pq.write_table(pa.table(one), folder / "part-0.parquet")
        (folder / "_SUCCESS").touch()


def test_500_batches_are_read_as_a_few_files(spark, table):
    kept, plain = table(inventory.CURRENT), table(inventory.CURRENT, "plain")
    fake_batches(plain, range(500))
    for start in range(0, 500, 10):
        fake_batches(kept, range(start, start + 10))
        assert kept.compact(least=10)
    fake_batches(kept, range(500, 503))
    fake_batches(plain, range(500, 503))
    assert len(plain.partials().inputFiles()) == 503
    runs = len(kept._manifest().runs)
    # 50 merges: fewer than FAN runs of each level, and each of few files.
    assert runs <= 2 * FAN and len(kept.partials().inputFiles()) <= 8 * runs + 3
    assert bag(kept.rows()) == bag(plain.rows())
    assert kept._manifest().covered == {"stream": [[0, 499]]}
    # What the last two generations don't need is gone.
    assert len(kept.folder.names("batches", "stream")) <= 10 + 3
    assert len(kept.folder.names("manifests")) == 2
    assert len(kept.folder.names("runs")) <= 2 * FAN + 2


def test_a_row_is_merged_again_seldom(spark, table):
    """Runs of a level become one of the next: work grows with the logarithm."""
    kept, levels = table(inventory.CURRENT), []
    for number in range(FAN * 2 + 1):
        fake_batches(kept, [number])
        kept.compact()
        levels.append(sorted(int(r.split("-")[0]) for r in kept._manifest().runs))
    assert levels[FAN - 2] == [0] * (FAN - 1) and levels[FAN - 1] == [1]
    assert levels[2 * FAN - 1] == [1, 1] and levels[2 * FAN] == [0, 1, 1]


def test_readers_are_not_disturbed(sig, rows, table):
    """A reader that has looked at the table keeps what it saw through the next merge."""
    kept = table(inventory.INVENTORY)
    whole = bag(inventory.INVENTORY.partials(sig(rows)))
    kept.put(sig(rows[::2]), 0)
    kept.compact()
    kept.put(sig(rows[1::2]), 1)
    before = kept.rows()
    kept.compact()
    assert bag(before) == bag(kept.rows()) == whole


def test_unfinished_and_failed_work_is_not_read(sig, rows, table, monkeypatch):
    kept = table(inventory.INVENTORY)
    kept.put(sig(rows), 0)
    whole = bag(kept.rows())
    half = Path(kept.folder.of("batches", "batch", 1))
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"half")
    assert bag(kept.rows()) == whole
    with monkeypatch.context() as m:
        m.setattr(kept.folder.__class__, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            kept.compact()
    assert bag(kept.rows()) == whole
    assert kept.compact() and bag(kept.rows()) == whole


def test_a_second_merger_fails_and_changes_nothing(sig, rows, table):
    kept = table(inventory.INVENTORY)
    kept.put(sig(rows), 0)
    old = kept._manifest()
    kept.compact()
    with pytest.raises(FileExistsError):
        kept._publish(old.__class__(1, [], {}))
    assert len(kept._manifest().runs) == 1


def test_manifests_name_ranges(spark, table):
    kept = table(inventory.CURRENT)
    fake_batches(kept, [5, 3, 4, 9])
    kept.compact()
    stored = json.loads(kept.folder.read("manifests", f"{1:012d}.json"))
    assert stored["covered"] == {"stream": [[3, 5], [9, 9]]} and stored["generation"] == 1


@pytest.mark.parametrize("hours", [1, 24, 24.5, 100])
def test_inventory_and_status_equal_signals(sig, rows, table, hours):
    flat, seen, current = sig(rows), table(inventory.INVENTORY, "i"), table(inventory.CURRENT, "c")
    for kept in (seen, current):
        for k in range(3):
            kept.put(sig(rows[k::3]), k)
        kept.compact(least=2)
    i, c = seen.partials(), current.partials()
    assert bag(inventory.known_runtimes(i)) == bag(sw.known_runtimes(flat))
    assert bag(inventory.last_events(i)) == bag(sw.last_events(flat))
    assert bag(inventory.active_runtimes(i, AS_OF, hours)) == bag(sw.active_runtimes(flat, AS_OF, hours))
    for user_only in (False, True):
        assert bag(inventory.runtime_status(i, AS_OF, hours, user_only)) == bag(sw.runtime_status(flat, AS_OF, hours, user_only))
    for chosen in (None, ["runtime-a"]):
        expected = bag(sw.processor_status(flat, AS_OF, hours, chosen))
        assert bag(inventory.processor_status(c, AS_OF, hours, chosen)) == expected
        assert bag(inventory.stopped_processors(c, AS_OF, hours, chosen)) == bag(sw.stopped_processors(flat, AS_OF, hours, chosen))
    assert current.rows().count() <= 5 * 3  # processors, not samples


def test_inventory_reads_the_rollup_only(sig, rows, table):
    kept = table(inventory.INVENTORY)
    kept.put(sig(rows), 0)
    kept.compact()
    text = plan(inventory.runtime_status(kept.partials(), AS_OF))
    assert text.count("Scan parquet") == 2  # once in the tree, once in the details
    assert "ReadSchema: struct<runtime:string,first_event:timestamp_ntz,last_event:timestamp_ntz>" in text
    assert text.count("Exchange") == 2 and "StartsWith" in text


@pytest.mark.parametrize("as_of", [AS_OF, AS_OF + timedelta(minutes=24, seconds=1), AS_OF - timedelta(microseconds=1)])
@pytest.mark.parametrize("hours", [1, 24, 72])
def test_windows_with_edges_inside_hours(spark, sig, rows, table, tmp_path, as_of, hours):
    flat, kept = sig(rows), table(hourly.HOURLY)
    for k in range(3):
        kept.put(sig(rows[k::3]), k)
    kept.compact(least=2)
    sw.write_signals(flat, f"{tmp_path}/signals")
    stored, h = sw.read_signals(spark, f"{tmp_path}/signals"), kept.partials()
    chosen = ["runtime-a", "system-1"]
    for some in (None, chosen):
        assert bag(hourly.kpi_trend(h, stored, as_of, hours, some)) == bag(sw.kpi_trend(flat, as_of, hours, some))
        assert bag(hourly.error_heatmap(h, stored, as_of, hours, None, some)) == bag(sw.error_heatmap(flat, as_of, hours, None, some))
        assert bag(hourly.top_error_runtimes(h, stored, as_of, hours, 3, some)) == bag(sw.top_error_runtimes(flat, as_of, hours, 3, some))
    one = hourly.error_heatmap(h, stored, as_of, hours, "runtime-b", chosen)
    assert bag(one) == bag(sw.error_heatmap(flat, as_of, hours, "runtime-b", chosen))


def test_raw_rows_are_read_for_one_hour_at_most(spark, sig, rows, table, tmp_path):
    kept = table(hourly.HOURLY)
    kept.put(sig(rows), 0)
    sw.write_signals(sig(rows), f"{tmp_path}/signals")
    stored = sw.read_signals(spark, f"{tmp_path}/signals")
    edge = AS_OF + timedelta(minutes=24)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps the scan's metrics at hand
    try:
        report = hourly.kpi_trend(kept.partials(), stored, edge, 72)
        report.collect()
        leaves = report._jdf.queryExecution().executedPlan().collectLeaves()
        scans = [leaves.apply(i) for i in range(leaves.size())]
        raw = [x for x in scans if x.metrics().get("numPartitions").isDefined()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(scans) == 2 and len(raw) == 1
    assert raw[0].metrics().apply("numPartitions").value() <= 1
    assert re.search(r"PushedFilters: [^\n]*GreaterThan\(event_date", plan(report))


@pytest.mark.parametrize("minutes, slide, least", [(30, 5, 0), (30, 5, 1), (60, 15, 0), (5, 5, 0)])
def test_alerts_from_panes(sig, rows, table, minutes, slide, least):
    kept = table(alerts.PANES)
    for k in range(3):
        kept.put(sig(rows[k::3]), k)
    found = alerts.error_alerts(kept.partials(), minutes, slide, least)
    window = F.window("timestamp", f"{minutes} minutes", f"{slide} minutes")
    errors = sig(rows).where("record_type = 'LOG' AND level = 'ERROR'").groupBy(window.alias("w"), "runtime")
    expected = errors.agg(F.count("*").alias("n")).where(F.col("n") > least).select("w.start", "w.end", "runtime", "n")
    assert bag(found) == bag(expected) and found.count()


def test_windows_are_multiples_of_panes(sig, table):
    with pytest.raises(ValueError, match="multiples"):
        alerts.error_alerts(table(alerts.PANES).partials(), 32)


def test_only_counts_are_copied_to_windows(sig, rows, table):
    """Neither the stored nor the streamed form expands rows before they are counted."""
    kept = table(alerts.PANES)
    kept.put(sig(rows), 0)
    for found in (alerts.error_alerts(kept.partials()), live.error_alerts(sig(rows))):
        text = plan(found, "simple")
        above, below = text[: text.index("Expand")], text[text.index("Expand") :]
        assert text.count("Expand") == 1 and "HashAggregate" in above and "HashAggregate" in below


def test_streams_keep_merging(spark, telemetry, sig, tmp_path):
    """Small batches, a future row in the first: nothing is lost, and folders stay few."""
    source, rows = f"{tmp_path}/source", mixed_rows(5, 120)
    rows.sort(key=lambda r: (r[0] is None, r[0]), reverse=True)
    tables = {name: RollupTable(spark, f"{tmp_path}/{name}", ROLLUPS[name]) for name in ("hourly", "inventory")}
    for k in range(0, len(rows), 10):
        telemetry(rows[k : k + 10]).coalesce(1).write.mode("append").parquet(source)
    events = spark.readStream.schema(telemetry([]).schema).option("maxFilesPerTrigger", 1).parquet(source)
    for name, kept in tables.items():
        kept.stream(sw.signals(events), f"{tmp_path}/{name}-checkpoint", merge_every=3).awaitTermination()
        whole = ROLLUPS[name].partials(sig(rows)).select(*ROLLUPS[name].schema.names)
        assert bag(kept.rows()) == bag(whole)
        assert kept._manifest().generation == 4 and len(kept.folder.names("batches", "stream")) <= 4
    # Going on with the same checkpoint adds what is new and nothing twice.
    more = [log(ago(hours=3), "runtime-new")]
    telemetry(more).coalesce(1).write.mode("append").parquet(source)
    kept = tables["hourly"]
    kept.stream(sw.signals(events), f"{tmp_path}/hourly-checkpoint").awaitTermination()
    assert bag(kept.rows()) == bag(hourly.HOURLY.partials(sig(rows + more)).select(*hourly.HOURLY.schema.names))
