"""Entry points of the check tool: the flagship query, all queries, their SQL oracles.

Every query reads the whole ``events`` table, as telemetry (see
``telemetry_from_events``). Windows are longer than the defaults where the test
data is too sparse for these.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import sluicewatch as sw
from sluicewatch.functions.predicates import is_user_runtime
from sluicewatch.functions.timewin import bucket_start, within
from sluicewatch.plans.shared import shared_folder
from sluicewatch.rollups import alerts, hourly, inventory
from sluicewatch.rollups.table import Rollup, RollupTable
from sluicewatch.sources import text_index
from sluicewatch.sources.telemetry import EVENTS_SCHEMA

AS_OF = "2024-01-31 00:00:00"
EARLIER = "2024-01-29 17:23:45"  # inside an hour
WEEK = 168
ZONE = "spark.sql.session.timeZone"
PARTS = "spark.sql.shuffle.partitions"
SELECTED = ["runtime-2", "runtime-3", "system-1"]
SEARCH_FROM, SEARCH_TO = "2024-01-24 12:00:00", "2024-01-30 06:30:00"

Query = Callable[[SparkSession, str], DataFrame]


def load_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = sw.read_events(spark, f"{sf_dir}/events.parquet")
    return sw.signals(sw.telemetry_from_events(events), error_level_only=True)


def entry(spark: SparkSession) -> DataFrame:
    """Daily errors and queue times of the last week."""
    return sw.kpi_trend(load_signals(spark, "/root/testdata/sf0.001"), AS_OF, WEEK)


def corpus_modules():
    """The modules of the corpus operators' queries and pipeline, or None without them."""
    try:
        import corpus_pipeline
        from sluicewatch.llm import queries as corpus_queries
    except ModuleNotFoundError as e:
        if e.name not in ("corpus_pipeline", "sluicewatch.llm", "sluicewatch.llm.queries"):
            raise
        return None
    return corpus_queries, corpus_pipeline


def queries() -> dict[str, Query]:
    found = report_queries()
    if modules := corpus_modules():
        corpus_queries, corpus_pipeline = modules
        found |= corpus_queries.queries() | {"pipeline": corpus_pipeline.run}
    return found


def oracle_sql() -> dict[str, str]:
    found = report_oracles()
    if modules := corpus_modules():
        corpus_queries, corpus_pipeline = modules
        found |= corpus_queries.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found


def report_queries() -> dict[str, Query]:
    def over_signals(report: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: report(load_signals(spark, sf_dir))

    reports = {
        "recent_runtimes": lambda s: sw.recent_runtimes(s, AS_OF, include_internal=True),
        "recent_runtimes_user": lambda s: sw.recent_runtimes(s, AS_OF),
        "high_error_runtimes": lambda s: sw.high_error_runtimes(s, AS_OF, WEEK * 60),
        "high_error_runtimes_30min": lambda s: sw.high_error_runtimes(s, AS_OF),
        "high_error_runtimes_any": lambda s: sw.high_error_runtimes(s, EARLIER, 30, min_errors=0),
        "stopped_processors": lambda s: sw.stopped_processors(s, AS_OF, WEEK),
        "stopped_processors_1h": lambda s: sw.stopped_processors(s, AS_OF),
        "processor_status": lambda s: sw.processor_status(s, AS_OF, WEEK),
        "kpi_trend_hour": lambda s: sw.kpi_trend(s, AS_OF, 24),
        "kpi_trend_day": lambda s: sw.kpi_trend(s, AS_OF, WEEK),
        "kpi_trend_selected": lambda s: sw.kpi_trend(s, AS_OF, 48, SELECTED),
        "top_error_runtimes": lambda s: sw.top_error_runtimes(s, AS_OF, WEEK),
        "top_error_runtimes_selected": lambda s: sw.top_error_runtimes(
            s, AS_OF, WEEK, runtimes=SELECTED
        ),
        "error_runtimes": lambda s: sw.error_runtimes(s, AS_OF, WEEK),
        "processor_errors": lambda s: sw.processor_errors(
            s, AS_OF, runtime="runtime-2", window_hours=WEEK
        ),
        "error_time_range": lambda s: sw.error_time_range(
            s, AS_OF, runtime="runtime-2", window_hours=WEEK
        ),
        "error_time_range_processor": lambda s: sw.error_time_range(
            s, AS_OF, runtime="runtime-2", processor="proc-4", window_hours=WEEK
        ),
        "search_error_logs": lambda s: sw.search_error_logs(
            s.where(within(AS_OF, timedelta(hours=WEEK))),
            runtime="runtime-2",
            term="code 1",
        ),
        "search_error_logs_history": lambda s: sw.search_error_logs(
            s, runtime="runtime-2", term="FAILURE%step _"
        ),
        "search_error_logs_5000": lambda s: sw.search_error_logs(
            s, runtime="runtime-2", limit=5000
        ),
        "board_search": lambda s: sw.HealthBoard(s, AS_OF, WEEK).search_error_logs("runtime-2"),
        "search_error_logs_range": lambda s: sw.search_error_logs(
            s,
            runtime="runtime-3",
            processor="proc-4",
            time_range=(SEARCH_FROM, SEARCH_TO),
        ),
        "backpressure": lambda s: sw.backpressure(s, AS_OF, 24),
        "backpressure_threshold": lambda s: sw.backpressure(
            s, AS_OF, WEEK, min_mib=50, runtimes=SELECTED
        ),
        "queue_times": lambda s: sw.queue_times(s, AS_OF, 24),
        "queue_times_threshold": lambda s: sw.queue_times(
            s, AS_OF, WEEK, min_minutes=60, runtimes=SELECTED
        ),
        "error_heatmap": lambda s: sw.error_heatmap(s, AS_OF, WEEK),
        "error_heatmap_runtime": lambda s: sw.error_heatmap(
            s, AS_OF, WEEK, runtime="runtime-4", runtimes=SELECTED
        ),
        "known_runtimes": sw.known_runtimes,
        "last_events": sw.last_events,
        "active_runtimes": lambda s: sw.active_runtimes(s, AS_OF),
        "runtime_status": lambda s: sw.runtime_status(s, AS_OF, 24, user_only=False),
        "runtime_status_user": lambda s: sw.runtime_status(s, AS_OF, 1),
        "runtime_status_totals": lambda s: sw.runtime_status_totals(sw.runtime_status(s, AS_OF)),
        "findings": lambda s: sw.findings(s, AS_OF, minutes=WEEK * 60, stopped_hours=WEEK),
        "findings_selected": lambda s: sw.findings(s, AS_OF, SELECTED, stopped_hours=24),
        "findings_total": lambda s: sw.findings_total(
            sw.findings(s, AS_OF, minutes=WEEK * 60, stopped_hours=WEEK)
        ),
    }
    stored = ["kpi_trend_day", "high_error_runtimes", "findings", "search_error_logs"]
    return {name: over_signals(report) for name, report in reports.items()} | {
        **{f"stored_{name}": over_stored(reports[name]) for name in stored},
        "signals": all_signals,
        "seen_by_kpi_trend": lambda spark, sf_dir: sw.kpi_trend(
            sw.seen_by(load_signals(spark, sf_dir), EARLIER), EARLIER, 24
        ),
        "instants_kpi_trend": over_telemetry(
            instants,
            lambda t: sw.kpi_trend(
                sw.signals(sw.telemetry_since(t, EARLIER, 24), error_level_only=True), EARLIER, 24
            ),
        ),
        "variant_findings": over_telemetry(
            variants,
            lambda t: sw.findings(sw.signals(t), AS_OF, minutes=WEEK * 60, stopped_hours=WEEK),
        ),
        "search_error_logs_indexed": indexed_search,
        **{
            f"{name}_rollup": over_rollup(inventory.INVENTORY, lambda t, _, r=report: r(t))
            for name, report in {
                "known_runtimes": inventory.known_runtimes,
                "last_events": inventory.last_events,
                "active_runtimes": lambda t: inventory.active_runtimes(t, AS_OF),
                "runtime_status": lambda t: inventory.runtime_status(t, AS_OF, 24, user_only=False),
                "runtime_status_totals": lambda t: sw.runtime_status_totals(
                    inventory.runtime_status(t, AS_OF)
                ),
            }.items()
        },
        "processor_status_rollup": over_rollup(
            inventory.CURRENT, lambda t, _: inventory.processor_status(t, AS_OF, WEEK)
        ),
        "stopped_processors_rollup": over_rollup(
            inventory.CURRENT, lambda t, _: inventory.stopped_processors(t, AS_OF, WEEK)
        ),
        "kpi_trend_hour_rollup": over_rollup(
            hourly.HOURLY, lambda t, s: hourly.kpi_trend(t, s, EARLIER, 24)
        ),
        "kpi_trend_day_rollup": over_rollup(
            hourly.HOURLY, lambda t, s: hourly.kpi_trend(t, s, EARLIER, WEEK, SELECTED)
        ),
        "error_heatmap_rollup": over_rollup(
            hourly.HOURLY, lambda t, s: hourly.error_heatmap(t, s, EARLIER, WEEK)
        ),
        "top_error_runtimes_rollup": over_rollup(
            hourly.HOURLY, lambda t, s: hourly.top_error_runtimes(t, s, EARLIER, WEEK)
        ),
        "stream_error_alerts": over_stream(
            alerts.PANES, lambda t: alerts.error_alerts(t, min_errors=1)
        ),
        "stream_kpi_rollup": over_stream(hourly.HOURLY, hours_of_user_runtimes),
        "stream_processor_status": over_stream(
            inventory.CURRENT, lambda t: inventory.processor_status(t, AS_OF, WEEK * 60)
        ),
        "stream_runtime_status": over_stream(
            inventory.INVENTORY, lambda t: inventory.runtime_status(t, AS_OF, 24, user_only=False)
        ),
    }


def all_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the table in the form that is stored."""
    return sw.signals(
        sw.telemetry_from_events(sw.read_events(spark, f"{sf_dir}/events.parquet"))
    )


_FOLDERS: dict[tuple[str, str, str], str] = {}


def written(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """A folder of the shared one that ``write`` has filled: once a session for each input.

    What a query stores is thereby apart from its report: only the first query over an
    input writes, and a report that is built again runs nothing.
    """
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _FOLDERS:
        folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        write(folder)
        _FOLDERS[key] = folder
    return _FOLDERS[key]


def stored_signals(spark: SparkSession, sf_dir: str) -> str:
    return written(
        spark, sf_dir, "signals", lambda path: sw.write_signals(all_signals(spark, sf_dir), path)
    )


def over_stored(report: Callable[[DataFrame], DataFrame]) -> Query:
    """Store all signals in the shared folder, and report on what is read back."""
    return lambda spark, sf_dir: report(sw.read_signals(spark, stored_signals(spark, sf_dir)))


def over_telemetry(
    change: Callable[[DataFrame], DataFrame], report: Callable[[DataFrame], DataFrame]
) -> Query:
    """Store telemetry of other types in the shared folder, and report on what is read back."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = sw.read_events(spark, f"{sf_dir}/events.parquet")
        telemetry = change(sw.telemetry_from_events(events))
        path = written(spark, sf_dir, change.__name__, lambda path: telemetry.write.parquet(path))
        return report(sw.read_telemetry(spark, path))

    return query


def instants(telemetry: DataFrame) -> DataFrame:
    """Telemetry that dates rows by instants, in UTC whatever the session's time zone."""
    seconds = "hour(timestamp) * 3600 + minute(timestamp) * 60 + extract(SECOND FROM timestamp)"
    micros = f"unix_date(date(timestamp)) * 86400000000 + bigint(({seconds}) * 1000000)"
    return telemetry.withColumn("timestamp", F.timestamp_micros(F.expr(micros)))


def variants(telemetry: DataFrame) -> DataFrame:
    """Telemetry with VARIANT values: objects, numbers, and text that is no JSON."""
    text = F.to_variant_object(F.struct("value"))
    return telemetry.withColumn(
        "value", F.coalesce(F.try_parse_json("value"), F.try_variant_get(text, "$.value", "variant"))
    )


def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search for "code 1" over stored signals, in the files that an index leaves."""
    signals = stored_signals(spark, sf_dir)
    index = written(
        spark, sf_dir, "index", lambda path: text_index.index_messages(spark, signals, path)
    )
    return text_index.search_error_logs(spark, signals, index, runtime="runtime-2", term="code 1")


def over_rollup(rollup: Rollup, report: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """Keep a roll-up of the stored signals in batches, one of them put twice, and report on it."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        sig = sw.read_signals(spark, stored_signals(spark, sf_dir))

        def write(path: str) -> None:
            table, logs = RollupTable(spark, path, rollup), F.col("record_type").eqNullSafe("LOG")
            table.put(sig.where(logs), 0)
            table.put(sig.where(~logs), 1)
            table.compact()
            table.put(sig.where(~logs), 1)

        name = "-".join(["rollup", *rollup.merges])
        path = written(spark, sf_dir, name, write)
        return report(RollupTable(spark, path, rollup).partials(), sig)

    return query


def over_stream(rollup: Rollup, report: Callable[[DataFrame], DataFrame]) -> Query:
    """Stream ``events`` into a roll-up in the shared folder, and report on it.

    The stream has a session of its own, in UTC.
    """

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        def write(folder: str) -> None:
            session = spark.newSession()
            session.conf.set(ZONE, "UTC")
            session.conf.set(PARTS, spark.conf.get(PARTS))
            events = session.readStream.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/event[s].parquet")
            sig = sw.signals(sw.telemetry_from_events(events), error_level_only=True)
            table = RollupTable(session, f"{folder}/table", rollup)
            table.stream(sig, f"{folder}/checkpoint").awaitTermination()

        folder = written(spark, sf_dir, "-".join(["stream", *rollup.merges]), write)
        return report(RollupTable(spark, f"{folder}/table", rollup).partials())

    return query


def hours_of_user_runtimes(rows: DataFrame) -> DataFrame:
    """The hourly trend over all time."""
    dated = rows.where(is_user_runtime() & F.col("event_date").isNotNull())
    merged = hourly.HOURLY.merged(dated)
    bucket = bucket_start("event_date", "event_hour").alias("time_bucket")
    return merged.select(bucket, "runtime", "total_errors", "max_queue_minutes")


TELEMETRY = """
telemetry AS (
  SELECT ts,
    CASE WHEN user_id % 20 = 0 THEN NULL
         WHEN user_id % 10 = 1 THEN 'system-' || CAST(user_id % 3 AS VARCHAR)
         ELSE 'runtime-' || CAST(user_id % 6 AS VARCHAR) END AS runtime,
    CASE WHEN event_id % 50 = 0 THEN NULL
         ELSE 'conn-' || CAST(event_id % 7 AS VARCHAR) END AS component,
    CASE WHEN event_type IN ('error', 'click') THEN 'LOG' ELSE 'METRIC' END AS record_type,
    CASE event_type WHEN 'view' THEN 'connection.queued.bytes'
                    WHEN 'purchase' THEN 'connection.queued.duration.max'
                    WHEN 'signup' THEN 'processor.run.status.running' END AS metric_name,
    CASE event_type
      WHEN 'view' THEN CAST(CAST(floor(value * 1000000) AS BIGINT) AS VARCHAR)
      WHEN 'purchase' THEN CAST(CAST(floor(value * 60000) AS BIGINT) AS VARCHAR)
      WHEN 'signup' THEN CAST(event_id % 2 AS VARCHAR)
      ELSE '{"level":"' || CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END
        || '","loggerName":"proc-' || CAST(event_id % 9 AS VARCHAR)
        || '","formattedMessage":"Failure code ' || CAST(user_id AS VARCHAR)
        || ' step ' || CAST(event_id % 13 AS VARCHAR)
        || CASE WHEN event_id % 97 = 0 THEN '' ELSE '"}' END
    END AS value
  FROM events
)"""

NUMBER = r"\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*"

SIGNALS = f"""{TELEMETRY},
sig AS (
  SELECT ts, CAST(ts AS DATE) AS event_date, CAST(hour(ts) AS INTEGER) AS event_hour,
    runtime, component, record_type, metric_name,
    CASE WHEN regexp_full_match(value, '{NUMBER}') THEN TRY_CAST(value AS DOUBLE) END AS value_num,
    json_extract_string(TRY_CAST(value AS JSON), '$.level') AS level,
    json_extract_string(TRY_CAST(value AS JSON), '$.loggerName') AS logger,
    json_extract_string(TRY_CAST(value AS JSON), '$.formattedMessage') AS message
  FROM telemetry
)"""

IS_ERROR = "record_type = 'LOG' AND level = 'ERROR'"
IN_SELECTED = "runtime IN ('runtime-2', 'runtime-3', 'system-1')"
DAY_NAME = (
    "CASE {0} WHEN 1 THEN 'Mon' WHEN 2 THEN 'Tue' WHEN 3 THEN 'Wed' WHEN 4 THEN 'Thu' "
    "WHEN 5 THEN 'Fri' WHEN 6 THEN 'Sat' WHEN 7 THEN 'Sun' END"
)


def since(hours: float, as_of: str = AS_OF) -> str:
    return f"ts > TIMESTAMP '{as_of}' - INTERVAL {int(hours * 60)} MINUTE"


def report_oracles() -> dict[str, str]:
    week = since(WEEK)

    def high_error(
        hours: float, where: str = "TRUE", least: int = 5, as_of: str = AS_OF
    ) -> str:
        return f"""SELECT runtime, count(*) AS error_count FROM sig
            WHERE {IS_ERROR} AND {since(hours, as_of)} AND {where}
            GROUP BY runtime HAVING count(*) > {least}"""

    def processors(hours: float, where: str = "TRUE") -> str:
        return f"""SELECT runtime, component AS processor, ts AS last_seen,
              coalesce(value_num = 0, FALSE) AS is_stopped
            FROM (SELECT *, row_number() OVER (
                    PARTITION BY runtime, component
                    ORDER BY ts DESC, value_num DESC NULLS LAST) AS rn
                  FROM sig WHERE metric_name = 'processor.run.status.running'
                    AND {since(hours)} AND {where}) AS samples
            WHERE rn = 1"""

    def stopped(hours: float, where: str = "TRUE") -> str:
        return f"""SELECT runtime, count(*) AS stopped_count
            FROM ({processors(hours, where)}) AS latest WHERE is_stopped GROUP BY runtime"""

    def trend(bucket: str, hours: float, where: str = "TRUE", as_of: str = AS_OF) -> str:
        return f"""SELECT CAST(date_trunc('{bucket}', ts) AS TIMESTAMP) AS time_bucket, runtime,
              count(*) FILTER (WHERE level = 'ERROR') AS total_errors,
              max(CASE WHEN metric_name = 'connection.queued.duration.max'
                       THEN value_num / 60000 ELSE 0 END) AS max_queue_minutes
            FROM sig WHERE record_type IN ('LOG', 'METRIC') AND runtime LIKE 'runtime-%'
              AND {since(hours, as_of)} AND {where}
            GROUP BY 1, 2"""

    def top_errors(where: str = "TRUE", as_of: str = AS_OF) -> str:
        return f"""SELECT runtime, count(*) AS error_count FROM sig
            WHERE {IS_ERROR} AND {since(WEEK, as_of)} AND {where}
            GROUP BY runtime ORDER BY error_count DESC, runtime ASC NULLS LAST LIMIT 10"""

    def time_range(where: str = "TRUE") -> str:
        return f"""SELECT min(ts) AS min_ts,
              CASE WHEN min(ts) = max(ts) THEN max(ts) + INTERVAL 1 SECOND ELSE max(ts) END
                AS max_ts
            FROM sig WHERE {IS_ERROR} AND {week} AND runtime = 'runtime-2' AND {where}"""

    def search(runtime: str, term: str, where: str = "TRUE", limit: int = 200) -> str:
        return f"""SELECT ts AS timestamp, logger AS processor, message FROM sig
            WHERE {IS_ERROR} AND runtime = '{runtime}' AND {where} AND message ILIKE '%{term}%'
            ORDER BY ts DESC, processor ASC NULLS LAST, message LIMIT {limit}"""

    def worst(metric: str, peak: str, name: str, hours: float, over: float, where: str) -> str:
        return f"""SELECT runtime || ' | ' || component AS runtime_connection, {peak} AS {name}
            FROM sig WHERE record_type = 'METRIC' AND metric_name = '{metric}'
              AND {since(hours)} AND {where}
            GROUP BY 1 HAVING {peak} > {over}
            ORDER BY {name} DESC, runtime_connection ASC NULLS LAST LIMIT 15"""

    def pressure(hours: float, over: float, where: str = "TRUE") -> str:
        peak = "max(value_num) / (1024 * 1024)"
        return worst("connection.queued.bytes", peak, "peak_queued_mib", hours, over, where)

    def waits(hours: float, over: float, where: str = "TRUE") -> str:
        peak, metric = "max(value_num / 60000)", "connection.queued.duration.max"
        return worst(metric, peak, "max_queue_minutes", hours, over, where)

    def heat(where: str = "TRUE", as_of: str = AS_OF) -> str:
        return f"""SELECT {DAY_NAME.format("d.day")} AS day_of_week,
              CAST(d.day AS INTEGER) AS day_index, CAST(h.hour AS INTEGER) AS hour_of_day,
              coalesce(n, 0) AS error_count
            FROM generate_series(1, 7) AS d(day) CROSS JOIN generate_series(0, 23) AS h(hour)
            LEFT JOIN (SELECT isodow(ts) AS day, hour(ts) AS hour, count(*) AS n FROM sig
                       WHERE {IS_ERROR} AND {since(WEEK, as_of)} AND {where} GROUP BY 1, 2) AS counts
              ON counts.day = d.day AND counts.hour = h.hour"""

    known = """SELECT runtime AS name, min(ts) AS created_on FROM sig
        WHERE runtime IS NOT NULL GROUP BY runtime"""
    last = """SELECT runtime AS name, max(ts) AS last_event_time FROM sig
        WHERE runtime IS NOT NULL GROUP BY runtime"""

    def active(hours: float) -> str:
        return f"SELECT DISTINCT runtime AS active_runtime_name FROM sig WHERE {since(hours)}"

    def status(hours: float, where: str = "TRUE") -> str:
        return f"""SELECT name,
              CASE WHEN name LIKE 'runtime-%' THEN 'User Created' ELSE 'Internal' END AS type,
              CASE WHEN active_runtime_name IS NULL THEN '🔴 Inactive' ELSE '🟢 Active' END
                AS status,
              active_runtime_name IS NOT NULL AS is_active, created_on, last_event_time
            FROM ({known}) AS known LEFT JOIN ({last}) AS last USING (name)
            LEFT JOIN ({active(hours)}) AS active ON active_runtime_name = name
            WHERE {where}"""

    def found(minutes: int, stopped_hours: float, where: str = "TRUE") -> str:
        return f"""SELECT 1 AS rank, runtime, 'error' AS type, '🔥' AS icon,
              'High Error Rate Detected' AS title,
              'Runtime **' || coalesce(runtime, 'None') || '** has produced **' || error_count
                || ' errors** in the last {minutes} minutes.' AS text,
              'Navigate to the **Root Cause Analysis** tab and select this runtime to investigate.'
                AS action,
              'High (Investigate Now)' AS urgency
            FROM ({high_error(minutes / 60, where)}) AS noisy
            UNION ALL
            SELECT 2, runtime, 'warning', '🛑', 'Stopped Processors Found',
              'Runtime **' || coalesce(runtime, 'None') || '** has **' || stopped_count
                || ' processor(s)** in a stopped state.',
              'Verify if this is intentional. If not, check the runtime''s flow configuration '
                || 'to restart the processor(s).',
              'Medium (Review Soon)'
            FROM ({stopped(stopped_hours, where)}) AS halted"""

    alerts = f"""SELECT start_ts AS window_start, start_ts + INTERVAL 30 MINUTE AS window_end,
          runtime, count(*) AS error_count
        FROM (SELECT runtime, time_bucket(INTERVAL 5 MINUTE, ts)
                - to_minutes(CAST(5 * steps.back AS INTEGER)) AS start_ts
              FROM sig CROSS JOIN generate_series(0, 5) AS steps(back)
              WHERE {IS_ERROR} AND ts IS NOT NULL) AS hits
        GROUP BY 1, 2, 3 HAVING count(*) > 1"""
    rollup = trend("hour", 24 * 400)
    live_status = processors(24 * 400)

    bodies = {
        "signals": "SELECT ts AS timestamp, * EXCLUDE (ts) FROM sig",
        "recent_runtimes": f"""SELECT DISTINCT runtime FROM sig
            WHERE runtime IS NOT NULL AND {since(24)}""",
        "recent_runtimes_user": f"""SELECT DISTINCT runtime FROM sig
            WHERE runtime LIKE 'runtime-%' AND {since(24)}""",
        "high_error_runtimes": high_error(WEEK),
        "high_error_runtimes_30min": high_error(0.5),
        "high_error_runtimes_any": high_error(0.5, least=0, as_of=EARLIER),
        "seen_by_kpi_trend": trend("hour", 24, f"ts <= TIMESTAMP '{EARLIER}'", EARLIER),
        "instants_kpi_trend": trend("hour", 24, as_of=EARLIER),
        "kpi_trend_hour_rollup": trend("hour", 24, as_of=EARLIER),
        "kpi_trend_day_rollup": trend("day", WEEK, IN_SELECTED, EARLIER),
        "error_heatmap_rollup": heat(as_of=EARLIER),
        "top_error_runtimes_rollup": top_errors(as_of=EARLIER),
        "stopped_processors": stopped(WEEK),
        "stopped_processors_1h": stopped(1),
        "processor_status": processors(WEEK),
        "kpi_trend_hour": trend("hour", 24),
        "kpi_trend_day": trend("day", WEEK),
        "kpi_trend_selected": trend("hour", 48, IN_SELECTED),
        "top_error_runtimes": top_errors(),
        "top_error_runtimes_selected": top_errors(IN_SELECTED),
        "error_runtimes": f"SELECT DISTINCT runtime FROM sig WHERE {IS_ERROR} AND {week}",
        "processor_errors": f"""SELECT processor, error_count,
              error_count / CAST(sum(error_count) OVER () AS BIGINT) * 100 AS pct_of_total
            FROM (SELECT logger AS processor, count(*) AS error_count FROM sig
                  WHERE {IS_ERROR} AND {week} AND runtime = 'runtime-2' GROUP BY logger
                  ORDER BY error_count DESC, processor ASC NULLS LAST LIMIT 10) AS listed""",
        "error_time_range": time_range(),
        "error_time_range_processor": time_range("logger = 'proc-4'"),
        "search_error_logs": search("runtime-2", "code 1", week),
        "search_error_logs_history": search("runtime-2", "FAILURE%step _"),
        "search_error_logs_5000": search("runtime-2", "", limit=5000),
        "board_search": search("runtime-2", "", week),
        "search_error_logs_range": search(
            "runtime-3",
            "",
            f"""logger = 'proc-4'
            AND ts BETWEEN TIMESTAMP '{SEARCH_FROM}' AND TIMESTAMP '{SEARCH_TO}'""",
        ),
        "backpressure": pressure(24, 0),
        "backpressure_threshold": pressure(WEEK, 50, IN_SELECTED),
        "queue_times": waits(24, 0),
        "queue_times_threshold": waits(WEEK, 60, IN_SELECTED),
        "error_heatmap": heat(),
        "error_heatmap_runtime": heat("runtime = 'runtime-4'"),
        "known_runtimes": known,
        "last_events": last,
        "active_runtimes": active(24),
        "runtime_status": status(24),
        "runtime_status_user": status(1, "name LIKE 'runtime-%'"),
        "runtime_status_totals": f"""SELECT count(*) AS total_runtimes,
              count(*) FILTER (WHERE is_active) AS active_runtimes,
              count(*) FILTER (WHERE NOT is_active) AS inactive_runtimes
            FROM ({status(24, "name LIKE 'runtime-%'")}) AS displayed""",
        "findings": found(WEEK * 60, WEEK),
        "findings_selected": found(30, 24, IN_SELECTED),
        "findings_total": f"SELECT count(*) AS findings FROM ({found(WEEK * 60, WEEK)}) AS f",
        "stream_error_alerts": alerts,
        "stream_kpi_rollup": rollup,
        "stream_processor_status": live_status,
    }
    for name in ("kpi_trend_day", "high_error_runtimes", "findings", "search_error_logs"):
        bodies[f"stored_{name}"] = bodies[name]
    for name in ("known_runtimes", "last_events", "active_runtimes", "runtime_status", "runtime_status_totals"):
        bodies[f"{name}_rollup"] = bodies[name]
    for name in ("processor_status", "stopped_processors"):
        bodies[f"{name}_rollup"] = bodies[name]
    bodies["stream_runtime_status"] = bodies["runtime_status"]
    bodies["variant_findings"] = bodies["findings"]
    bodies["search_error_logs_indexed"] = search("runtime-2", "code 1")
    return {name: f"WITH {SIGNALS}\n{body}" for name, body in bodies.items()}
