"""Signals: the flat, typed form of telemetry that every operator reads.

Telemetry keeps its facts in maps, nested objects and JSON text, none of which
Parquet can prune or filter. Signals pulls them out once, so that a stored
signals table gives each query narrow columns, date and hour partitions and
row-group statistics instead.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicewatch.functions.timewin import AsOf, not_after
from sluicewatch.functions.vocabulary import COMPONENT_KEY, ERROR, RUNTIME_KEY

SIGNALS_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("event_hour", T.IntegerType()),
        T.StructField("runtime", T.StringType()),
        T.StructField("component", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("metric_name", T.StringType()),
        T.StructField("value_num", T.DoubleType()),
        T.StructField("level", T.StringType()),
        T.StructField("logger", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)

PARTITIONS = ("event_date", "event_hour")

#: Rows that a file of stored signals has at most, and a task that writes them about.
ROWS_PER_FILE = 1_000_000
#: Partitions whose row counts place rows; with more of them rows go by hash alone.
COUNTED_PARTITIONS = 100_000
#: Metadata of a ``level`` column that knows errors only.
ERRORS_ONLY = "errors_only"

#: The fields of a log record.
_RECORD = "struct<level: string, loggerName: string, formattedMessage: string>"

#: A plain decimal. Casts also take suffixes, hexadecimal, NaN and Infinity.
NUMBER = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"


def signals(telemetry: DataFrame, *, error_level_only: bool = False) -> DataFrame:
    """Flatten telemetry; works on batch and streaming frames alike.

    Attributes may be maps, structs, VARIANT or JSON text. A value is either a
    JSON object (log records) or a number (metric samples), and no number holds
    a brace: looking for one decides which of the two parsers a row needs, and
    spares numbers the JSON parser and log text a failing numeric cast.

    ``error_level_only`` leaves ``level`` NULL where it cannot be ERROR, found out
    by looking for the word in the text, so that error reports straight from
    telemetry parse next to no JSON where errors are rare. No report tells the
    difference, since none tests another level; store signals without it.
    """
    schema = telemetry.schema
    timestamp = _utc_wall_clock(F.col("timestamp"), schema["timestamp"].dataType)
    if isinstance(schema["value"].dataType, T.VariantType):
        telemetry = _with_variant_record(telemetry, error_level_only)
        text, record = F.col(_TEXT), F.col(_RECORD_OF_VARIANT)
        level, logger, message = (record.getField(f) for f in ("level", "loggerName", "formattedMessage"))
    else:
        text = F.col("value").cast("string")
        is_object = F.contains(text, F.lit("{"))
        if error_level_only:
            record = F.try_parse_json(text)
            level = F.when(_may_say(text, ERROR), F.try_variant_get(record, "$.level", "string"))
        else:
            record = F.when(is_object, F.try_parse_json(text))
            level = F.try_variant_get(record, "$.level", "string")
        logger, message = (F.try_variant_get(record, f"$.{f}", "string") for f in ("loggerName", "formattedMessage"))
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))

    def attribute(column: str, *path: str) -> Column:
        return _text_at(F.col(column), schema[column].dataType, *path)

    return telemetry.select(
        timestamp.alias("timestamp"),
        timestamp.cast("date").alias("event_date"),
        F.hour(timestamp).alias("event_hour"),
        attribute("resource_attributes", RUNTIME_KEY).alias("runtime"),
        attribute("record_attributes", COMPONENT_KEY).alias("component"),
        F.col("record_type"),
        attribute("record", "metric", "name").alias("metric_name"),
        number.alias("value_num"),
        level.alias("level", metadata={ERRORS_ONLY: True}) if error_level_only else level.alias("level"),
        logger.alias("logger"),
        message.alias("message"),
    )


_DIRECT, _TEXT, _RECORD_OF_VARIANT = "__direct", "__text", "__record"


def _with_variant_record(telemetry: DataFrame, error_level_only: bool) -> DataFrame:
    """Telemetry with the record of its VARIANT value, and the text of values without one.

    The fields of an object are taken out at once, from shredded columns where it is stored
    so. Only strings are parsed, once each: steps of their own keep Spark from copying a
    step into all of its uses.
    """
    direct = telemetry.withColumn(_DIRECT, F.try_variant_get("value", "$", _RECORD))
    plain = F.when(F.col(_DIRECT).isNull(), F.try_variant_get("value", "$", "string"))
    texts = direct.withColumn(_TEXT, plain)
    may_hold = F.contains(_TEXT, F.lit("{"))
    if error_level_only:
        may_hold &= _may_say(F.col(_TEXT), ERROR)
    parsed = F.when(may_hold, F.try_variant_get(F.try_parse_json(_TEXT), "$", _RECORD))
    return texts.withColumn(_RECORD_OF_VARIANT, F.coalesce(_DIRECT, parsed))


def seen_by(sig: DataFrame, moment: AsOf) -> DataFrame:
    """Signals up to ``moment``, to report on a past time as it looked then.

    Reports bound their windows below only, so without this, events later than
    ``as_of`` count.
    """
    return sig.where(not_after(moment))


def write_signals(
    sig: DataFrame,
    path: str,
    *,
    mode: str = "append",
    compact: bool | None = None,
    partition_by: Sequence[str] = PARTITIONS,
    rows_per_file: int = ROWS_PER_FILE,
) -> None:
    """Store signals as Parquet, one folder per date and hour.

    Reports on the last half hour or hour then read one or two hours, however
    large a day is. Where a day is small, ``partition_by=["event_date"]`` makes
    fewer files. Rows are clustered inside each file by what the reports filter
    on, so that row-group statistics skip the rest.

    Rows are counted first, by date and hour, and then placed: hours in order, one after
    the other, nearly ``rows_per_file`` to a task. A hot hour is spread over as many tasks
    as it needs, small ones share a task, and an hour has two files more than it fills at
    most, whatever order the input is in and without any help from adaptive execution.

    ``compact=False`` shuffles and counts nothing: tasks write what they read, which suits
    input in arrival order, where a task sees few hours. ``compact=True`` leaves the
    placement to adaptive execution. No file gets more than ``rows_per_file`` rows.
    ``mode="overwrite"`` replaces only the partitions present in ``sig``.
    """
    if sig.schema["level"].metadata.get(ERRORS_ONLY):
        raise ValueError("these signals know no level but ERROR; make them without error_level_only")
    if compact is None:
        sig = _placed(sig, partition_by, rows_per_file)
    elif compact:
        sig = sig.hint("rebalance", *partition_by)
    (
        sig.sortWithinPartitions(
            *partition_by, "record_type", "level", "metric_name", "runtime", "timestamp"
        )
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*partition_by)
        .parquet(path)
    )


def _placed(sig: DataFrame, partition_by: Sequence[str], rows_per_file: int) -> DataFrame:
    """Signals in tasks of nearly ``rows_per_file`` rows, each of neighbouring partitions.

    A row's place among those of its partition comes from a hash of its values, so that a
    task that is run again places its rows alike. Tasks are filled to four standard
    deviations below a file, for chance not to spill a few rows into another one.
    """
    per_task = max(1, int(rows_per_file - 4 * math.sqrt(rows_per_file)))
    own = F.xxhash64(*sig.columns)
    counts = sig.groupBy(*partition_by).agg(F.count("*").alias("__rows"))
    counted = counts.limit(COUNTED_PARTITIONS + 1).orderBy(*partition_by).collect()
    if len(counted) > COUNTED_PARTITIONS:
        return sig.repartition(*partition_by, F.pmod(own, F.lit(COUNTED_PARTITIONS)))
    before, rows = 0, []
    for r in counted:
        rows.append((*r, before))
        before += r["__rows"]
    tasks = before // per_task + 1
    if tasks == 1:
        return sig.repartition(1)
    schema = T.StructType([*counts.schema, T.StructField("__before", T.LongType())])
    # As many rows as partitions, at most COUNTED_PARTITIONS.
    places = F.broadcast(sig.sparkSession.createDataFrame(rows, schema)).alias("p")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"p.{c}")) for c in partition_by]
    names = sig.columns
    joined = sig.withColumn("__hash", own).alias("s").join(places, same)
    task = F.floor((F.col("__before") + F.pmod(F.col("__hash"), F.col("__rows"))) / per_task)
    placed = joined.select(*(F.col(f"s.{c}") for c in names), task.cast("int").alias("__task"))
    return placed.repartitionById(tasks, F.col("__task")).select(*names)


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """Signals stored by :func:`write_signals`."""
    names = SIGNALS_SCHEMA.fieldNames()
    return spark.read.schema(SIGNALS_SCHEMA).parquet(path).select(*names)


def _may_say(json_text: Column, word: str) -> Column:
    """False only if no string of the JSON text can be ``word``.

    JSON spells a letter as itself or as a ``\\u`` escape, so text without
    either the word or such an escape does not contain it.
    """
    return F.contains(json_text, F.lit(word)) | F.contains(json_text, F.lit("\\u"))


def _text_at(value: Column, kind: T.DataType, *path: str) -> Column:
    """The string under ``path``, whichever semi-structured type holds it."""
    for depth, key in enumerate(path):
        if isinstance(kind, T.MapType):
            value, kind = value.getItem(key), kind.valueType
        elif isinstance(kind, T.StructType):
            value, kind = value.getField(key), kind[key].dataType
        else:
            tree = value if isinstance(kind, T.VariantType) else F.try_parse_json(value)
            steps = "".join(f"['{step}']" for step in path[depth:])
            return F.try_variant_get(tree, "$" + steps, "string")
    if isinstance(kind, T.VariantType):
        return F.try_variant_get(value, "$", "string")
    return value.cast("string")


def _utc_wall_clock(moment: Column, kind: T.DataType) -> Column:
    if not isinstance(kind, T.TimestampType):
        return moment.cast("timestamp_ntz")
    seconds = F.unix_micros(moment).cast("decimal(18,0)") / F.lit(1000000)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
