"""Top-k plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """First ``k`` rows of an aggregated frame, in order."""
    return df.orderBy(*order).limit(k)


def top_k_of_scan(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """First ``k`` rows of a frame with as many partitions as a large scan has.

    ``ORDER BY … LIMIT`` alone sends ``k`` rows of every scan task to one task,
    or to the driver when the result is collected: 200 rows from each of 800,000
    tasks are 160 million. Here each scan task keeps its own first ``k`` and
    sends them to one of as many tasks as a shuffle has, which do the same, so that
    the last step meets at most ``k`` rows of each of these. A scan task sends to a
    single group, whatever its rows are, so no key can make a group hot. The plan
    is the same for every ``k``.
    """
    group = "__merge_group"
    groups = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = _first_of_each_partition(df, k, order).withColumn(
        group, F.pmod(F.spark_partition_id(), F.lit(groups))
    )
    merged = kept.repartition(groups, group).drop(group)
    return top_k(_first_of_each_partition(merged, k, order), k, *order)


def _first_of_each_partition(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    place = "__place"
    within_partition = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = df.sortWithinPartitions(*order).withColumn(place, within_partition)
    return numbered.where(F.col(place) < k).drop(place)
