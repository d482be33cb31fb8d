"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicewatch.plans.shared import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name of its own for each call: reruns and retries never mix."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back.

    Cuts lineage like a checkpoint, in columns, and survives lost executors.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


#: Size up to which a counted side of a join is broadcast.
BROADCAST_BYTES = 16 << 20


def counted(side: DataFrame, row_bytes: int) -> DataFrame:
    """A side of a join, to be broadcast if its rows are few enough, and else shuffled."""
    return F.broadcast(side) if side.count() * row_bytes <= BROADCAST_BYTES else side
