"""A bounded sample of labelled texts to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % divisor


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    usable: Column,
    per_class: int,
    id: str = "doc_id",
    text: str = "text",
) -> tuple[DataFrame, float | None]:
    """(``y``, ``text``) of about ``per_class`` usable labelled rows of each class; the
    share of label 1 among all usable labels, None if there are none.

    Chosen by hash of the id, so that only narrow labels are looked at to choose, and
    the chosen ids, whose number does not grow with the data, are broadcast. An id
    labelled twice has the greater label; null labels, ids and texts are left out; of
    several texts of one id the least counts.
    """
    known = (
        labels.where(usable & F.col(id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(id).alias("i"))
        .agg((F.max(label) > 0).cast("int").alias("y"))
    )
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(1.0)
    for value, n in sizes.items():
        rate = F.when(F.col("y") == value, F.lit(min(1.0, per_class / n))).otherwise(rate)
    draw = F.pmod(F.xxhash64("i"), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.broadcast(known.where(draw < rate))
    rows = docs.select(F.col(id).alias("i"), F.col(text).cast("string").alias("text"))
    rows = rows.where(F.col("text").isNotNull()).join(chosen, "i")
    sample = rows.groupBy("i").agg(F.first("y").alias("y"), F.min("text").alias("text"))
    total = sum(sizes.values())
    return sample, sizes.get(1, 0) / total if total else None
