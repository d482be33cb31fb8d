"""An index of error messages that lets a search skip files.

For every file of stored signals the index lists the trigrams of its error messages, three
characters each, lower-cased as the search does it. A message can only match a term if it
has all trigrams of the term's literal parts, so that files without one of them hold no
match; the files that are left are searched as ever. Files that the index does not know
yet are always searched. What a search finds never depends on the index.

Trigrams are stored in folders by hash and sorted, so that a lookup reads a few row groups
of a few folders, not the list of every file.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicewatch.functions.predicates import is_error, search_pattern
from sluicewatch.operators import errors
from sluicewatch.rollups.files import DONE, Folder
from sluicewatch.sources.signals import SIGNALS_SCHEMA, read_signals

GRAM = 3
#: Folders of the index, by hash of the trigram.
PARTS = 64
#: Files that one pass indexes, and whose trigrams one task sorts.
PASS_FILES, TASK_FILES = 10_000, 1_000
#: Paths of files that a search takes from the index; a term in more files is no use to it.
MOST_FILES = 10_000


def grams(lowered: Column) -> Column:
    """Trigrams of lower-cased text; none of shorter text."""
    letters = F.split(lowered, "")
    places = F.sequence(F.lit(1), F.size(letters) - (GRAM - 1))
    three = F.transform(places, lambda i: F.concat(*(F.get(letters, i - 1 + k) for k in range(GRAM))))
    return F.array_distinct(F.when(F.size(letters) >= GRAM, three).otherwise(F.array().cast("array<string>")))


def index_messages(spark: SparkSession, signals_path: str, index_path: str) -> int:
    """Index the files that are not indexed yet; how many these were.

    Files count as indexed once all their trigrams are stored. What a failed run has
    stored of others is stored again by the next one, which does no harm.
    """
    files = _files(spark, signals_path)
    new = sorted(files.keys() - _indexed(spark, index_path))
    name = F.regexp_extract(F.col("_metadata.file_path"), f"^.*{re.escape(_root(signals_path))}(.*)$", 1)
    for start in range(0, len(new), PASS_FILES):
        some = new[start : start + PASS_FILES]
        sig = _signals_of(spark, signals_path, [files[f] for f in some])
        known = F.broadcast(spark.createDataFrame([(f,) for f in some], "file string"))
        seen = sig.select(name.alias("file")).distinct().join(known, "file", "left_anti").first()
        if seen is not None:
            raise ValueError(f"a file calls itself {seen.file!r}, which is not how the listing calls it")
        logged = sig.where(is_error() & F.col("message").isNotNull())
        found = (
            logged.select(name.alias("file"), F.explode(grams(F.lower("message"))).alias("gram"))
            .distinct()
            .withColumn("part", _part())
        )
        share = F.pmod(F.xxhash64("file"), F.lit(-(-len(some) // TASK_FILES)))
        placed = found.repartition("part", share).sortWithinPartitions("part", "gram", "file")
        placed.write.mode("append").partitionBy("part").parquet(f"{index_path}/grams")
        done = spark.createDataFrame([(f,) for f in some], "file string")
        done.coalesce(1).write.mode("append").parquet(f"{index_path}/files")
    return len(new)


def candidate_files(spark: SparkSession, signals_path: str, index_path: str, term: str) -> list[str] | None:
    """Files that may hold messages with ``term``; None if that may be all of them.

    Wildcards cut the term into parts, of which those shorter than a trigram tell nothing.
    """
    index = Folder(spark, index_path)
    if not index.has("files", DONE) or not index.has("grams", DONE):
        return None
    # Lower-cased as a whole, as the search does it, then cut at wildcards.
    pattern = F.replace(F.lower(F.lit(search_pattern(term))), F.lit("\\\\"), F.lit("\\"))
    literal = F.flatten(F.transform(F.split(pattern, "[%_]"), grams))
    asked = spark.range(0, 1, 1, 1).select(F.explode(F.array_distinct(literal)).alias("gram"))
    rows = asked.select("gram", _part().alias("part")).collect()
    wanted, folders = [r.gram for r in rows], sorted({r.part for r in rows})
    if not wanted:
        return None
    stored = spark.read.schema("file string, gram string, part int").parquet(f"{index_path}/grams")
    holding = (
        stored.where(F.col("part").isin(folders) & F.col("gram").isin(wanted))
        .groupBy("file")
        .agg(F.count_distinct("gram").alias("n"))
        .where(F.col("n") == len(wanted))
    )
    found = [r.file for r in holding.limit(MOST_FILES + 1).collect()]
    if len(found) > MOST_FILES:
        return None
    files = _files(spark, signals_path)
    names = (files.keys() & set(found)) | (files.keys() - _indexed(spark, index_path))
    return sorted(files[name] for name in names)


def search_error_logs(
    spark: SparkSession, signals_path: str, index_path: str, *, runtime: str, term: str = "", **more: Any
) -> DataFrame:
    """As :func:`sluicewatch.search_error_logs` over the signals stored in ``signals_path``.

    Looking the term up runs when this is called; the search itself is lazy.
    """
    files = candidate_files(spark, signals_path, index_path, term)
    sig = read_signals(spark, signals_path) if files is None else _signals_of(spark, signals_path, files)
    return errors.search_error_logs(sig, runtime=runtime, term=term, **more)


def _signals_of(spark: SparkSession, signals_path: str, files: list[str]) -> DataFrame:
    if not files:
        return spark.createDataFrame([], SIGNALS_SCHEMA)
    return spark.read.schema(SIGNALS_SCHEMA).option("basePath", signals_path).parquet(*files)


def _part() -> Column:
    return F.pmod(F.xxhash64("gram"), F.lit(PARTS)).cast("int")


def _root(signals_path: str) -> str:
    return f"/{signals_path.rstrip('/').rsplit('/', 1)[-1]}/"


def _files(spark: SparkSession, signals_path: str) -> dict[str, str]:
    """Paths of the stored files, by their names below the table's folder."""
    paths = spark.read.schema(SIGNALS_SCHEMA).parquet(signals_path).inputFiles()
    return {path.rsplit(_root(signals_path), 1)[1]: path for path in paths}


def _indexed(spark: SparkSession, index_path: str) -> set[str]:
    """Names of files, as many as the scan of all files lists on the driver too."""
    if not Folder(spark, index_path).has("files", DONE):
        return set()
    return {r.file for r in spark.read.schema("file string").parquet(f"{index_path}/files").collect()}
