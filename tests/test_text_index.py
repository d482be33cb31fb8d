"""The search with an index finds what the search without one finds, in fewer files."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import sluicewatch as sw
from sluicewatch.sources import text_index
from tests.conftest import ago, bag, log, row

MESSAGES = [
    "Connection timeout after 30 s", "connection TIMEOUT\\retry", "disk 100% full", "disk_full", "ΟΔΟΣ closed",
    "İstanbul down", "emoji 😀😀 failure", "a\\b", "", "ab", None, "ﬁne ligature", "straße GROSS",
]
TERMS = [
    "timeout", "TIMEOUT", "Time%30", "out_after", "zzz", "", "%", "_", "ab", "a", "a\\b", "\\retry", "100%", "100\\%",
    "ΟΔΟΣ", "οδος", "οδοσ", "i̇st", "İST", "😀😀", "😀 f", "STRASSE", "straße", "disk_full", "o%out%ret", "nowhere at all", "'", "x'%",
]


@pytest.fixture(scope="module")
def stored(spark, telemetry, tmp_path_factory):
    """A file for each message, with a few other rows in it."""
    folder = str(tmp_path_factory.mktemp("indexed") / "signals")
    for i, message in enumerate(MESSAGES):
        rows = [log(ago(hours=i), "runtime-a", message=message), log(ago(hours=i), "runtime-a", "INFO", message="nowhere at all")]
        rows += [row(ago(hours=i), metric="m", value="1"), log(ago(hours=i), "runtime-b", message=f"only here {i}")]
        sw.write_signals(sw.signals(telemetry(rows)), folder)
    return folder


@pytest.fixture(scope="module")
def index(spark, stored, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "grams")
    assert text_index.index_messages(spark, stored, path) == len(MESSAGES)
    return path


@pytest.mark.parametrize("term", TERMS)
def test_finds_the_same(spark, stored, index, term):
    found = text_index.search_error_logs(spark, stored, index, runtime="runtime-a", term=term)
    assert bag(found) == bag(sw.search_error_logs(sw.read_signals(spark, stored), runtime="runtime-a", term=term))


def test_only_candidate_files_are_read(spark, stored, index):
    for term, files in (("timeout", 2), ("connection%after", 1), ("only here 7", 1), ("ONLY here 1", 4), ("nowhere at all", 0)):
        found = text_index.candidate_files(spark, stored, index, term)
        assert len(found) == files, term
        search = text_index.search_error_logs(spark, stored, index, runtime="runtime-b", term=term)
        assert sorted(search.inputFiles()) == sorted(found)


@pytest.mark.parametrize("term", ["", "ab", "a%b_c", "%%"])
def test_terms_without_trigrams_read_all(spark, stored, index, term):
    assert text_index.candidate_files(spark, stored, index, term) is None


def test_terms_in_too_many_files_read_all(spark, stored, index, monkeypatch):
    monkeypatch.setattr(text_index, "MOST_FILES", 3)
    assert text_index.candidate_files(spark, stored, index, "only here") is None
    assert len(text_index.candidate_files(spark, stored, index, "timeout")) == 2


def test_new_files_are_searched_and_then_indexed(spark, telemetry, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "PASS_FILES", 2)
    signals, index = f"{tmp_path}/signals", f"{tmp_path}/index"
    def add(hours, message):
        sw.write_signals(sw.signals(telemetry([log(ago(hours=h), message=message) for h in hours])), signals)
    def search():
        return text_index.search_error_logs(spark, signals, index, runtime="runtime-a", term="needle")
    add(range(5), "hay")
    assert text_index.candidate_files(spark, signals, index, "needle") is None
    assert text_index.index_messages(spark, signals, index) == 5
    assert search().count() == 0 and search().inputFiles() == []
    add([2], "a NEEDLE here")
    assert search().count() == 1 and len(search().inputFiles()) == 1
    assert text_index.index_messages(spark, signals, index) == 1
    assert text_index.index_messages(spark, signals, index) == 0
    add([9], "hay")
    assert search().count() == 1 and len(search().inputFiles()) == 2
    spark.createDataFrame([("gone.parquet", "nee", 0)], "file string, gram string, part int").write.mode("append").partitionBy("part").parquet(f"{index}/grams")
    assert search().count() == 1


def test_a_lookup_reads_few_folders(spark, stored, index):
    """Index rows are pruned by folder and skipped by row group."""
    grams = spark.read.schema("file string, gram string, part int").parquet(f"{index}/grams")
    text = grams.where(F.col("part").isin(3) & F.col("gram").isin("out"))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*part#\d+ = 3", text) and "EqualTo(gram,out)" in text
