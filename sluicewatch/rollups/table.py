"""Tables of mergeable partial rows, kept by batches and streams, merged as they grow.

Every batch writes the partial rows of its signals into a folder of its own, and a batch
that is written again replaces them, so that repeating one after a failure changes
nothing. :meth:`RollupTable.compact` merges finished batches into *runs*, and as many
runs of one level as ``FAN`` into one of the next, so that a row is merged again only as
often as the logarithm of the number of batches. A manifest names the runs and the
batches that are in them; each generation of it is a new file that appears at once.
Readers follow the latest manifest: its runs, and the batches it does not cover. What
they read goes only after later generations, so writers, mergers and readers don't wait
for each other.

    tables/<path>/batches/<writer>/<number>/   partial rows of one batch
    tables/<path>/runs/<level>-<id>/           merged rows of many batches
    tables/<path>/manifests/<generation>.json  which of them make up the table
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sluicewatch.rollups.files import DONE, Folder

#: Runs of one level that become one of the next.
FAN = 8
_MERGES = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Rollup:
    """What a table holds: partial rows of signals, and how rows of equal keys merge.

    ``merges`` names the columns beside the keys, each with "sum", "min" or "max".
    """

    partials: Callable[[DataFrame], DataFrame]
    schema: StructType
    merges: dict[str, str]

    @property
    def keys(self) -> list[str]:
        return [name for name in self.schema.names if name not in self.merges]

    def merged(self, rows: DataFrame, *keys: Column | str) -> DataFrame:
        """One row for each key: by default for all keys of the table."""
        return rows.groupBy(*(keys or self.keys)).agg(
            *(_MERGES[how](name).alias(name) for name, how in self.merges.items())
        )


@dataclass(frozen=True)
class _Manifest:
    generation: int
    runs: list[str]
    #: By writer, the numbers of covered batches as [first, last] ranges in order.
    covered: dict[str, list[list[int]]]

    def covers(self, writer: str, number: int) -> bool:
        return any(first <= number <= last for first, last in self.covered.get(writer, ()))

    def with_batches(self, batches: Iterable[tuple[str, int]]) -> dict[str, list[list[int]]]:
        covered = {writer: [list(r) for r in ranges] for writer, ranges in self.covered.items()}
        for writer, number in batches:
            covered.setdefault(writer, []).append([number, number])
        for writer, ranges in covered.items():
            joined: list[list[int]] = []
            for first, last in sorted(ranges):
                if joined and first <= joined[-1][1] + 1:
                    joined[-1][1] = max(joined[-1][1], last)
                else:
                    joined.append([first, last])
            covered[writer] = joined
        return covered


class RollupTable:
    """A stored rollup. All of its folders have to be shared by all executors.

    Any number of writers may add batches at any time, each under a name of its own; one
    merger at a time (a second one fails and changes nothing).
    """

    def __init__(self, spark: SparkSession, path: str, rollup: Rollup):
        self.spark, self.rollup = spark, rollup
        self.folder = Folder(spark, path)

    def put(self, sig: DataFrame, number: int, writer: str = "batch") -> None:
        """Add the partial rows of a batch of signals.

        The same batch put again replaces its rows until it has been merged, and changes
        nothing afterwards: number a batch by what it holds, such as its hour. Batches
        that differ need different numbers.
        """
        rows = self.rollup.partials(sig).select(*self.rollup.schema.names)
        rows.write.mode("overwrite").parquet(self.folder.of("batches", writer, number))

    def stream(
        self,
        sig: DataFrame,
        checkpoint: str,
        continuous: str | None = None,
        writer: str = "stream",
        merge_every: int = 50,
    ) -> StreamingQuery:
        """Add every batch of a stream of signals, and merge whenever ``merge_every`` are there.

        The stream has no state and no watermark: a row dated in the future closes no
        window, and rows of any age count. All that is available, then stop; or every
        ``continuous``, such as "1 minute".
        """

        def add(batch: DataFrame, number: int) -> None:
            self.put(batch, number, writer)
            self.compact(merge_every)

        trigger = {"processingTime": continuous} if continuous else {"availableNow": True}
        return sig.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def partials(self) -> DataFrame:
        """Rows that still have to be merged: several of a key, as reports merge them anyway."""
        manifest = self._manifest()
        paths = [self.folder.of("runs", run) for run in manifest.runs]
        paths += [self.folder.of("batches", *batch) for batch in self._open_batches(manifest)]
        return self._rows(paths)

    def rows(self) -> DataFrame:
        """The table: one row for each key."""
        return self.rollup.merged(self.partials()).select(*self.rollup.schema.names)

    def compact(self, least: int = 1) -> bool:
        """Merge finished batches if there are ``least`` of them; whether it did.

        Old folders go as soon as no manifest but older ones than the last names them.
        """
        manifest = self._manifest()
        batches = self._open_batches(manifest)
        if len(batches) < max(1, least):
            return False
        merged, level = [], 0
        while len(same := [r for r in manifest.runs if int(r.split("-")[0]) == level]) >= FAN - 1:
            merged += same
            level += 1
        run = f"{level}-{uuid.uuid4().hex}"
        paths = [self.folder.of("runs", r) for r in merged] + [self.folder.of("batches", *b) for b in batches]
        rows = self.rollup.merged(self._rows(paths)).select(*self.rollup.schema.names)
        rows.sortWithinPartitions(*self.rollup.keys).write.parquet(self.folder.of("runs", run))
        self._publish(
            _Manifest(
                manifest.generation + 1,
                [r for r in manifest.runs if r not in merged] + [run],
                manifest.with_batches(batches),
            )
        )
        self.clean(before=manifest)
        return True

    def clean(self, before: _Manifest | None = None) -> None:
        """Remove what only manifests older than ``before`` (the latest) need."""
        oldest = before or self._manifest()
        if not oldest.generation:
            return
        named = {r for g in self._generations() if g >= oldest.generation for r in self._load(g).runs}
        for run in self.folder.names("runs"):
            # A run that no manifest names may be one that is being written.
            if run not in named and any(run in self._load(g).runs for g in self._generations() if g < oldest.generation):
                self.folder.remove("runs", run)
        for writer, number in self._finished():
            if oldest.covers(writer, number):
                self.folder.remove("batches", writer, number)
        for generation in self._generations():
            if generation < oldest.generation:
                self.folder.remove("manifests", _name(generation))

    def _rows(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.rollup.schema)
        return self.spark.read.schema(self.rollup.schema).parquet(*paths)

    def _finished(self) -> list[tuple[str, int]]:
        return [
            (writer, int(number))
            for writer in self.folder.names("batches")
            for number in self.folder.names("batches", writer)
            if self.folder.has("batches", writer, number, DONE)
        ]

    def _open_batches(self, manifest: _Manifest) -> list[tuple[str, int]]:
        return [batch for batch in self._finished() if not manifest.covers(*batch)]

    def _generations(self) -> list[int]:
        names = self.folder.names("manifests")
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _manifest(self) -> _Manifest:
        generations = self._generations()
        return self._load(generations[-1]) if generations else _Manifest(0, [], {})

    def _load(self, generation: int) -> _Manifest:
        return _Manifest(**json.loads(self.folder.read("manifests", _name(generation))))

    def _publish(self, manifest: _Manifest) -> None:
        self.folder.publish(json.dumps(manifest.__dict__), "manifests", _name(manifest.generation))


def _name(generation: int) -> str:
    return f"{generation:012d}.json"
