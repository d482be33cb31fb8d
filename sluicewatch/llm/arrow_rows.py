"""Rows with results computed in Arrow batches, without a shuffle or a join back."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

CHUNK_BYTES = 4 << 20

#: From texts as bytes, None for null, to one Arrow array per result field.
Compute = Callable[[list], list[pa.Array]]


def slices(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text; a row is never split."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def apart(columns: Iterable[str], taken: Iterable[str]) -> list[str]:
    """The columns that are not named like one of those taken, as Spark compares names."""
    lower = {name.lower() for name in taken}
    return [c for c in columns if c.lower() not in lower]


def texts_of(column: pa.Array) -> list:
    return column.cast(pa.binary()).to_pylist()


def with_results(
    df: DataFrame,
    text: str,
    fields: StructType,
    make: Callable[[], Compute],
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``df`` with result columns made of the text column, batch by batch.

    ``make`` runs once per task, on the executor. Memory is bounded by a batch and
    by ``chunk_bytes`` of text, or the longest text.
    """
    others = {*apart(df.columns, [*fields.names, text]), text}
    kept = [c for c in df.columns if c in others]
    source = df.select(*(f"`{c}`" for c in kept))
    names = [f"c{i}" for i in range(len(kept))]
    made = [f"r{i}" for i in range(len(fields))]
    at = kept.index(text)
    renamed = source.toDF(*names)
    schema = StructType(list(renamed.schema))
    for name, field in zip(made, fields):
        schema = schema.add(name, field.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in slices(batch, at, chunk_bytes):
                results = compute(texts_of(part.column(at)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *results], names=[*names, *made]
                )

    out = renamed.mapInArrow(run, schema)
    back = [out[n].alias(c) for n, c in zip(names, kept) if apart([c], fields.names)]
    return out.select(*back, *(out[n].alias(f.name) for n, f in zip(made, fields)))
