"""Chat formatting by columnar byte assembly.

Turn lengths give cumulative offsets, offsets give scatter indices, and headers,
texts and ends are copied into one preallocated buffer that becomes the Arrow column:
no string is built per turn. Turns look like ``### role: text</turn>`` and a line end.
Inside roles and texts a backslash goes before every backslash, ``#``, ``<`` and (in
roles) ``:``, so no text can look like a mark, and reading takes the first backslash
of each pair away again. Long conversations are several rows, cut between turns, so that
neither a task nor a value has to hold one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicewatch.llm.arrow_rows import CHUNK_BYTES, slices

HEAD, AFTER_ROLE, END = b"### ", b": ", b"</turn>\n"
LOSS_ROLE = "assistant"
#: Bytes of turns from which a conversation goes on in another row.
BLOCK_BYTES = 16 << 20

_TURN = re.compile(rb"### ((?:\\.|[^\\:#<])*): ((?:\\.|[^\\#<])*)</turn>\n", re.S)
_ESCAPED = re.compile(rb"\\(.)", re.S)


def _escaped(column: pa.Array, marks: str) -> pa.Array:
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    for mark in ("\\", *marks):
        column = pc.replace_substring(column, mark, "\\" + mark)
    return column


def _unescaped(data: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", data)


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large binary column."""
    column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copies piece i of ``data`` to place ``at[i]`` of ``out``, all pieces at once."""
    sizes = np.diff(offsets)
    source = np.arange(offsets[0], offsets[-1])
    out[source + np.repeat(at - offsets[:-1], sizes)] = data[source]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted turns in one buffer: bytes, turn offsets, text starts, text ends."""
    role_data, role_at = _parts(_escaped(roles, "#<:"))
    text_data, text_at = _parts(_escaped(texts, "#<"))
    role_size, text_size = np.diff(role_at), np.diff(text_at)
    fixed = len(HEAD) + len(AFTER_ROLE) + len(END)
    turn_at = np.concatenate([[0], np.cumsum(role_size + text_size + fixed)])
    out = np.empty(int(turn_at[-1]), dtype=np.uint8)
    role_to = turn_at[:-1] + len(HEAD)
    text_to = role_to + role_size + len(AFTER_ROLE)
    text_end = text_to + text_size
    for mark, at in ((HEAD, turn_at[:-1]), (AFTER_ROLE, role_to + role_size), (END, text_end)):
        out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    _scatter(out, role_to, role_data, role_at)
    _scatter(out, text_to, text_data, text_at)
    return out, turn_at, text_to, text_end


def format_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(``conv_id``, ``block``, ``last``, ``at``, ``n_turns``, ``formatted``, ``loss_starts``,
    ``loss_ends``) of every block of every conversation.

    Turns by ``turn``, nulls first; ties by role, then text, and repeated rows stay.
    Null roles and texts are empty; null ids are one conversation. ``formatted`` holds
    UTF-8 bytes, and the loss spans are byte offsets of the assistant's texts in it.

    A conversation is block 0, or blocks of about ``BLOCK_BYTES`` each (or one longer turn)
    that follow one another: ``at`` is a block's place in bytes, and ``last`` whether it is
    the last. Conversations stream through sorted partitions; a task holds a block and an
    Arrow batch, whatever the length of a conversation. An empty table gives an empty
    result, and other columns are ignored, whatever their names.
    """
    source = rows.select(
        F.col(conv).cast("bigint").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.col(role).cast("string").alias("role"),
        F.col(text).cast("string").alias("text"),
    )
    ordered = source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def formed(held: list[pa.RecordBatch], block: int, at: int, last: bool) -> pa.RecordBatch:
        """Rows of the turns held, of which the first conversation goes on from a block before."""
        table = pa.Table.from_batches(held).combine_chunks()
        ids, roles, texts = (pa.concat_arrays(table.column(i).chunks) for i in (0, 2, 3))
        new = _starts(ids)
        data, turn_at, text_to, text_end = assemble(roles, texts)
        conv_at = np.append(turn_at[new], turn_at[-1])
        loss = pc.fill_null(pc.equal(roles, LOSS_ROLE), False).to_numpy(zero_copy_only=False)
        own = np.repeat(np.arange(new.size), np.diff(np.append(new, len(ids))))
        bounds = np.concatenate([[0], np.cumsum(np.bincount(own[loss], minlength=new.size))]).astype(np.int32)
        spans = [
            pa.ListArray.from_arrays(pa.array(bounds), pa.array((at - conv_at[own])[loss]))
            for at in (text_to, text_end)
        ]
        formatted = pa.Array.from_buffers(
            pa.large_binary(), new.size, [None, pa.py_buffer(conv_at.astype(np.int64)), pa.py_buffer(data)]
        ).cast(pa.binary())
        turns = pa.array(np.diff(np.append(new, len(ids))).astype(np.int64))
        first = np.arange(new.size) == 0
        places = [
            pa.array(np.where(first, block, 0).astype(np.int32)),
            pa.array(np.full(new.size, last)),
            pa.array(np.where(first, at, 0).astype(np.int64)),
        ]
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(new)), *places, turns, formatted, *spans],
            names=["conv_id", "block", "last", "at", "n_turns", "formatted", "loss_starts", "loss_ends"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # turns of one conversation, not the first of it after block 0
        block = at = size = 0
        for batch in batches:
            for part in slices(batch, 3, min(BLOCK_BYTES, CHUNK_BYTES)):
                start = int(_starts(part.column(0))[-1])
                other = bool(held) and held[-1].column(0)[-1] != part.column(0)[0]
                if held and not other and size >= BLOCK_BYTES:
                    rows = formed(held, block, at, False)
                    yield rows
                    held, block, at, size = [], block + 1, at + len(rows.column(5)[0].as_buffer()), 0
                if start or other:
                    yield formed([*held, part.slice(0, start)] if start else held, block, at, True)
                    held, block, at, size = [], 0, 0, 0
                    part = part.slice(start)
                held.append(part)
                size += pc.sum(pc.binary_length(part.column(3))).as_py() or 0
        if held:
            yield formed(held, block, at, True)

    return ordered.mapInArrow(
        run,
        "conv_id bigint, block int, last boolean, at bigint, n_turns bigint, formatted binary, "
        "loss_starts array<bigint>, loss_ends array<bigint>",
    )


def _starts(ids: pa.Array) -> np.ndarray:
    """First rows of the runs of equal ids, null being an id."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    value = pc.fill_null(ids, 0).to_numpy()
    new = np.ones(value.size, dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (null[1:] != null[:-1])
    return np.flatnonzero(new)


def read_turns(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """Roles and texts of a formatted conversation; refuses anything else."""
    found, at = [], 0
    while at < len(formatted):
        match = _TURN.match(formatted, at)
        if not match:
            raise ValueError(f"no turn at byte {at}")
        found.append((_unescaped(match[1]), _unescaped(match[2])))
        at = match.end()
    return found


class _Digest:
    """Counts and digests of the blocks of one conversation, read back one after the other."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.at = 0

    def add(self, at: int, data: bytes, starts: list, ends: list) -> None:
        if at != self.at:
            raise ValueError(f"a block at byte {at} follows {self.at} bytes")
        self.at += len(data)
        for role, text in read_turns(data):
            self.n_turns += 1
            self.turns.update(b"%s\n%s\n" % (role, text))
        for start, end in zip(starts, ends):
            text = _unescaped(data[start:end])
            self.loss.update(text)
            self.loss_chars += len(text.decode("utf-8", "replace"))
        self.chars += len(data.decode("utf-8", "replace"))

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives, as counts and digests.

    ``turns_sha256`` of role, \\n, text, \\n of every turn; ``loss_chars`` and
    ``loss_sha256`` of all text under the loss spans; ``formatted_chars``. Conversations of
    one block are read where they are; only blocks of longer ones are shuffled, to stream
    in order. ``formatted`` is read twice, so store it first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, out = _Digest(), []
        for batch in batches:
            for conv, last, at, *block in zip(*(column.to_pylist() for column in batch.columns)):
                digest.add(at, *block)
                if last:
                    out.append((conv, *digest.row()))
                    digest = _Digest()
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )
            out = []

    columns = ["conv_id", "last", "at", "formatted", "loss_starts", "loss_ends"]
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    alone = F.col("last") & (F.col("block") == 0)
    longer = formatted.where(~alone).repartition("conv_id").sortWithinPartitions("conv_id", "block")
    parts = (df.select(*columns).mapInArrow(run, schema) for df in (formatted.where(alone), longer))
    return next(parts).unionByName(next(parts))
