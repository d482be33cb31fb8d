"""Token ids of documents as ORC files.

Rows in order of document id, ids as integer arrays (which ORC stores run-length
encoded), row indexes and a Bloom filter on the document id. Readers split files by
stripe, and look-ups of documents skip stripes and row groups by range and filter.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicewatch.llm.arrow_rows import slices, texts_of

END_ID = 2
STRIPE_BYTES = 16 << 20
ROW_GROUP = 1000
#: Words that a worker remembers; of more, those used most stay.
REMEMBERED = 3 << 17
#: Words that the tokenizer gets at a time, since what it returns takes a kilobyte a word.
ENCODED = 1 << 12
#: Text encoded at a time.
CHUNK_BYTES = 2 << 20
#: Characters among which letters are looked for that the model can take as they are.
LETTERS = range(0x61, 0x530)
#: Marks that are encoded apart from the word they end, where the tokenizer does so.
MARKS = b"!#$&*,.:;?"
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class _Places(dict):
    """Numbers of words in order of first use; words without ids yet are in ``new``."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        number = self[word] = len(self) + 1
        return number


class WordEncoder:
    """Ids of texts, each distinct word encoded once while it is remembered.

    Holds for tokenizers that never put ids across ASCII white space and drop it, as
    word tokenizers do. Those that lower-case get lower-case ASCII, and those that
    always cut between a letter and a run of marks get marks after a letter apart:
    either leaves fewer distinct words. Words of letters that the tokenizer neither
    changes nor cuts go to its model at once, in the characters that stand for their bytes.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content.encode().translate(_LOWER) for t in added]
        self.lowers, self.letters = self._lowers(), self._letters()
        self.cuts = self._cuts()
        self.same = all(read == chr(c) for c, read in self.letters.items() if c < 0x80)
        self.plain = re.compile(f"[{''.join(map(chr, self.letters))}]+" if self.letters else "(?!)")
        self._keep(np.zeros(0, np.int64))

    def _lowers(self) -> bool:
        """Whether the tokenizer lower-cases A-Z, but for its added tokens."""
        normalizer, letters = self.tokenizer.normalizer, bytes(range(0x41, 0x5B)).decode()
        return normalizer is not None and normalizer.normalize_str(letters) == letters.lower()

    def _lowered(self, text: bytes) -> bytes:
        """The text in lower case, or as it is if that may make or break an added token."""
        if not self.lowers:
            return text
        low = text.translate(_LOWER)
        return text if any(a in low for a in self.added) else low

    def _letters(self) -> dict[int, str]:
        """Letters of which any word is one piece as it is, and what the model reads for them.

        Each is tried in a word, and then all in one. None where a word is more than its
        pieces: texts cut or filled to a length, added tokens of letters.
        """
        whole, pre, normalizer = self.tokenizer, self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        if pre is None or whole.truncation or whole.padding:
            return {}

        def read(word: str) -> str | None:
            """What the model reads for a word that is left as it is, in one piece."""
            if normalizer is not None and normalizer.normalize_str(word) != word:
                return None
            pieces = pre.pre_tokenize_str(word)
            return pieces[0][0] if len(pieces) == 1 and pieces[0][1] == (0, len(word)) else None

        found = {}
        for c in map(chr, LETTERS):
            one = read(c) if c.isalpha() else None
            if one and read(f"x{c}{c}x") == f"{read('x')}{one}{one}{read('x')}":
                found[ord(c)] = one
        every = "".join(map(chr, found))
        added = [t.content for t in whole.get_added_tokens_decoder().values()]
        if read(every) != every.translate(found) or any(t and all(ord(c) in found for c in t) for t in added):
            return {}
        for word in (every[:6], every[-3:], every[::40]):
            if self._modelled(word.translate(found)) != whole.encode(word, add_special_tokens=False).ids:
                return {}
        return found

    def _modelled(self, read: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(read)]

    def _cuts(self) -> bool:
        """Whether the tokenizer cuts before marks, and only there, in a letter and two marks."""
        pre, marks = self.tokenizer.pre_tokenizer, MARKS.decode()
        added = self.tokenizer.get_added_tokens_decoder().values()
        if pre is None or any(t.content[-1:] in marks or t.lstrip or t.rstrip for t in added):
            return False
        letters = {*map(chr, self.letters), "x"}
        tried = [("x", m, n) for m in marks for n in marks] + [(c, m, m) for c in letters for m in marks]
        return all([span for _, span in pre.pre_tokenize_str("".join(x))] == [(0, 1), (1, 3)] for x in tried)

    def _keep(self, kept: np.ndarray) -> None:
        """Forgets all words but those with these ascending numbers."""
        if kept.size:
            words = list(self.place)
            sizes, starts = np.diff(self.offsets)[kept], self.offsets[kept]
            ends = np.cumsum(sizes)
            ids = self.ids[np.arange(int(ends[-1])) + np.repeat(starts - (ends - sizes), sizes)]
        self.place = _Places()
        self.ids = np.array([self.end_id], dtype=np.int32)
        self.offsets = np.array([0, 1], dtype=np.int64)
        if kept.size:
            self.place.update((words[n - 1], i) for i, n in enumerate(kept.tolist(), 1))
            self.ids = np.concatenate([self.ids, ids])
            self.offsets = np.concatenate([self.offsets, 1 + ends])
        self.uses = np.zeros(self.offsets.size - 1, dtype=np.int64)

    def _forget(self) -> None:
        """Forgets words used once, and more if these are under half of all."""
        uses = self.uses.copy()
        uses[0] = 0
        least = max(2, int(np.sort(uses)[-(REMEMBERED // 2)]) + 1 if uses.size > REMEMBERED // 2 else 2)
        self._keep(np.flatnonzero(uses >= least))

    def _ends_in_letter(self, stem: bytes) -> bool:
        if 0x61 <= stem[-1] <= 0x7A:
            return True
        last = stem[-2:].decode("utf-8", "replace")  # of two bytes, as all letters beyond ASCII here
        return len(last) == 1 and ord(last) in self.letters

    def _learn(self) -> None:
        new, known = self.place.new, self.offsets.size
        if not new:
            return
        whole, texts, ended, ids = [], [], {}, []
        plain, letters, modelled = self.plain.fullmatch, self.letters, self._modelled
        for i, word in enumerate(new):  # grows by the parts of its words
            ids.append(None)
            text = word.decode("utf-8", "replace")
            if plain(text):
                ids[i] = modelled(text if text.isascii() and self.same else text.translate(letters))
                continue
            stem = word.rstrip(MARKS) if self.cuts else word
            if 0 < len(stem) < len(word) and self._ends_in_letter(stem):
                ended[i] = self.place[stem], self.place[word[len(stem) :]]
            else:
                whole.append(i)
                texts.append(text)
        for at in range(0, len(whole), ENCODED):
            got = self.tokenizer.encode_batch_fast(texts[at : at + ENCODED], add_special_tokens=False)
            for i, e in zip(whole[at : at + ENCODED], got):
                ids[i] = e.ids

        def ids_at(number: int) -> list[int]:
            if number + 1 < known:
                return self.ids[self.offsets[number] : self.offsets[number + 1]].tolist()
            return ids[number + 1 - known]

        for i, (stem, marks) in ended.items():
            ids[i] = ids_at(stem) + ids_at(marks)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        learned = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
        self.ids = np.concatenate([self.ids, learned])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
        self.place.new = []

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and the texts' offsets."""
        if len(self.place) > REMEMBERED:
            self._forget()
        words = [self._lowered(t).split() if t else [] for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        flat = chain.from_iterable(words)
        places = np.fromiter(map(self.place.__getitem__, flat), np.int64, int(counts.sum()))
        self._learn()
        self.uses = np.bincount(places, minlength=self.offsets.size - 1) + np.pad(
            self.uses, (0, self.offsets.size - 1 - self.uses.size)
        )
        places = np.insert(places, np.cumsum(counts), 0)
        sizes = self.offsets[places + 1] - self.offsets[places]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if ends.size else 0) + np.repeat(self.offsets[places] - (ends - sizes), sizes)
        bounds = np.concatenate([[0], ends[np.cumsum(counts + 1) - 1]]) if counts.size else np.zeros(1, np.int64)
        return self.ids[at], bounds


@lru_cache(maxsize=1)
def _encoder(path: str, end_id: int) -> WordEncoder:
    """One encoder per worker: what it remembers outlives a task."""
    return WordEncoder(path, end_id)


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    id: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
) -> None:
    """Writes ``doc_id``, ``n_tokens``, ``ids``, ``part``, ``part_start`` to ``folder``.

    Files follow each other in ascending id, nulls first; rows of one id are ordered by
    hash of text. Null text is empty and has the end id alone. ``part_start`` counts the
    ids before a row in its part. ``tokenizer_path`` must lead to the tokenizer on
    every machine. Texts are encoded whole, repeated rows each on its own; an empty table
    makes a folder without rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(parts, "doc_id", tie).sortWithinPartitions("doc_id", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path, end_id)
        number, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, 1, CHUNK_BYTES):
                ids, bounds = encode(texts_of(piece.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array(np.diff(bounds)),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                        pa.array(np.full(piece.num_rows, number, dtype=np.int32)),
                        pa.array(before + bounds[:-1]),
                    ],
                    names=["doc_id", "n_tokens", "ids", "part", "part_start"],
                )
                before += int(bounds[-1])

    tokens = ordered.mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids array<int>, part int, part_start bigint"
    )
    (
        tokens.write.option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", ROW_GROUP)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(folder)
    )


SCHEMA = "doc_id bigint, n_tokens bigint, ids array<int>, part int, part_start bigint"


def read_tokens(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Token rows; with ``doc_ids`` only those documents', by index and Bloom filter."""
    rows = spark.read.schema(SCHEMA).orc(folder)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def placed(tokens: DataFrame) -> DataFrame:
    """Token rows with ``start``, the ids of all rows before.

    The driver gets one sum per part, whose number is that of shuffle partitions.
    """
    sums = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    base, at = [], 0
    for r in sorted(sums, key=lambda r: r.part):
        base.append((r.part, at))
        at += r.n
    bases = tokens.sparkSession.createDataFrame(base, "part int, base bigint")
    return tokens.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("part_start")).drop("base")


def with_crc(tokens: DataFrame) -> DataFrame:
    """Token rows with ``ids_crc32`` of the ids as little-endian 32-bit integers, in place of ids."""
    others = [c for c in tokens.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values = np.asarray(lists.values).astype("<u4")
            bounds = lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(sums, pa.int64())], names=[*others, "ids_crc32"]
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema if f.name != "ids")
    return tokens.select("ids", *others).mapInArrow(run, f"{kinds}, ids_crc32 bigint")
