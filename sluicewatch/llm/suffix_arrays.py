"""Benchmark decontamination with suffix arrays over the training text.

Each task builds suffix arrays over the words of its documents, shard by shard,
and binary-searches every suffix of every benchmark text in them: this gives all
occurrences of each window of ``window`` words, and the longest verbatim match at
every word of a document, with the suffix it is of. Documents stay where they are: no
shuffle, and nothing grows but the scan.

Words: A-Z lower-cased, then runs of digits, a-z and non-ASCII characters. Only
words of the benchmark can match, so all others act as ends of suffixes; shards
hold suffixes of benchmark words alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from sluicewatch.llm.arrow_rows import apart, with_results

WINDOW = 13
_EARLIER = "__earlier"
#: Benchmark text that one pass searches for; a larger benchmark takes more passes.
BLOCK_BYTES = 16 << 20

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


def runs_left(ids: np.ndarray) -> np.ndarray:
    """For each position, the words from there to the next end (id 0)."""
    ends = np.flatnonzero(ids == 0)
    at = np.arange(ids.size)
    following = ends[np.minimum(np.searchsorted(ends, at), max(ends.size - 1, 0))]
    return following - at


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of words, sorted by their suffixes to the next 0, up to ``depth`` words.

    Prefix doubling; a round sorts only suffixes that the last one left tied.
    ``ids`` ends with 0.
    """
    left = runs_left(ids)
    order = np.flatnonzero(ids)
    order = order[np.argsort(ids[order], kind="stable")]
    rank = np.zeros(ids.size, dtype=np.int64)
    first = np.ones(order.size, dtype=bool)
    first[1:] = ids[order][1:] != ids[order][:-1]
    known = 1
    while order.size:
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, order.size))
        rank[order] = np.repeat(starts + 1, sizes)
        tied = (sizes > 1) & (np.maximum.reduceat(left[order], starts) > known)
        if known >= depth or not tied.any():
            break
        open_slots = np.flatnonzero(np.repeat(tied, sizes))
        members = order[open_slots]
        after = np.minimum(members + known, ids.size - 1)
        second = np.where(left[members] > known, rank[after], 0)
        key = (rank[members] << 32) | second
        sorting = np.argsort(key)
        order[open_slots] = members[sorting]
        key = key[sorting]
        first[open_slots[1:]] |= key[1:] != key[:-1]
        known *= 2
    return order


def common_words(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, limit: np.ndarray):
    """Lengths of the common beginnings of a[i:] and b[j:], at most ``limit``."""
    length = np.zeros(i.size, dtype=np.int64)
    going = np.flatnonzero(limit > 0)
    while going.size:
        x = a[i[going] + length[going]]
        same = (x == b[j[going] + length[going]]) & (x != 0)
        going = going[same]
        length[going] += 1
        going = going[length[going] < limit[going]]
    return length


class Benchmark:
    """Benchmark texts as word ids, with their suffixes and windows."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.ids: dict[bytes, int] = {}
        parts, starts, self.item_of_suffix = [], [], []
        windows: dict[tuple, tuple[int, set]] = {}
        offset = 0
        for item, text in items:
            found = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)]
            size = min(window, len(found))
            for k in range(len(found) - size + 1 if size else 0):
                windows.setdefault(tuple(found[k : k + size]), (offset + k, set()))[1].add(item)
            starts.extend(range(offset, offset + len(found)))
            self.item_of_suffix.extend([item] * len(found))
            parts.append(np.array([*found, 0], dtype=np.int32))
            offset += len(found) + 1
        self.text = np.concatenate(parts) if parts else np.zeros(1, dtype=np.int32)
        self.suffixes = np.array(starts, dtype=np.int64)
        self.lengths = runs_left(self.text)[self.suffixes] if starts else self.suffixes
        self.depth = int(self.lengths.max()) if starts else 0
        self.window_at = np.array([at for at, _ in windows.values()], dtype=np.int64)
        self.window_size = np.array([len(w) for w in windows], dtype=np.int64)
        self.window_items = [names for _, names in windows.values()]

    def bound(self, text, order, at, size, after: bool) -> np.ndarray:
        """Where each query's first ``size`` words belong in the suffix array.

        The place before all suffixes that begin with them, or behind these.
        """
        low = np.zeros(at.size, dtype=np.int64)
        high = np.full(at.size, order.size, dtype=np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not open_.size:
                return low
            middle = (low[open_] + high[open_]) // 2
            q, s, n = at[open_], order[middle], size[open_]
            same = common_words(self.text, q, text, s, n)
            whole = same >= n
            end = np.minimum(q + same, self.text.size - 1)
            right = np.where(whole, after, text[s + same] < self.text[end])
            low[open_] = np.where(right, middle + 1, low[open_])
            high[open_] = np.where(right, high[open_], middle)

    def search(self, text: np.ndarray):
        """Of a shard: window occurrences, and the longest match at every position.

        Returns (window numbers, positions) and (position, length, benchmark suffix).
        """
        order = suffix_array(text, self.depth)
        if not order.size or not self.suffixes.size:
            none = np.zeros(0, dtype=np.int64)
            return (none, none), (none, none, none)
        low = self.bound(text, order, self.window_at, self.window_size, False)
        high = self.bound(text, order, self.window_at, self.window_size, True)
        counts = high - low
        numbers = np.repeat(np.arange(counts.size), counts)
        slots = np.arange(numbers.size) - np.repeat(np.cumsum(counts) - counts, counts)
        positions = order[slots + np.repeat(low, counts)]

        # Each benchmark suffix seeds its neighbours in the suffix array with what it has
        # in common with them; further on, neighbours have that in common as far as they
        # have it with each other.
        place = self.bound(text, order, self.suffixes, self.lengths, False)
        seed, of = np.zeros(order.size, dtype=np.int64), np.zeros(order.size, dtype=np.int64)
        for neighbour in (place - 1, place):
            inside = np.flatnonzero((neighbour >= 0) & (neighbour < order.size))
            rank = neighbour[inside]
            same = common_words(self.text, self.suffixes[inside], text, order[rank], self.lengths[inside])
            best = np.lexsort((-inside, same))  # of the longest the first stays
            rank, same, inside = rank[best], same[best], inside[best]
            longer = same > seed[rank]
            seed[rank[longer]], of[rank[longer]] = same[longer], inside[longer]
        left = np.minimum(runs_left(text)[order], self.depth)
        shared = common_words(text, order[:-1], text, order[1:], np.minimum(left[:-1], left[1:]))
        length, suffix = spread(seed, of, shared)
        return (numbers, positions), (order, length, suffix)


def spread(seed: np.ndarray, of: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest seed that reaches each place from either side, and whose it is.

    A seed shrinks to ``shared`` of two neighbours on its way from one to the other.
    """
    best, whose = seed.tolist(), of.tolist()
    steps = shared.tolist()
    for places, back in ((range(1, len(best)), 1), (range(len(best) - 2, -1, -1), -1)):
        for r in places:
            step = steps[r - 1] if back == 1 else steps[r]
            if step > best[r]:
                before = best[r - back]
                carried = before if before < step else step
                if carried > best[r]:
                    best[r], whose[r] = carried, whose[r - back]
    return np.array(best, dtype=np.int64), np.array(whose, dtype=np.int64)


FIELDS = StructType(
    [
        StructField("n_words", LongType()),
        StructField("n_hit", LongType()),
        StructField("item_ids", ArrayType(StringType())),
        StructField("longest_match", LongType()),
        StructField("longest_start", LongType()),
        StructField("longest_item", StringType()),
        StructField("hit_words", BinaryType()),
    ]
)


def _search_chunk(index: Benchmark, texts: list) -> list[pa.Array]:
    known = index.ids.get
    parts, sizes = [], []
    for text in texts:
        found = words(text)
        sizes.append(len(found))
        parts.append(np.fromiter((known(w, 0) for w in found), np.int32, len(found)))
        parts.append(np.zeros(1, dtype=np.int32))
    shard = np.concatenate(parts)
    starts = np.cumsum([0, *(n + 1 for n in sizes)])
    (numbers, positions), (at, length, suffix) = index.search(shard)

    change = np.zeros(shard.size + 1, dtype=np.int64)
    np.add.at(change, positions, 1)
    np.add.at(change, positions + index.window_size[numbers], -1)
    hit = np.cumsum(change)[:-1] > 0
    owner = np.searchsorted(starts, positions, side="right") - 1
    items: list[set] = [set() for _ in texts]
    for doc, number in {*zip(owner.tolist(), numbers.tolist())}:
        items[doc] |= index.window_items[number]

    longest = [(0, None, None)] * len(texts)
    matched = np.flatnonzero(length)
    where = at[matched]
    doc_of = np.searchsorted(starts, where, side="right") - 1
    best = np.lexsort((where, -length[matched], doc_of))  # the first of the longest of each text
    docs, firsts = np.unique(doc_of[best], return_index=True)
    for doc, k in zip(docs.tolist(), best[firsts].tolist()):
        own = matched[k]
        longest[doc] = int(length[own]), int(at[own] - starts[doc]), index.item_of_suffix[suffix[own]]
    masks = [hit[s : s + n] for s, n in zip(starts.tolist(), sizes)]
    return [
        pa.array(sizes, pa.int64()),
        pa.array([int(m.sum()) for m in masks], pa.int64()),
        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        *(pa.array([x[i] for x in longest], (pa.int64(), pa.int64(), pa.string())[i]) for i in range(3)),
        pa.array([np.packbits(m).tobytes() for m in masks], pa.binary()),
    ]


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark by hash of item, in blocks of about ``block_bytes``."""
    rows = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"),
        F.col(text).cast("binary").alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    return [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with what the benchmark has in common with each text.

    ``n_words``; ``n_hit``, words inside occurrences of benchmark windows;
    ``item_ids``, the items with such windows, as sorted strings; and the longest verbatim
    match of the text with any item, whatever other texts hold: ``longest_match`` (words),
    ``longest_start`` (word, the first of equally long ones) and ``longest_item`` (one of
    those that have it), null where the text has no word of the benchmark.

    A window is ``window`` words of an item, or all words of a shorter one. Items
    without words have none; a null item id is listed as the empty string. Null
    text has no words. Repeated rows are searched each on its own, and texts whole,
    however long. An empty table gives an empty result, an empty benchmark no hits. Columns
    named like results give way to them. The benchmark is held in blocks of
    ``block_bytes`` (one broadcast and one pass each).
    """
    blocks = _blocks(benchmark, item, item_text, block_bytes)
    if len(blocks) > 1:  # in a struct the columns of docs are apart from those of the passes
        others = [F.col(f"`{c}`") for c in docs.columns if c != text]
        out = docs.select(F.struct(F.lit(0), *others).alias("row"), F.col(f"`{text}`").alias("text"))
        names, own_text, docs, text = docs.columns, text, out, "text"
        kept = [F.col("text").alias(c) if c == own_text else F.col(f"row.`{c}`") for c in apart(names, FIELDS.names)]
    out = docs
    for number, block in enumerate(blocks):
        items = sorted((r.item, bytes(r.text or b"")) for r in block.toLocalIterator())
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def make() -> Callable:
            index = Benchmark(shared.value, window)
            return lambda texts: _search_chunk(index, texts)

        if number == 0:
            out = with_results(docs, text, FIELDS, make)
        else:
            out = _merged(out, with_results(_set_aside(out), text, FIELDS, make))
    if len(blocks) > 1:
        out = out.select(*kept, *FIELDS.names)
    return out.drop("hit_words")


def _set_aside(out: DataFrame) -> DataFrame:
    return out.select(
        *(F.col(f"`{c}`") for c in apart(out.columns, FIELDS.names)),
        F.struct(*FIELDS.names).alias(_EARLIER),
    )


def _merged(_: DataFrame, out: DataFrame) -> DataFrame:
    """Results of one more block joined to those set aside on the same row."""
    bits = F.pandas_udf(_merge_hits, "hit_words binary, n_hit bigint")
    was = f"{_EARLIER}."
    before = F.col(was + "longest_match"), F.col(was + "longest_start")
    longer = (F.col("longest_match") > before[0]) | (
        (F.col("longest_match") == before[0]) & F.coalesce(F.col("longest_start") < before[1], F.lit(False))
    )
    merged = out.withColumn("__hits", bits(F.col("hit_words"), F.col(was + "hit_words")))
    choose = {
        name: F.when(longer, F.col(name)).otherwise(F.col(was + name))
        for name in ("longest_match", "longest_start", "longest_item")
    }
    return merged.select(
        *(F.col(f"`{c}`") for c in apart(out.columns, [*FIELDS.names, _EARLIER])),
        F.col("n_words"),
        F.col("__hits.n_hit").alias("n_hit"),
        F.array_sort(F.array_union("item_ids", was + "item_ids")).alias("item_ids"),
        *(value.alias(name) for name, value in choose.items()),
        F.col("__hits.hit_words").alias("hit_words"),
    )


def _merge_hits(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    both = [np.frombuffer(x, np.uint8) | np.frombuffer(y, np.uint8) for x, y in zip(a, b)]
    return pd.DataFrame({"hit_words": [x.tobytes() for x in both], "n_hit": [int(np.unpackbits(x).sum()) for x in both]})


def contaminated(matches: DataFrame, share: int = 20) -> DataFrame:
    """``matches`` with ``contaminated``: at least 1 word in ``share`` is hit."""
    return matches.withColumn(
        "contaminated",
        (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")),
    )
