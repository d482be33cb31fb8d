"""Set similarity self-join of texts over word n-grams, down to components.

Prefix filtering, rare n-grams first: two sets with Jaccard similarity t or more
share an n-gram within their first |s| - ceil(t |s|) + 1 n-grams in any global order.
The order is by rarity, from a count sketch of fixed size over all texts, ties by
hash. Texts meet where they share a prefix n-gram; length and positional filters
drop pairs there, a suffix filter (overlap bounded piece by piece between pivots)
before the exact intersection.

Equal sets are one class with one representative. Of a group that shares a prefix
n-gram, every member first meets one leader: pairs linear in the group. Members whose
components still differ meet each other afterwards, without a cap. In large groups
that happens inside tasks, block by block, and only links that join components come
out; no pair of a large group is ever a row. No link between components is lost.

N-grams are compared by 64-bit hashes of their words, sets by 96-bit hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicewatch.llm.arrow_rows import slices, texts_of
from sluicewatch.llm.components import components
from sluicewatch.llm.scratch import counted, stored

NGRAM = 5
#: Jaccard similarity from which two texts link, in hundredths.
PERCENT = 75
#: The rarity sketch has 2 ** SKETCH_BITS counters, whatever the input.
SKETCH_BITS = 24
SKETCH_ROW = 1 << 16
#: Counts of one task stop here and take a byte: the sketch orders, it needn't be exact.
TASK_COUNT = 255
#: Sets after which a task cuts its counts, which take two bytes until then.
SETS = 1 << 14
#: Sums take a byte too, as their roots times this: as fine as chance among n-grams of one counter.
ROOTS = 4
REMEMBERED = 1 << 20
#: Pairs of one leader that one task of a verification gets at most, about.
PORTION = 512
#: Groups of up to so many members are compared pair by pair.
SMALL_GROUP = 16
#: Bytes that a row of a few keys takes, for the choice to broadcast it.
KEYS_BYTES = 64
#: N-grams of one block of a family.
BLOCK_GRAMS = 1 << 20

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word n-grams, as sorted arrays of distinct 64-bit hashes."""

    def __init__(self, ngram: int = NGRAM):
        self.ngram = ngram
        self.hashes = _WordHashes()

    def set_of(self, text: bytes | None) -> np.ndarray:
        """Empty for null and for texts without words; fewer words are one n-gram."""
        words = text.translate(_LOWER).split() if text else []
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        width = min(self.ngram, h.size)
        if not width:
            return h
        count = h.size - width + 1
        total = np.full(count, width, dtype=np.uint64)
        for k in range(width):
            total = total * _STEP + h[k : k + count]
        return np.unique(_mixed(total))


def set_key(grams: np.ndarray) -> bytes:
    """Size, then a hash of the set: keys of smaller sets sort first."""
    return grams.size.to_bytes(4, "big") + hashlib.blake2b(grams.tobytes(), digest_size=12).digest()


def needed(sizes, percent: int):
    """Least overlap of two sets of this total size that reaches the similarity."""
    return -(-percent * sizes // (100 + percent))


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def may_reach(a: np.ndarray, b: np.ndarray, need: int, pieces: int = 8) -> bool:
    """Suffix filter: overlap is bounded by the smaller count between pivots of a."""
    pivots = a[np.arange(1, pieces) * a.size // pieces]
    cuts_a, cuts_b = np.searchsorted(a, pivots), np.searchsorted(b, pivots)
    in_a = np.diff(cuts_a, prepend=0, append=a.size)
    in_b = np.diff(cuts_b, prepend=0, append=b.size)
    return int(np.minimum(in_a, in_b).sum()) >= need


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.minimum(np.searchsorted(b, a), b.size - 1)
    return int((b[at] == a).sum())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    need = needed(a.size + b.size, percent)
    if min(a.size, b.size) < need or not may_reach(a, b, need):
        return False
    return overlap(a, b) >= need


def _packed(counts: np.ndarray) -> bytes:
    """Counts that are mostly none or few, in a bit or two each."""
    pack = zlib.compressobj(1, strategy=zlib.Z_RLE)
    return pack.compress(counts.tobytes()) + pack.flush()


def _digests(docs: DataFrame, ngram: int) -> DataFrame:
    """Of each text its set's size and key; and of each task its part of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(ngram)
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint16)
        sets = 0
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, 2):
                keys = []
                for text in texts_of(part.column(2)):
                    grams = shingler.set_of(text)
                    key = set_key(grams) if grams.size else None
                    keys.append(key)
                    if key and key not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(key)
                        at = (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                        np.add.at(counts, at, 1)
                        sets += 1
                        if sets % SETS == 0:
                            np.minimum(counts, TASK_COUNT, out=counts)
                none = (pa.nulls(len(keys), kind) for kind in (pa.int32(), pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(keys, pa.binary()), *none],
                    names=["id", "uid", "key", "row", "counts"],
                )
        rows = counts.reshape(-1, SKETCH_ROW)
        used = np.flatnonzero(rows.any(axis=1))
        none = (pa.nulls(used.size, kind) for kind in (pa.int64(), pa.int64(), pa.binary()))
        sums = pa.array([_packed(np.minimum(rows[r], TASK_COUNT).astype(np.uint8)) for r in used], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [*none, pa.array(used.astype(np.int32)), sums], names=["id", "uid", "key", "row", "counts"]
        )

    return docs.select("id", "uid", "text").mapInArrow(
        run, "id bigint, uid bigint, key binary, row int, counts binary"
    )


def _sketch(parts: DataFrame) -> np.ndarray:
    """The roots of the sums of the tasks' sketches; the driver gets their fixed size only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = np.frombuffer(zlib.decompress(counts.as_buffer()), np.uint8)
                sums[row] = sums[row] + value if row in sums else value.astype(np.uint32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(sums), pa.int32()),
                pa.array([np.minimum(ROOTS * np.sqrt(x), 255).astype(np.uint8).tobytes() for x in sums.values()], pa.binary()),
            ],
            names=["row", "counts"],
        )

    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint8).reshape(-1, SKETCH_ROW)
    summed = parts.select("row", "counts").repartition("row").mapInArrow(run, "row int, counts binary")
    for r in summed.collect():
        sketch[r.row] = np.frombuffer(r.counts, np.uint8)
    return sketch.ravel()


def _prefixes(docs: DataFrame, sketch: np.ndarray, ngram: int, percent: int) -> DataFrame:
    """(``h``, ``key``, ``pos``): the prefix n-grams of every set, once per task."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, rarity = Shingler(ngram), shared.value
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, 0):
                grams_of, keys, sizes = [], [], []
                for text in texts_of(part.column(0)):
                    grams = shingler.set_of(text)
                    if not grams.size or (key := set_key(grams)) in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(key)
                    count = rarity[grams >> np.uint64(64 - SKETCH_BITS)]
                    first = np.argsort(count, kind="stable")[: prefix_length(grams.size, percent)]
                    grams_of.append(grams[first])
                    keys.append(key)
                    sizes.append(first.size)
                if not keys:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(grams_of).view(np.int64)),
                        pa.array(keys, pa.binary()).take(pa.array(np.repeat(np.arange(len(keys)), sizes))),
                        pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])),
                    ],
                    names=["h", "key", "pos"],
                )

    return docs.select("text").mapInArrow(run, "h bigint, key binary, pos int")


def _fixed(column: pa.Array) -> np.ndarray:
    """16-byte keys as one numpy value each."""
    column = column.cast(pa.binary())
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, dtype="V16")
    return np.frombuffer(data, dtype="V16", count=len(column), offset=16 * column.offset)


def _shared(prefixes: DataFrame) -> DataFrame:
    """Prefix n-grams of two sets or more, each with the leader of its group.

    The leader is the least key. Rows stream through in order of n-gram and key, so
    a group of any size takes no memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None  # of the group at hand: n-gram, key, position
        lead_shown = False
        last_key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column(0).to_numpy()
            pos = batch.column(2).to_numpy()
            keys = _fixed(batch.column(1))
            new_group = np.ones(h.size, dtype=bool)
            new_group[1:] = h[1:] != h[:-1]
            new_group[0] = lead is None or h[0] != lead[0]
            new_key = np.ones(h.size, dtype=bool)
            new_key[1:] = keys[1:] != keys[:-1]
            new_key[0] = last_key is None or keys[0] != last_key
            new_key |= new_group
            # Which row leads each row: the start of its group, or the lead carried over.
            start = np.maximum.accumulate(np.where(new_group, np.arange(h.size), -1))
            member = new_key & ~new_group
            rows = np.flatnonzero(member)
            out = []
            if rows.size:
                carried = start[rows] < 0
                lead_pos = np.where(carried, lead[2] if lead else 0, pos[start[rows]])
                lead_key = keys[np.maximum(start[rows], 0)].copy()
                if carried.any():
                    lead_key[carried] = np.frombuffer(lead[1], "V16")[0]
                out.append((h[rows], keys[rows], pos[rows], lead_key, lead_pos))
                leads = np.unique(start[rows][~carried])
                if carried.any() and not lead_shown:
                    one = np.frombuffer(lead[1], "V16")
                    out.append((np.array([lead[0]]), one, np.array([lead[2]], np.int32), one, np.array([lead[2]], np.int32)))
                    lead_shown = True
                out.append((h[leads], keys[leads], pos[leads], keys[leads], pos[leads]))
                columns = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns[0].astype(np.int64)),
                        _binary(columns[1]),
                        pa.array(columns[2].astype(np.int32)),
                        _binary(columns[3]),
                        pa.array(columns[4].astype(np.int32)),
                    ],
                    names=["h", "key", "pos", "lead", "lead_pos"],
                )
            last = int(start[-1])
            if last >= 0:
                lead = (h[last], keys[last].tobytes(), pos[last])
                lead_shown = bool(member[last:].any())
            last_key = keys[-1].copy()

    ordered = prefixes.repartition("h").sortWithinPartitions("h", "key")
    return ordered.mapInArrow(run, "h bigint, key binary, pos int, lead binary, lead_pos int")


def _binary(keys: np.ndarray) -> pa.Array:
    offsets = np.arange(keys.size + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(
        pa.binary(), keys.size, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(keys))]
    )


def _size(key) -> F.Column:
    return F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("bigint")


def _reachable(a, pos_a, b, pos_b, percent: int) -> F.Column:
    """Length and positional filters of two sets that share an n-gram."""
    size_a, size_b = _size(a), _size(b)
    short, long_ = F.least(size_a, size_b), F.greatest(size_a, size_b)
    bound = F.least(pos_a, pos_b) + 1 + F.least(size_a - pos_a - 1, size_b - pos_b - 1)
    return (short * 100 >= long_ * percent) & (bound * (100 + percent) >= (size_a + size_b) * percent)


def _verified(pairs: DataFrame, texts: DataFrame, ngram: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) of class keys whose sets are similar, given (``key``, ``text``).

    Texts of both sides go to the task of ``a``, which streams them: first a's,
    then every b's. The pairs of one ``a`` are dealt over many tasks in portions.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PORTION).cast("int").alias("portions"))
    portioned = pairs.join(many, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.col("portions")).cast("int").alias("portion")
    )
    firsts = portioned.select("a", F.col("a").alias("b"), "portion").distinct()
    roles = portioned.unionByName(firsts).withColumnRenamed("b", "key")
    found = texts.join(counted(roles, KEYS_BYTES), "key").withColumnRenamed("key", "b")
    dealt = found.select("a", "portion", (F.col("a") != F.col("b")).alias("second"), "b", "text")
    dealt = dealt.repartition("a", "portion").sortWithinPartitions("a", "portion", "second", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(ngram)
        of, grams, last = None, None, None
        for batch in batches:
            for part in slices(batch, 4):
                found = []
                rows = zip(*(part.column(i).to_pylist() for i in range(4)), texts_of(part.column(4)))
                for a, portion, second, b, text in rows:
                    if (a, portion, b) == last:
                        continue
                    last = a, portion, b
                    if not second:
                        of, grams = a, shingler.set_of(text)
                    elif of == a and similar(grams, shingler.set_of(text), percent):
                        found.append((a, b))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["a", "b"]
                    )

    return dealt.mapInArrow(run, "a binary, b binary")


def _classified(
    docs: DataFrame, id: str, text: str, ngram: int, percent: int
) -> tuple[DataFrame, DataFrame]:
    """Of every row ``id``, ``uid`` (hash of id and text) and set ``key``; of every key ``root`` and least id."""
    rows = docs.select(
        F.col(id).cast("bigint").alias("id"),
        F.xxhash64(id, text).alias("uid"),
        F.col(text).cast("binary").alias("text"),
    )
    digests = stored(_digests(rows, ngram), "digests")
    sketch = _sketch(digests.where(F.col("row").isNotNull()))
    owners = digests.where(F.col("row").isNull()).select("id", "uid", "key")
    classes = stored(
        owners.where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.min("uid").alias("uid"), F.min("id").alias("least")),
        "classes",
    )
    met = stored(_shared(_prefixes(rows, sketch, ngram, percent)), "met")
    wanted = met.select("key").distinct().join(classes.select("key", "uid"), "key")
    texts = stored(rows.select("uid", "text").join(counted(wanted, KEYS_BYTES), "uid").select("key", "text"), "texts")
    roots = _linked(met, texts, ngram, percent)
    root_of = classes.join(roots.select(F.col("a").alias("key"), F.col("b").alias("root")), "key", "left")
    return owners, root_of.select("key", "uid", "least", F.coalesce("root", "key").alias("root"))


def near_duplicates(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    ngram: int = NGRAM,
    percent: int = PERCENT,
) -> DataFrame:
    """(``doc_id``, ``n_shingles``, ``component_id``) of every row.

    Texts link when 100 * intersection >= ``percent`` * union of their sets of word
    n-grams (words between ASCII white space, A-Z lower-cased). ``component_id`` is the
    least id that links reach, the row's own included; null ids count for nothing.
    Null, empty and wordless texts have no n-grams and link with nothing. A repeated
    row is a row of the same component. The ids must be integers.
    """
    owners, root_of = _classified(docs, id, text, ngram, percent)
    ids = root_of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = root_of.join(ids, "root").select("key", "component_id")
    return owners.join(named, "key", "left").select(
        F.col("id").alias("doc_id"),
        F.coalesce(_size(F.col("key")), F.lit(0)).cast("bigint").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def deduplicated(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    ngram: int = NGRAM,
    percent: int = PERCENT,
) -> DataFrame:
    """``docs`` with one row of each component: that of its least id, rows without one last.

    Rows of equal id and text are one document. Texts without n-grams all stay, null and
    empty ones too. Texts of any length are compared whole; an empty table stays empty.
    """
    owners, root_of = _classified(docs, id, text, ngram, percent)
    worded = owners.where(F.col("key").isNotNull()).join(root_of.select("key", "root"), "key")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("uid"))
    chosen = worded.groupBy("root").agg(F.min(order).getField("uid").alias("uid")).select("uid")
    wordless = owners.where(F.col("key").isNull()).select("uid")
    # A struct keeps the columns of docs apart from ours, whatever they are called.
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(id, text).alias("uid"))
    kept = marked.join(chosen.unionByName(wordless).distinct(), "uid", "left_semi")
    return kept.dropDuplicates(["uid"]).select("row.*")


def _linked(met: DataFrame, texts: DataFrame, ngram: int, percent: int) -> DataFrame:
    """Roots of the components that the similar pairs among ``met`` make.

    First every member of a group meets the group's leader. What is then still in
    different components meets each other: in small groups pair by pair, in large
    ones by families of groups.
    """
    met_leader = met.where(F.col("key") != F.col("lead"))
    led = stored(_ordered(met_leader, "lead", "lead_pos", "key", "pos", percent), "pairs")
    roots = components(_verified(led, texts, ngram, percent))
    apart = stored(_apart(met, roots), "apart")
    small = stored(
        _all_pairs(apart.where(F.col("n") <= SMALL_GROUP), percent).join(led, ["a", "b"], "left_anti"),
        "pairs",
    )
    links = _verified(small, texts, ngram, percent).unionByName(
        _verified_families(apart.where(F.col("n") > SMALL_GROUP), texts, ngram, percent)
    )
    return components(roots.unionByName(links))


def _apart(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(``h``, ``key``, ``pos``, ``root``, ``n``) of groups with more than one component."""
    named = roots.select(F.col("a").alias("key"), F.col("b").alias("root"))
    known = met.select("h", "key", "pos").join(counted(named, KEYS_BYTES), "key", "left")
    known = known.select("h", "key", "pos", F.coalesce("root", "key").alias("root")).repartition("h")
    groups = known.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
    return known.join(groups.where("low <> high").select("h", "n"), "h")


def _ordered(frame: DataFrame, x: str, x_pos: str, y: str, y_pos: str, percent: int) -> DataFrame:
    near = frame.where(_reachable(F.col(x), F.col(x_pos), F.col(y), F.col(y_pos), percent))
    return near.select(F.col(x).alias("a"), F.col(y).alias("b")).distinct()


def _all_pairs(apart: DataFrame, percent: int) -> DataFrame:
    x, y = apart.alias("x"), apart.alias("y")
    both = x.join(y, F.col("x.h") == F.col("y.h")).where(
        (F.col("x.key") < F.col("y.key")) & (F.col("x.root") != F.col("y.root"))
    )
    return _ordered(both, "x.key", "x.pos", "y.key", "y.pos", percent)


def _verified_families(apart: DataFrame, texts: DataFrame, ngram: int, percent: int) -> DataFrame:
    """Links that join components within large groups.

    Groups of much the same members have much the same least member by a hash, and
    those with the same one are a family. A family is split into blocks of about
    ``BLOCK_GRAMS`` n-grams; each two blocks meet in one task, which counts overlaps
    by its own lists of n-grams and returns only links that join components.
    """
    member = F.struct(F.xxhash64("key").alias("o"), "key")
    names = apart.groupBy("h").agg(F.min(member).getField("key").alias("family"))
    members = stored(apart.join(names, "h").select("family", "key", "root").distinct(), "families")
    sizes = members.groupBy("family").agg(
        F.ceil(F.sum(_size(F.col("key"))) / BLOCK_GRAMS).cast("int").alias("blocks")
    )
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    placed = members.join(sizes, "family").withColumn("own", own)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        "family", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "key", "root"
    )
    dealt = texts.join(counted(placed, 2 * KEYS_BYTES), "key").select("family", "x", "y", "key", "root", (F.col("own") == F.col("y")).alias("second"), "text")
    dealt = dealt.repartition("family", "x", "y").sortWithinPartitions("family", "x", "y", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(ngram)
        place, members = None, {}

        def links() -> Iterator[pa.RecordBatch]:
            found = _joining(list(members.items()), place[1] == place[2], percent) if place else []
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["a", "b"]
                )

        for batch in batches:
            for part in slices(batch, 6):
                columns = (part.column(i).to_pylist() for i in range(6))
                for family, x, y, key, root, second, text in zip(*columns, texts_of(part.column(6))):
                    if (family, x, y) != place:
                        yield from links()
                        place, members = (family, x, y), {}
                    if key not in members:
                        members[key] = root, second, shingler.set_of(text)
        yield from links()

    return dealt.mapInArrow(run, "a binary, b binary")


def _joining(members: list, one_block: bool, percent: int) -> list[tuple[bytes, bytes]]:
    """Links that join components among (key, (root, in second block, set)) members.

    Sets of members that are in one component already are not compared.
    """
    parent: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    grams, owner = [m[1][2] for m in members], np.repeat(np.arange(len(members)), [m[1][2].size for m in members])
    _, ids = np.unique(np.concatenate(grams), return_inverse=True)
    by_gram = np.argsort(ids, kind="stable")
    lists = owner[by_gram]
    ends = np.cumsum(np.bincount(ids))
    starts = ends - np.bincount(ids)
    sizes = np.array([g.size for g in grams])
    cuts = np.cumsum([0, *sizes])
    second = np.array([m[1][1] for m in members])
    found = []
    for i, (key, (root, in_second, _)) in enumerate(members):
        near = (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        near[: i + 1] = False
        if not one_block:
            near &= second != in_second
        if not near.any():
            continue
        own = ids[cuts[i] : cuts[i + 1]]
        shared = np.bincount(np.concatenate([lists[starts[g] : ends[g]] for g in own]), minlength=sizes.size)
        for j in np.flatnonzero(near & (shared * (100 + percent) >= percent * (sizes + sizes[i]))):
            x, y = find(root), find(members[j][1][0])
            if x != y:
                parent[x] = y
                found.append((key, members[j][0]))
    return found
