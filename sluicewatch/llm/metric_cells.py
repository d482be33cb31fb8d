"""Near-duplicate embeddings: an exact range join under the angle, cell by cell.

Vectors are compared with those of their own label and length. The angle between two
vectors is a metric, and a cosine of at least c is an angle of at most e = arccos c.

Pivots, drawn from a bounded sample of each large label and kept apart from each other,
partition its vectors: a vector's home is its nearest pivot, in one of three shells by
its angle there. The core holds the angles up to e / 2: any two of its vectors link by
the triangle inequality, so that a group of copies of any size is counted and never
compared with itself. The near shell reaches as far as a core's partners can be, the
far shell takes the rest. A vector is replicated to a cell of another home only where
the triangle inequality, or the distance to the plane between the two pivots, leaves
room for a partner there. A vector's home cell therefore sees all of its partners, and
cells join independently: each counts the links of its own vectors, and returns the few
links that join components, no pairs.

Large cells are dealt out in blocks. Small labels are one cell without a pivot. What
goes to the driver are counts of at most ``PIVOT_BYTES`` worth of pivots and cells and a
sample of ``SAMPLE`` times as many vectors.

Where vectors are spread evenly over many dimensions, nearly all lie at nearly the same
angle to every pivot, and no metric bound can tell them apart: more pivots then make more
copies and spare no comparison. The sample shows how often its vectors would be copied
and with how many they would be compared, and a label gets the number of pivots at which
both cost least: that changes the work, never the result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from sluicewatch.llm.components import components
from sluicewatch.llm.scratch import counted, stored

COSINE = 0.93
#: Vectors of a cell, as doubles, below which no more pivots are looked for.
CELL_BYTES = 1 << 20
#: Vectors of a cell that one task holds to compare the others of the cell with.
BLOCK_BYTES = 16 << 20
#: All pivots together, as doubles, and vectors drawn to choose one pivot from.
PIVOT_BYTES = 1 << 20
SAMPLE = 8
#: What dealing out a copy of a vector costs, and a comparison by component, in operations.
COPY_COST, MEET_COST = 100_000.0, 2.0
#: Rows that are dealt out, or compared with a cell's own vectors, at a time.
CHUNK = 1024
#: Radians that angles and bounds may be off by.
SLACK = 1e-6

#: Vectors of a cell or block at least, however long they are.
LEAST_ROWS = 64

CORE, NEAR, FAR = 0, 1, 2
SHELLS = 3
#: Kinds of cells without a pivot: all of a label, and rows that link with nothing.
WHOLE, ALONE = -1, -2
_ROW_BYTES = 96

#: Rows x shells: blocks of each cell (0: none), least and greatest angle of its vectors.
Cells = tuple[np.ndarray, np.ndarray, np.ndarray]


def unit_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors of length one as doubles), by dimension.

    Null and zero vectors, and those with null or non-finite components, are left out.
    """
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(offsets)
    sizes[column.is_null().to_numpy(zero_copy_only=False)] = 0
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        found = values[offsets[:-1][rows][:, None] + np.arange(size)]
        most = np.abs(found).max(axis=1)
        with np.errstate(invalid="ignore"):
            good = np.isfinite(found).all(axis=1) & (most > 0)
        rows, found = rows[good], found[good] / most[good][:, None]
        yield rows, found / np.linalg.norm(found, axis=1)[:, None]


class Bounds:
    """Angles of a similarity: of linked vectors at most ``reach``, of core ones ``core``."""

    def __init__(self, cosine: float):
        self.cosine = cosine
        self.reach = math.acos(cosine)
        self.core = self.reach / 2 - SLACK

    def shells(self, angle: np.ndarray) -> np.ndarray:
        return np.where(angle <= self.core, CORE, np.where(angle <= self.core + self.reach, NEAR, FAR))

    def homes(self, units: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cosines and angles to all pivots, the nearest one, and the shell there."""
        cosines = units @ pivots.T
        angles = np.arccos(np.clip(cosines, -1, 1))
        home = cosines.argmax(axis=1)
        return cosines, angles, home, self.shells(angles[np.arange(home.size), home])

    def candidates(self, cosines, angles, home, pivots, low, high) -> np.ndarray:
        """Rows x pivots x shells: whether a vector may have partners whose home is there.

        ``low`` and ``high`` are the least and greatest angle of each cell's own vectors.
        """
        rows = np.arange(home.size)
        apart = np.sqrt(np.maximum(2 - 2 * (pivots[home] @ pivots.T), 1e-30))
        across = np.clip((cosines[rows, home][:, None] - cosines) / apart, -1, 1)
        near = (angles - angles[rows, home][:, None] <= 2 * self.reach + SLACK) & (
            np.arcsin(across) <= self.reach + SLACK
        )
        to_cell = angles[:, :, None]
        within = (to_cell >= low - self.reach - SLACK) & (to_cell <= high + self.reach + SLACK)
        return near[:, :, None] & within


def choose_pivots(units: np.ndarray, wanted: int, bounds: Bounds) -> np.ndarray:
    """Vectors with most others in their core, and farther apart than cores reach."""
    inside = np.concatenate([
        (units[k : k + CHUNK] @ units.T >= math.cos(max(bounds.core, 0))).sum(axis=1) for k in range(0, len(units), CHUNK)
    ])
    chosen: list[int] = []
    free = np.ones(len(units), dtype=bool)
    for i in np.argsort(-inside, kind="stable"):
        if free[i] and len(chosen) < wanted:
            chosen.append(int(i))
            free &= units @ units[i] < math.cos(min(1.5 * bounds.reach, math.pi))
    return units[chosen]


def paying_pivots(units: np.ndarray, pivots: np.ndarray, n: int, bounds: Bounds) -> np.ndarray:
    """As many of the pivots as make copies and comparisons of ``n`` vectors cost least.

    ``units`` is a sample of these vectors, all of which are counted for the cells.
    """
    best = pivots[:0], math.inf
    size = 1
    while True:
        some = pivots[:size]
        own, (low, high) = np.zeros((len(some), SHELLS)), (np.full((len(some), SHELLS), x) for x in (np.inf, -np.inf))
        parts = [units[k : k + CHUNK] for k in range(0, len(units), CHUNK)]
        placed = [bounds.homes(part, some) for part in parts]
        for _, angles, home, shell in placed:
            angle = angles[np.arange(home.size), home]
            for ufunc, table, value in ((np.add, own, 1), (np.minimum, low, angle), (np.maximum, high, angle)):
                ufunc.at(table, (home, shell), value)
        copies = met = 0.0
        for cosines, angles, home, shell in placed:
            may = bounds.candidates(cosines, angles, home, some, low, high) & (own > 0)
            core = shell == CORE
            may[np.arange(home.size)[core], home[core], CORE] = False
            copies += may.sum() + core.sum()
            met += float((may * own).sum())
        cost = COPY_COST * copies + MEET_COST * units.shape[1] * met * (n / len(units))
        if cost < best[1]:
            best = some, cost
        if size >= len(pivots):
            return best[0]
        size = min(2 * size, len(pivots))


def near_duplicates(
    vectors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cosine: float = COSINE,
    cell_bytes: int = CELL_BYTES,
    block_bytes: int = BLOCK_BYTES,
    pivot_bytes: int = PIVOT_BYTES,
) -> DataFrame:
    """(``vec_id``, ``n_links``, ``component_id``, ``kept``) of every row.

    Rows link when their labels are equal and not null and their vectors have a cosine of
    at least ``cosine`` (above 0, in doubles). ``component_id`` is the least id that
    links reach, ``kept`` whether it is the row's own. Vectors that are null, empty,
    zero, or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. A repeated row is a vector of its own that links with its copy.
    Null ids count for no component's least id; a component of only such rows has none,
    and its rows are kept. An empty table gives an empty result, and other columns are
    ignored, whatever their names. Ids must be integers.
    """
    bounds = Bounds(cosine)
    kind = vectors.schema[vector].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    rows = vectors.select(
        F.col(id).cast("bigint").alias("id"),
        F.concat_ws("|", F.col(label).cast("string"), F.size(vector)).alias("space"),
        F.col(vector).cast("array<float>" if single else "array<double>").alias("v"),
        F.col(label).isNull().alias("unlabelled"),
    ).withColumn("space", F.when(~F.col("unlabelled"), F.col("space"))).drop("unlabelled")

    sizes = rows.where(F.col("space").isNotNull()).groupBy("space", F.size("v").alias("size")).agg(F.count("*").alias("n"))
    def rows_in(size: int) -> F.Column:
        return F.greatest(F.lit(LEAST_ROWS), F.floor(F.lit(size) / (8 * F.col("size"))))

    large = stored(
        sizes.where((F.col("size") > 0) & (F.col("n") > rows_in(min(cell_bytes, block_bytes)))).select(
            "space", "size", "n",
            F.ceil(F.col("n") / rows_in(cell_bytes)).cast("int").alias("cells"),
            F.ceil(F.col("n") / rows_in(block_bytes)).cast("int").alias("blocks"),
        ),
        "spaces",
    )
    parts = rows.join(counted(large.select("space", "blocks"), _ROW_BYTES), "space", "left")
    pivots = _pivots(parts, large, bounds, pivot_bytes)
    cells = _cells(parts, pivots, bounds, block_bytes)
    found = stored(_joined(_dealt(parts, pivots, cells, bounds, single), bounds, single), "links")
    return _assembled(found)


def _pivots(parts: DataFrame, large: DataFrame, bounds: Bounds, pivot_bytes: int) -> dict[str, np.ndarray]:
    """Pivots of the largest labels, as far as ``pivot_bytes`` go; the others have none."""
    longest = large.agg(F.max("size")).first()[0]
    if not longest:
        return {}
    most = max(1, pivot_bytes // (8 * longest))
    chosen = large.orderBy(F.desc("n"), "space").limit(most).collect()
    share = min(1.0, most / sum(r.cells for r in chosen))
    wanted = {r.space: max(1, int(r.cells * share)) for r in chosen}
    rows_of = {r.space: r.n for r in chosen}
    rates = [(r.space, min(1.0, SAMPLE * (wanted[r.space] + 1) / r.n)) for r in chosen]
    drawn = F.broadcast(parts.sparkSession.createDataFrame(rates, "space string, rate double"))
    sample = parts.select("space", "v").join(drawn, "space").where(F.rand(7) < F.col("rate")).select("space", "v").toArrow()
    found = {}
    for space in wanted:
        column = sample.filter(pc.equal(sample["space"], space))["v"]
        units = [u for chunk in column.chunks for _, u in unit_rows(chunk) if len(u)]
        if units:
            drawn_units = np.concatenate(units)
            pivots = choose_pivots(drawn_units, wanted[space], bounds)
            found[space] = paying_pivots(drawn_units, pivots, rows_of[space], bounds)
    return found


def _by_space(space: pa.Array, vector: pa.Array) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(label and length, rows, their unit vectors) of the rows that can link at all."""
    names = pc.dictionary_encode(space)
    codes = pc.fill_null(names.indices, -1).to_numpy(zero_copy_only=False)
    for rows, units in unit_rows(vector):
        for code in np.unique(codes[rows]):
            if code >= 0:
                own = codes[rows] == code
                yield names.dictionary[int(code)].as_py(), rows[own], units[own]


def _cells(parts: DataFrame, pivots: dict, bounds: Bounds, block_bytes: int) -> dict[str, Cells]:
    """The cells of each space with pivots."""
    shared = parts.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_pivots = shared.value
        sums = {s: _no_cells(len(p)) for s, p in all_pivots.items()}
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                for space, _, units in _by_space(*whole.slice(start, CHUNK).columns):
                    if space in all_pivots:
                        _, angles, home, shell = bounds.homes(units, all_pivots[space])
                        angle = angles[np.arange(home.size), home]
                        for ufunc, table, value in zip((np.add, np.minimum, np.maximum), sums[space], (1, angle, angle)):
                            ufunc.at(table, (home, shell), value)
        out = [(s, p, h, *(x[p, h] for x in own)) for s, own in sums.items() for p, h in zip(*np.nonzero(own[0]))]
        names = ["space", "pivot", "shell", "n", "low", "high"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)

    if not pivots:
        return {}
    counts = parts.where(F.col("blocks").isNotNull()).select("space", "v").mapInArrow(
        run, "space string, pivot int, shell int, n bigint, low double, high double"
    )
    summed = counts.groupBy("space", "pivot", "shell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    cells = {s: _no_cells(len(p)) for s, p in pivots.items()}
    for r in summed.collect():
        blocks = -(-r.n // max(LEAST_ROWS, block_bytes // (8 * pivots[r.space].shape[1])))
        for table, value in zip(cells[r.space], (blocks, r.low, r.high)):
            table[r.pivot, r.shell] = value
    return cells


def _no_cells(pivots: int) -> Cells:
    shape = (pivots, SHELLS)
    return np.zeros(shape, dtype=np.int64), np.full(shape, np.inf), np.full(shape, -np.inf)


def _dealt(parts: DataFrame, pivots: dict, cells: dict, bounds: Bounds, single: bool) -> DataFrame:
    """Each row once to its home's block, and to every block where it may have partners."""
    shared = parts.sparkSession.sparkContext.broadcast((pivots, cells))
    kind = np.dtype("<f4" if single else "<f8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                yield from deal(whole.slice(start, CHUNK))

    def deal(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        all_pivots, all_cells = shared.value
        ids, spaces, most = (batch.column(i).to_pylist() for i in (0, 1, 3))
        vectors, n = batch.column(2), batch.num_rows
        offsets, values = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False).astype(kind)
        raw, node = [None] * n, [b""] * n
        places = list(_by_space(batch.column(1), vectors))
        for r in (r for _, rows, _ in places for r in rows):
            raw[r] = values[offsets[r] : offsets[r + 1]].tobytes()
        for r in range(n):
            key = b"\0".join((str(ids[r]).encode(), str(spaces[r]).encode(), raw[r] or b""))
            node[r] = hashlib.blake2b(key, digest_size=16).digest()
        dice = np.array([int.from_bytes(x[:6], "big") for x in node], dtype=np.int64)
        names, dealt = [""], []  # dealt: cell, block, whether home, shell, row

        def to_blocks(cell, home, shell, rows, blocks, own):
            """Rows to all blocks of a cell but their own, or only to their own as homes."""
            if home:
                dealt.append((cell, own, np.full(rows.size, True), shell, rows))
                return
            at = np.repeat(np.arange(rows.size), blocks)
            block = np.arange(at.size) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            others = block != own[at]
            at = at[others]
            dealt.append((cell[at], block[others], np.full(at.size, False), shell[at], rows[at]))

        alone = np.array([r for r in range(n) if raw[r] is None], dtype=np.int64)
        to_blocks(np.zeros_like(alone), True, np.full(alone.size, ALONE), alone, None, dice[alone] % (1 << 20))
        for space, rows, units in places:
            if space not in all_pivots:
                names.append(f":{space}")
                blocks = np.array([most[r] or 1 for r in rows], dtype=np.int64)
                cell, shell, own = np.full(rows.size, len(names) - 1), np.full(rows.size, WHOLE), dice[rows] % blocks
                to_blocks(cell, True, shell, rows, blocks, own)
                to_blocks(cell, False, shell, rows, blocks, own)
                continue
            own_pivots, (blocks, low, high) = all_pivots[space], all_cells[space]
            first = len(names)
            names += [f"{p}.{h}:{space}" for p in range(len(own_pivots)) for h in range(SHELLS)]
            cosines, angles, home, shell = bounds.homes(units, own_pivots)
            for k in np.flatnonzero(shell == CORE):
                node[rows[k]] = hashlib.blake2b(names[first + home[k] * SHELLS].encode(), digest_size=16).digest()
            mine = dice[rows] % blocks[home, shell]
            to_blocks(first + home * SHELLS + shell, True, shell, rows, None, mine)
            may = bounds.candidates(cosines, angles, home, own_pivots, low, high) & (blocks > 0)
            may[np.arange(rows.size)[shell == CORE], home[shell == CORE], CORE] = False
            k, p, h = np.nonzero(may)
            own = np.where((p == home[k]) & (h == shell[k]), mine[k], -1)
            to_blocks(first + p * SHELLS + h, False, h, rows[k], blocks[p, h], own)
        cell, block, home, shell, row = (np.concatenate(x) for x in zip(*dealt))
        nodes, raws, of = pa.array(node, pa.binary()), pa.array(raw, pa.binary()), pa.array(names)
        for k in range(0, row.size, 16 * CHUNK):
            at = pa.array(row[k : k + 16 * CHUNK])
            part = slice(k, k + 16 * CHUNK)
            yield pa.RecordBatch.from_arrays(
                [of.take(pa.array(cell[part])), pa.array(block[part]), pa.array(home[part]), pa.array(shell[part].astype(np.int32)),
                 batch.column(0).take(at), nodes.take(at), raws.take(at)],
                names=["cell", "block", "home", "shell", "id", "node", "raw"],
            )

    return parts.select("id", "space", "v", "blocks").mapInArrow(
        run, "cell string, block bigint, home boolean, shell int, id bigint, node binary, raw binary"
    )


class Block:
    """Own vectors of one block of a cell, and what their partners tell about them."""

    def __init__(self, shell: int, cosine: float):
        self.core, self.cosine = shell == CORE, cosine
        self.ids, self.nodes, self.vectors = [], [], []
        self.own = None
        self.edges: set[tuple[bytes, bytes]] = set()

    def seal(self) -> None:
        """All own vectors are known: compare them, unless they are a core."""
        self.own = np.concatenate(self.vectors)
        self.links = np.zeros(len(self.own), dtype=np.int64)
        self.root = np.arange(len(self.own))
        if not self.core:
            for k in range(0, len(self.own), CHUNK):
                self._meet(self.own[k : k + CHUNK])
            self.links -= 1  # itself

    def meet(self, vectors: np.ndarray, nodes: list[bytes]) -> None:
        """Compare vectors of other homes and blocks."""
        for j, i in self._meet(vectors):
            self._link(nodes[j], self.nodes[i])

    def _meet(self, vectors: np.ndarray) -> list[tuple[int, int]]:
        """(vector, an own vector it links with) of those that link."""
        near = self.own @ vectors.T >= self.cosine
        self.links += near.sum(axis=1)
        found = []
        for j in np.flatnonzero(near.any(axis=0)):
            at = np.flatnonzero(near[:, j])
            found.append((int(j), int(at[0])))
            roots = self.root[at]
            if not self.core and roots.min() != roots.max():
                self.root[np.isin(self.root, roots)] = roots.min()
        return found

    def _link(self, a: bytes, b: bytes) -> None:
        if a != b:
            self.edges.add((a, b))

    def result(self) -> pa.RecordBatch:
        """A row for each own vector, then the links that join components."""
        if self.own is None:
            self.seal()
        if not self.core:
            for i in np.flatnonzero(self.root != np.arange(self.root.size)):
                self._link(self.nodes[i], self.nodes[self.root[i]])
        return _found(self.ids, self.nodes, self.core, self.links.tolist(), list(self.edges))


def _found(ids: list, nodes: list, core: bool, links: list, edges: list) -> pa.RecordBatch:
    no, none = [None] * len(edges), [None] * len(ids)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids + no, pa.int64()),
            pa.array(nodes + no, pa.binary()),
            pa.array([core] * len(ids) + no, pa.bool_()),
            pa.array(links + no, pa.int64()),
            pa.array(none + [x[0] for x in edges], pa.binary()),
            pa.array(none + [x[1] for x in edges], pa.binary()),
        ],
        names=["id", "node", "core", "links", "a", "b"],
    )


def _joined(dealt: DataFrame, bounds: Bounds, single: bool) -> DataFrame:
    """Rows (``id``, ``node``, ``core``, ``links``) and links (``a``, ``b``) of nodes.

    The vectors of a core are one node, all others one each. Links of a core's vectors
    with each other are not counted yet.
    """
    kind = np.dtype("<f4" if single else "<f8")
    ordered = dealt.repartition("cell", "block").sortWithinPartitions("cell", "block", F.desc("home"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, block = None, None
        for batch in batches:
            cells, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            homes = batch.column(2).to_numpy(zero_copy_only=False)
            keys = list(zip(cells, blocks, homes))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for start, end in zip(cuts, cuts[1:]):
                if end == start:
                    continue
                part = batch.slice(start, end - start)
                shell = part.column(3)[0].as_py()
                ids, nodes = part.column(4).to_pylist(), part.column(5).to_pylist()
                if shell == ALONE:
                    yield _found(ids, nodes, False, [0] * len(ids), [])
                    continue
                if keys[start][:2] != place:
                    if block is not None:
                        yield block.result()
                    place, block = keys[start][:2], None
                if block is None and homes[start]:
                    block = Block(shell, bounds.cosine)
                for k in range(0, end - start, CHUNK if block is not None else end - start):
                    some = part.column(6).slice(k, CHUNK)
                    if block is None:  # nobody is at home here
                        break
                    units = _units(some, kind)
                    if homes[start]:
                        block.ids += ids[k : k + CHUNK]
                        block.nodes += nodes[k : k + CHUNK]
                        block.vectors.append(units)
                    else:
                        if block.own is None:
                            block.seal()
                        block.meet(units, nodes[k : k + CHUNK])
        if block is not None:
            yield block.result()

    return ordered.mapInArrow(run, "id bigint, node binary, core boolean, links bigint, a binary, b binary")


def _units(raw: pa.Array, kind: np.dtype) -> np.ndarray:
    """Vectors of one length from their bytes; all of them are valid."""
    found = np.frombuffer(b"".join(raw.to_pylist()), kind).reshape(len(raw), -1).astype(np.float64)
    found /= np.abs(found).max(axis=1)[:, None]
    return found / np.linalg.norm(found, axis=1)[:, None]


def _assembled(found: DataFrame) -> DataFrame:
    """Names of components, and the links within cores."""
    rows = found.where(F.col("a").isNull()).select("id", "node", "core", "links")
    roots = components(found.where(F.col("a").isNotNull()).select("a", "b"))
    linked = F.col("core") | (F.col("links") > 0)
    nodes = rows.where(linked).groupBy("node", "core").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    named = nodes.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("node", "core", "n", "component_id")
    # Cores are as many as pivots at most, and those have a bound in bytes.
    cores = F.broadcast(named.where("core").drop("core"))
    others = named.where(~F.col("core")).select("node", "component_id")
    parts = (
        rows.where("core").join(cores, "node").select("id", (F.col("links") + F.col("n") - 1).alias("n"), "component_id"),
        rows.where(~F.col("core") & linked).join(others, "node").select("id", F.col("links").alias("n"), "component_id"),
        rows.where(~linked).select("id", F.col("links").alias("n"), F.col("id").alias("component_id")),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(
        F.col("id").alias("vec_id"),
        F.col("n").alias("n_links"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
