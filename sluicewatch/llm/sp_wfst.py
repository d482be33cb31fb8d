"""SentencePiece encoding and decoding by weighted finite-state transduction.

Three machines are compiled from a model file. The normaliser puts the dummy blank in
front and maps blanks to their mark. The lexicon, a trie, reads the characters of a
piece and writes its id. Byte fallback reads a character that no piece can begin a
segmentation of and writes its bytes' ids. They are composed with each input on the fly,
and the path of least weight in the tropical semiring is the encoding.

Weights: of a unigram model each piece costs its negative score. A byte-pair model has
no additive scores: its merges are expressed by an acceptor over neighbouring pieces,
of weight 0 where merging the two pieces' characters gives these two pieces again, and
infinite otherwise. Under it one path of finite weight is left, the merged encoding.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from sluicewatch.llm.arrow_rows import Compute, apart, with_results

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words that a worker remembers; parts of words, and pairs of pieces.
REMEMBERED = 1 << 18
REMEMBERED_PARTS = 3 << 17
#: Text encoded at a time.
CHUNK_BYTES = 2 << 20
#: Characters of words composed in one batch; longer words than LONG are composed alone.
BATCH_CHARS = 1 << 18
LONG = 1 << 10
#: The acceptor keeps 2 ** NEIGHBOUR_BITS verdicts in arrays.
NEIGHBOUR_BITS = 20


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and values of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


class Model:
    """Pieces, scores and settings of a model file.

    Refuses what the machines don't cover: a character map for normalisation, removal
    of extra blanks, user-defined pieces, and model types other than unigram and BPE.
    """

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.type, self.dummy_prefix, self.escape = UNIGRAM, True, True
        extra_removed, char_map = True, b""
        for number, value in _fields(data):
            if number == 1:
                piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0])
                self.kinds.append(piece[3])
            elif number == 2:
                self.type = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                char_map, self.dummy_prefix = spec.get(2, b""), bool(spec.get(3, 1))
                extra_removed, self.escape = bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if char_map or extra_removed or not self.escape or self.type not in (UNIGRAM, BPE) or USER_DEFINED in self.kinds:
            raise ValueError("only models with identity normalisation and without user-defined pieces")


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _spread(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(64 - bits)).astype(np.int64)


class _Arcs:
    """Numbers by key, both not negative; looked up for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * keys.size).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.bits, dtype=np.int64)
        at = _spread(keys, self.bits)
        while keys.size:
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several for one place the last one stays
            here = self.keys[at] == keys
            self.values[at[here]] = values[here]
            keys, values, at = keys[~here], values[~here], (at[~here] + 1) & (self.keys.size - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers, -1 for others."""
        out = np.full(keys.size, -1, dtype=np.int64)
        left, at = np.arange(keys.size), _spread(keys, self.bits)
        while left.size:
            there = self.keys[at]
            here = there == keys
            out[left[here]] = self.values[at[here]]
            on = ~here & (there >= 0)
            left, keys, at = left[on], keys[on], (at[on] + 1) & (self.keys.size - 1)
        return out


class Transducer:
    """The compiled machines of a model."""

    def __init__(self, model: Model):
        self.model = model
        self.bpe = model.type == BPE
        self.unknown = next((i for i, k in enumerate(model.kinds) if k == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == BYTE}
        self.id_of = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == NORMAL}
        self.lexicon: dict = {}
        for piece, number in self.id_of.items():
            state = self.lexicon
            for c in piece:
                state = state.setdefault(c, {})
            state[""] = number
        # No arc leads over two characters that stand together in no piece: an input
        # falls apart there, and its parts are composed one by one.
        self.joined = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        self.by_word = not any(c[1] == MARK != c[0] for c in self.joined)
        self.least = min((model.scores[i] for i in self.id_of.values()), default=0.0)
        self._agree: dict[int, bool] = {}
        self._edges: dict[int, tuple] = {}
        self._paths: dict[str, tuple[int, ...]] = {}
        self._compile()

    def _compile(self) -> None:
        """The lexicon and the pairs that stand together as arrays."""
        letters = sorted({c for p in self.id_of for c in p})
        self._width = len(letters) + 1
        number = {c: i for i, c in enumerate(letters, 1)}
        self._letter = np.zeros(0x110000, dtype=np.int32)  # 0: in no piece
        self._letter[[ord(c) for c in letters]] = range(1, self._width)
        states, pieces, keys = [self.lexicon], [], []
        for at, state in enumerate(states):  # grows by what follows its states
            pieces.append(state.get("", -1))
            for c, after in state.items():
                if c:
                    keys.append(at * self._width + number[c])
                    states.append(after)
        self._piece_at = np.array(pieces, dtype=np.int64)
        self._follows = _Arcs(np.array(keys, dtype=np.int64), np.arange(1, len(states)))
        pairs = [number[x[0]] * self._width + number[x[1]] for x in self.joined]
        self._joins = _Arcs(np.array(pairs, dtype=np.int64), np.zeros(len(pairs), dtype=np.int64))
        self._pair = np.full(1 << NEIGHBOUR_BITS, -1, dtype=np.int64)
        self._verdict = np.zeros(1 << NEIGHBOUR_BITS, dtype=bool)

    def normalised(self, text: str) -> str:
        if not text:
            return ""
        return ((" " if self.model.dummy_prefix else "") + text).replace(" ", MARK)

    def merged(self, text: str, seen: list | None = None) -> list[str]:
        """Characters merged by score, best first, leftmost of equals; ``seen`` gets every state."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                number = self.id_of.get(parts[i] + parts[i + 1])
                if number is not None and (best is None or self.model.scores[number] > best):
                    best, at = self.model.scores[number], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if seen is not None:
                seen.append((best, parts[0], parts[-1]))
        return parts

    def edges(self, piece: int) -> tuple:
        """How a piece's first and last parts grow while its characters are merged.

        (merges to itself, first parts, last parts, whether scores only fall); parts as
        (score, text), the single character with an infinite score.
        """
        known = self._edges.get(piece)
        if known is None:
            text, seen = self.model.pieces[piece], []
            whole = self.merged(text, seen) == [text]
            first, last = [(float("inf"), text[0])], [(float("inf"), text[-1])]
            for score, left, right in seen:
                if left != first[-1][1]:
                    first.append((score, left))
                if right != last[-1][1]:
                    last.append((score, right))
            falls = all(x[0] > y[0] for x, y in zip(seen, seen[1:]))
            known = self._edges[piece] = whole, first, last, falls
        return known

    def _agreeing(self, before: int, piece: int) -> bool:
        """Whether merging the characters of two pieces gives the two pieces.

        Follows the last parts of one and the first parts of the other as they grow;
        they part company where the pair at the border merges first. Where scores don't
        fall all the way, the characters are merged outright.
        """
        _, _, ends, falls = self.edges(before)
        _, starts, _, falls_too = self.edges(piece)
        if not (falls and falls_too):
            a, b = self.model.pieces[before], self.model.pieces[piece]
            return self.merged(a + b) == [a, b]
        i = j = 0
        lowest = float("-inf")
        while True:
            number = self.id_of.get(ends[i][1] + starts[j][1])
            next_end = ends[i + 1][0] if i + 1 < len(ends) else lowest
            next_start = starts[j + 1][0] if j + 1 < len(starts) else lowest
            if number is not None:
                border = self.model.scores[number]
                if border > next_end and border >= next_start:
                    return False
            if next_end == next_start == lowest:
                return True
            if next_end >= next_start:
                i += 1
            else:
                j += 1

    def allowed(self, before: int, piece: int) -> bool:
        """The acceptor of neighbours: -1 is the beginning or a fallen back character."""
        if before < 0:
            return self.edges(piece)[0]
        key = before << 32 | piece
        known = self._agree.get(key)
        if known is None:
            if len(self._agree) > REMEMBERED_PARTS:
                self._agree.clear()
            known = self._agree[key] = self._agreeing(before, piece)
        return known

    def _all_allowed(self, before: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """``allowed`` of many neighbours; of verdicts that share a place the latest is kept."""
        every = len(self.model.pieces)
        keys = np.where(before < 0, every, before) * every + pieces
        at = _spread(keys, NEIGHBOUR_BITS)
        verdicts = self._verdict[at]
        new = np.flatnonzero(self._pair[at] != keys)
        if new.size:
            unknown, where = np.unique(keys[new], return_inverse=True)
            found = np.fromiter(
                (self.edges(k % every)[0] if k // every == every else self._agreeing(k // every, k % every) for k in unknown.tolist()),
                bool,
                unknown.size,
            )
            places = _spread(unknown, NEIGHBOUR_BITS)
            self._pair[places] = unknown
            kept = self._pair[places] == unknown
            self._verdict[places[kept]] = found[kept]
            verdicts[new] = found[where]
        return verdicts

    def fallback(self, c: str) -> list[int]:
        data = c.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in data] if all(b in self.bytes for b in data) else [self.unknown]

    def shortest(self, text: str) -> list[int]:
        """Ids of the least path for normalised text."""
        return (self._shortest_bpe if self.bpe else self._shortest_scored)(text)

    def _shortest_scored(self, text: str) -> list[int]:
        """Least sum of weights; of equal ones the path with the shorter last piece."""
        weights = [float("inf")] * (len(text) + 1)
        back: list[tuple[int, int]] = [(-1, -1)] * (len(text) + 1)
        weights[0] = 0.0
        for i in range(len(text)):
            state, end, single = self.lexicon, i, False
            while end < len(text) and (state := state.get(text[end])) is not None:
                end += 1
                piece = state.get("")
                if piece is None:
                    continue
                single |= end == i + 1
                total = weights[i] - self.model.scores[piece]
                if total <= weights[end]:
                    weights[end], back[end] = total, (i, piece)
            if not single and weights[i] + 10.0 - self.least <= weights[i + 1]:
                weights[i + 1], back[i + 1] = weights[i] + 10.0 - self.least, (i, -1)
        return self._traced(text, back)

    def _shortest_bpe(self, text: str) -> list[int]:
        """The path of finite weight, by depth-first search, longer pieces first.

        Any two neighbours on a path agree, so each position is reached by one path at
        most, that of the text before it; a position without a way on is never tried
        again.
        """
        size, lexicon, agree, allowed = len(text), self.lexicon, self._agree, self.allowed
        dead = bytearray(size + 1)
        path: list[tuple[int, int, list]] = []  # position, last piece there, ways not yet tried
        at, last, found = 0, -1, None
        while at < size:
            if found is None:
                state, end, found = lexicon, at, []
                while end < size and (state := state.get(text[end])) is not None:
                    end += 1
                    if "" in state:
                        found.append((end, state[""]))
                if not found or found[0][0] > at + 1:
                    found.insert(0, (at + 1, -1))
            while found:
                end, piece = found.pop()
                if dead[end]:
                    continue
                if piece < 0:
                    break
                known = agree.get(last << 32 | piece) if last >= 0 else None
                if known or (known is None and allowed(last, piece)):
                    break
            else:
                if not path:
                    raise ValueError("no path of finite weight")
                dead[at] = 1
                at, last, found = path.pop()
                continue
            path.append((at, last, found))
            at, last, found = end, piece, None
        pieces = [*(p for _, p, _ in path[1:]), last] if path else []
        out: list[int] = []
        for (start, _, _), piece in zip(path, pieces):
            if piece >= 0:
                out.append(piece)
            else:
                out += self.fallback(text[start])
        return out

    def _traced(self, text: str, back: list) -> list[int]:
        out: list[list[int]] = []
        at = len(text)
        while at:
            start, piece = back[at]
            out.append([piece] if piece >= 0 else self.fallback(text[start]))
            at = start
        return [x for part in reversed(out) for x in part]

    def encoded(self, word: str) -> list[int]:
        """Ids of a part of normalised text, cut where no piece leads across."""
        joined, start, out = self.joined, 0, []
        for end in range(1, len(word) + 1):
            if end == len(word) or word[end - 1 : end + 1] not in joined:
                part = word[start:end]
                ids = self._paths.get(part)
                if ids is None:
                    if len(self._paths) > REMEMBERED_PARTS:
                        self._paths.clear()
                    ids = self._paths[part] = tuple(self.shortest(part))
                out += ids
                start = end
        return out

    def all_encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has; batches of words are composed at once."""
        ids, sizes, batch, chars = [], [], [], 0

        def done() -> None:
            if batch:
                got, counts = self._batch(batch)
                ids.append(got)
                sizes.append(counts)
                batch.clear()

        for word in words:
            if not self.bpe or len(word) > LONG:
                done()
                own = self.encoded(word)
                ids.append(np.array(own, dtype=np.int32))
                sizes.append(np.array([len(own)], dtype=np.int64))
                chars = 0
                continue
            batch.append(word)
            chars += len(word)
            if chars >= BATCH_CHARS:
                done()
                chars = 0
        done()
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([none.astype(np.int32), *ids]), np.concatenate([none, *sizes])

    def _batch(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``encoded`` of many words: ``_shortest_bpe`` of all their parts, step by step at once.

        A part has a place before each of its characters and one behind the last.
        """
        text = "".join(words)
        letters = self._letter[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        cut = np.ones(letters.size, dtype=bool)
        cut[1:] = self._joins.get(letters[:-1] * self._width + letters[1:]) < 0
        cut[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        part = np.cumsum(cut) - 1
        place = np.arange(letters.size) + part
        first = np.flatnonzero(cut)
        begins = place[first]
        ends = np.append(first[1:], letters.size) + np.arange(first.size)

        # Ways on from each character: longer pieces first, falling back last.
        here, state, levels, depth = np.arange(letters.size), np.zeros(letters.size, dtype=np.int64), [], 0
        single = np.zeros(letters.size, dtype=bool)
        while here.size:
            state = self._follows.get(state * self._width + letters[here + depth])
            here, state = here[state >= 0], state[state >= 0]
            depth += 1
            pieces = self._piece_at[state]
            levels.append((here[pieces >= 0], np.full(int((pieces >= 0).sum()), depth), pieces[pieces >= 0]))
            if depth == 1:
                single[levels[0][0]] = True
            inside = here + depth < letters.size
            inside[inside] = ~cut[here[inside] + depth]
            here, state = here[inside], state[inside]
        alone = np.flatnonzero(~single)
        levels.insert(0, (alone, np.ones(alone.size, dtype=np.int64), np.full(alone.size, -1)))
        origin, width, piece = (np.concatenate(x) for x in zip(*reversed(levels)))
        order = np.argsort(origin, kind="stable")
        origin, piece, target = origin[order], piece[order], (place[origin] + width)[order]
        counts = np.zeros(letters.size + first.size, dtype=np.int64)
        counts[place] = np.bincount(origin, minlength=letters.size)
        limit = np.cumsum(counts)
        start = limit - counts

        untried, dead = start.copy(), np.zeros(start.size, dtype=bool)
        last, before = np.full(start.size, -1, dtype=np.int64), np.full(start.size, -1, dtype=np.int64)
        at, end = begins, ends
        while at.size:
            way = untried[at]
            stuck = way >= limit[at]
            if stuck.any():
                dead[at[stuck]] = True
                back = before[at[stuck]]
                if (back < 0).any():
                    raise ValueError("no path of finite weight")
                at = at.copy()
                at[stuck] = back
            going = np.flatnonzero(~stuck)
            origin, way = at[going], way[going]
            untried[origin] += 1
            to, by = target[way], piece[way]
            open_ = ~dead[to]
            asked = np.flatnonzero(open_ & (by >= 0))
            open_[asked] = self._all_allowed(last[origin[asked]], by[asked])
            origin, to, by, going = origin[open_], to[open_], by[open_], going[open_]
            before[to], last[to], untried[to] = origin, by, start[to]
            at = at.copy()
            at[going] = to
            on = at != end
            at, end = at[on], end[on]

        chosen = np.zeros(start.size, dtype=bool)
        at = ends
        while at.size:
            chosen[at] = True
            at = before[at]
            at = at[before[at] >= 0]
        to = np.flatnonzero(chosen)
        ids = last[to].astype(np.int32)
        word = np.repeat(np.arange(len(words)), lengths)
        origin = before[to] - np.searchsorted(begins, before[to], side="right") + 1
        of = word[origin]
        fallen = np.flatnonzero(ids < 0)
        if fallen.size:
            got = [self.fallback(text[i]) for i in origin[fallen]]
            times = np.ones(ids.size, dtype=np.int64)
            times[fallen] = [len(g) for g in got]
            ids, of, fell = np.repeat(ids, times), np.repeat(of, times), np.repeat(ids < 0, times)
            ids[fell] = [x for g in got for x in g]
        return ids, np.bincount(of, minlength=len(words))

    def words(self, text: str) -> list[str]:
        line = self.normalised(text)
        return _WORDS.findall(line) if self.by_word else [line] if line else []


_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Encoder:
    """Ids of texts; distinct words are composed once while they are remembered."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.machine = Transducer(Model(file.read()))
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(0, dtype=np.int32)
        self.offsets = np.zeros(1, dtype=np.int64)

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the texts' offsets in them."""
        if len(self.place) > REMEMBERED:
            self._forget()
        words = [self.machine.words(t.decode("utf-8", "replace")) if t else [] for t in texts]
        flat = [w for ws in words for w in ws]
        new = list({w for w in flat if w not in self.place})
        learned, lengths = self.machine.all_encoded(new)
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.ids = np.concatenate([self.ids, learned])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
        places = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        sizes = self.offsets[places + 1] - self.offsets[places]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(int(ends[-1])) + np.repeat(self.offsets[places] - ends[:-1], sizes)
        counts = np.cumsum([0, *(len(w) for w in words)])
        return self.ids[at], ends[counts]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One encoder per worker: what it remembers outlives a task."""
    return Encoder(path)


class Decoder:
    """Texts of ids: pieces joined, marks to blanks, byte pieces to characters."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            model = Model(file.read())
        self.prefix = model.dummy_prefix
        self.out = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL
            else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode()
            for p, k in zip(model.pieces, model.kinds)
        ]

    def __call__(self, ids: list[int]) -> bytes:
        """UTF-8 text; the dummy blank is taken off again, bad bytes become U+FFFD."""
        data = b"".join(map(self.out.__getitem__, ids))
        data = data.decode("utf-8", "replace").encode()
        return data[1:] if self.prefix and data[:1] == b" " else data


ENCODED = StructType([StructField("piece_ids", ArrayType(IntegerType()))])


def encode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``piece_ids`` of the whole text. Null and empty texts have none.

    Texts of any length are encoded whole, repeated rows each on its own, and of paths of
    equal weight the one with the shorter last piece is taken. An empty table gives an
    empty result. Columns named like results give way to them. ``model_path`` must lead to
    the model on every machine.
    """

    def make() -> Compute:
        encoder = _encoder(model_path)

        def compute(texts: list) -> list[pa.Array]:
            ids, bounds = encoder(texts)
            return [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))]

        return compute

    return with_results(docs, text, ENCODED, make, CHUNK_BYTES)


def decode(encoded: DataFrame, model_path: str, ids: str = "piece_ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ids; null ids give null.

    A mark that stood in a text itself comes back as a blank. No ids are an empty text.
    """
    kept = apart(encoded.columns, ["decoded"])
    rows = encoded.select(*(f"`{c}`" for c in kept)).toDF(*(f"c{i}" for i in range(len(kept))))
    at, names = kept.index(ids), [*rows.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model_path)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [None if x is None else decoder(x) for x in part.column(at).to_pylist()]
                made = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=names)

    out = rows.mapInArrow(run, StructType([*rows.schema, StructField("decoded", StringType())]))
    return out.toDF(*kept, "decoded")


def digests(encoded: DataFrame, model_path: str, ids: str = "piece_ids") -> DataFrame:
    """``encoded`` with, in place of its ids, ``n_pieces``, ``ids_crc32`` (of the ids as
    little-endian 32-bit integers), and ``decoded_sha256`` of the decoded text.
    """
    kept = apart(encoded.columns, [ids, "n_pieces", "ids_crc32", "decoded_sha256"])
    rows = encoded.select(F.col(ids), *(F.col(f"`{c}`") for c in kept))
    rows = rows.toDF("ids", *(f"c{i}" for i in range(len(kept))))
    others = rows.columns[1:]
    made = StructType([StructField("n", LongType()), StructField("crc", LongType()), StructField("sha", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model_path)
        for batch in batches:
            lists = batch.column(0)
            values = np.asarray(lists.values).astype("<u4")
            bounds = lists.offsets.to_numpy()
            spans = [values[a:b] for a, b in zip(bounds, bounds[1:])]
            results = [
                pa.array(np.diff(bounds).astype(np.int64)),
                pa.array([zlib.crc32(x) for x in spans], pa.int64()),
                pa.array([hashlib.sha256(decoder(x.tolist())).hexdigest() for x in spans], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *results], names=[*others, *made.names])

    out = rows.mapInArrow(run, StructType([*rows.schema.fields[1:], *made.fields]))
    return out.toDF(*kept, "n_pieces", "ids_crc32", "decoded_sha256")
