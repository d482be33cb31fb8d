"""Ranked search of many items at once, with the sums that items share computed once.

Terms are maximal runs of ASCII digits and letters and non-ASCII characters, A-Z
lower-cased. A first scan counts documents, terms and the document frequencies of the
items' terms; a second one scores every document against every item.

Items that ask for the same terms share the work. Terms that the same items hold form one
shared term set; its partial sum per document is materialised once. Pairs of sums that
several items need are mined round by round and become nodes of a graph, each the sum of
two others, so that a document's partial sums flow along the graph and an item adds up
what is left of its own. Every task keeps the best ``k`` documents of each item; these
meet in two windows, so that no task gets more than ``k`` rows of each of the others.

Rules: null and empty texts have no terms and are never found; texts are scored whole,
however long. Documents with equal scores are ranked by ascending id, null ids last;
a repeated document takes a rank for each of its rows, and an item that occurs twice is
ranked twice. Items without terms, and empty tables, give no rows. Other columns are
ignored, whatever their names. Scores are 64-bit integers, as are ``50 n N``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sluicewatch.llm.arrow_rows import slices, texts_of
from sluicewatch.llm.suffix_arrays import words

TOP = 50
#: Item terms that one pass over the documents searches for; more items take more passes.
BLOCK_TERMS = 1 << 18
#: Accumulators of a batch of documents, in numbers.
BATCH_SUMS = 1 << 22
#: Candidates that a task holds before it goes back to the best of each item.
HELD_ROWS = 1 << 18

_DOCUMENTS, _TERMS = -1, -2


class SharedSums:
    """Items as sums over a graph of partial sums that they share.

    ``leaf_of`` gives the leaf of each term, ``levels`` the inner nodes as (node, left,
    right) arrays in an order in which they can be added up, and ``operands`` with
    ``starts`` the nodes whose sums make up each item.
    """

    def __init__(self, items: list[list[int]], n_terms: int):
        holders: list[list[int]] = [[] for _ in range(n_terms)]
        for i, terms in enumerate(items):
            for t in terms:
                holders[t].append(i)
        # Terms held by the same items are one shared set.
        sets: dict[tuple[int, ...], int] = {}
        self.leaf_of = np.array([sets.setdefault(tuple(h), len(sets)) for h in holders], dtype=np.int64)
        self.n_leaves = len(sets)
        sums = [sorted({int(self.leaf_of[t]) for t in terms}) for terms in items]
        made: dict[tuple[int, int], int] = {}
        while self._pair_up(sums, made):
            pass
        self.n_nodes = self.n_leaves + len(made)
        self.levels = self._levels(made)
        self.starts = np.cumsum([0, *(len(s) for s in sums)][:-1])
        self.operands = np.array([x for s in sums for x in s], dtype=np.int64)

    def _pair_up(self, sums: list[list[int]], made: dict[tuple[int, int], int]) -> bool:
        """One round: neighbours that several items have in common become nodes."""
        often = Counter(x for s in sums for x in s)
        for s in sums:
            s.sort(key=lambda x: (-often[x], x))
        pairs = Counter(p for s in sums for p in zip(s, s[1:]))
        taken: Counter = Counter()
        chosen = []
        for s in sums:
            places, k = [], 0
            while k + 1 < len(s):
                here, after = pairs[s[k], s[k + 1]], pairs[s[k + 1], s[k + 2]] if k + 2 < len(s) else 0
                if here > 1 and here >= after:
                    places.append(k)
                    taken[s[k], s[k + 1]] += 1
                    k += 2
                else:
                    k += 1
            chosen.append(places)
        for i, places in enumerate(chosen):
            s, out, k = sums[i], [], 0
            for place in places:
                pair = s[place], s[place + 1]
                out += s[k:place]
                if taken[pair] > 1:
                    out.append(made.setdefault(pair, self.n_leaves + len(made)))
                else:
                    out += pair
                k = place + 2
            sums[i] = out + s[k:]
        return any(n > 1 for n in taken.values())

    def _levels(self, made: dict[tuple[int, int], int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        depth = dict.fromkeys(range(self.n_leaves), 0)
        by_depth: dict[int, list[tuple[int, int, int]]] = {}
        for (a, b), node in made.items():  # operands of a node are older than it
            depth[node] = 1 + max(depth[a], depth[b])
            by_depth.setdefault(depth[node], []).append((node, a, b))
        return [tuple(np.array(x) for x in zip(*by_depth[d])) for d in sorted(by_depth)]

    def scores(self, document: np.ndarray, term: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` documents (a row per item) from the values of their terms."""
        sums = np.zeros((self.n_nodes, n), dtype=np.int64)
        np.add.at(sums, (self.leaf_of[term], document), value)
        for node, left, right in self.levels:
            sums[node] = sums[left] + sums[right]
        return np.add.reduceat(sums[self.operands], self.starts, axis=0)


class BestOfItems:
    """The best ``k`` (score, id) of each item so far, in bounded memory."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.least = np.ones(n_items, dtype=np.int64)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.least[:, None])
        self.held.append((item, scores[item, at], ids[at], known[at]))
        self.rows += item.size
        if self.rows > HELD_ROWS + 2 * self.k * self.least.size:
            self.best()

    def best(self) -> tuple[np.ndarray, ...]:
        """(item, score, id, id known), best first in each item."""
        none = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, bool))
        item, score, ids, known = (np.concatenate(c) for c in zip(none, *self.held))
        order = np.lexsort((ids, ~known, -score, item))
        item = item[order]
        rank = np.arange(item.size) - np.searchsorted(item, item)
        kept, full = rank < self.k, rank == self.k - 1
        self.least[item[full]] = score[order[full]]
        kept_rows = order[kept]
        out = item[kept], score[kept_rows], ids[kept_rows], known[kept_rows]
        self.held, self.rows = [out], kept_rows.size
        return out


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(``item_id``, ``rank``, ``doc_id``, ``score``): the ``k`` best documents of each item.

    With N documents that have terms, L terms in all of them, df documents of a term, tf
    its occurrences in a document and n that document's terms, a term weighs
    w = floor(1000 ln((2N + 2) / (2df + 1))), a document's length counts as
    m = 50 + 50 n N div L, and it scores the sum of w * (10**9 tf div (1000 tf + 20 m))
    over the item's distinct terms. Only scores above 0 are ranks.

    Items come to the driver in blocks of about ``block_terms`` terms, one at a time;
    each block takes two scans of the documents.
    """
    rows = docs.select(F.col(id).cast("bigint").alias("i"), F.col(text).cast("binary").alias("t"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("binary").alias("t"))
    found = [_search_block(rows, block, asked.schema, k) for block in _blocks(asked, block_terms)]
    none = asked.limit(0).selectExpr("item_id", "0 AS rank", "0L AS doc_id", "0L AS score")
    return reduce(DataFrame.unionByName, found, none) if found else none


def _blocks(asked: DataFrame, block_terms: int) -> Iterator[list[tuple]]:
    """Items as (item_id, distinct terms), in lists of about ``block_terms`` terms."""
    block, size = [], 0
    for row in asked.toLocalIterator():
        terms = sorted(set(words(None if row.t is None else bytes(row.t))))
        if terms:
            block.append((row.item_id, terms))
            size += len(terms)
        if size >= block_terms:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search_block(rows: DataFrame, block: list[tuple], schema, k: int) -> DataFrame:
    spark = rows.sparkSession
    number = {t: n for n, t in enumerate(sorted({t for _, terms in block for t in terms}))}
    terms = spark.sparkContext.broadcast(number)
    counted = _counts(rows, terms).groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r.term: r.n for r in counted.collect()}  # a row per term of the block
    n_docs, n_terms = counts.get(_DOCUMENTS, 0), counts.get(_TERMS, 0)
    weight = np.array(
        [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(number))],
        dtype=np.int64,
    )
    sums = SharedSums([[number[t] for t in own] for _, own in block], len(number))
    shared = spark.sparkContext.broadcast((weight, sums, n_docs, n_terms))
    scored = _scored(rows, terms, shared, len(block), k)
    # Each task has k rows of an item at most. They meet in groups first, then as one.
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    grouped = scored.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(groups)))
    for keys in (("item", "part"), ("item",)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        grouped = grouped.withColumn("rank", place).where(F.col("rank") <= k)
    named = StructType([StructField("item", IntegerType()), schema["item_id"]])
    names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], named)
    return grouped.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def _counts(rows: DataFrame, terms) -> DataFrame:
    """Per task (``term``, ``n``): documents of each term, and under negative numbers
    the documents that have terms and their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = terms.value
        found = np.zeros(len(number), dtype=np.int64)
        n_docs = n_terms = 0
        for batch in batches:
            for part in slices(batch, 0):
                for text in texts_of(part.column(0)):
                    own = words(text)
                    n_docs += bool(own)
                    n_terms += len(own)
                    known = number.keys() & set(own)
                    if known:
                        found[[number[t] for t in known]] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, [_DOCUMENTS, _TERMS]).astype(np.int32)), pa.array(np.append(found[at], [n_docs, n_terms]))],
            names=["term", "n"],
        )

    return rows.select("t").mapInArrow(run, "term int, n bigint")


def _scored(rows: DataFrame, terms, shared, n_items: int, k: int) -> DataFrame:
    """Per task the best ``k`` (``item``, ``doc_id``, ``score``) of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, (weight, sums, n_docs, n_terms) = terms.value, shared.value
        best = BestOfItems(n_items, k)
        most = max(1, BATCH_SUMS // (sums.n_nodes + sums.operands.size))

        def add(batch: list[tuple]) -> None:
            document = np.repeat(np.arange(len(batch)), [len(x[1]) for x in batch])
            term, times = (np.array([v for x in batch for v in x[j]], dtype=np.int64) for j in (1, 2))
            length = np.array([x[3] for x in batch], dtype=np.int64)
            m = 50 + 50 * length * n_docs // n_terms
            value = weight[term] * (1000000000 * times // (1000 * times + 20 * m[document]))
            ids = np.array([x[0] or 0 for x in batch], dtype=np.int64)
            known = np.array([x[0] is not None for x in batch], dtype=bool)
            best.add(sums.scores(document, term, value, len(batch)), ids, known)

        batch_of: list[tuple] = []
        for batch in batches:
            for part in slices(batch, 1):
                for i, text in zip(part.column(0).to_pylist(), texts_of(part.column(1))):
                    own = words(text)
                    times = Counter(own)
                    known = number.keys() & times.keys()
                    if known:
                        batch_of.append((i, [number[t] for t in known], [times[t] for t in known], len(own)))
                    if len(batch_of) >= most:
                        add(batch_of)
                        batch_of = []
        if batch_of:
            add(batch_of)
        item, score, ids, known = best.best()
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int32)), pa.array(ids, mask=~known), pa.array(score)],
            names=["item", "doc_id", "score"],
        )

    return rows.mapInArrow(run, "item int, doc_id bigint, score bigint")
