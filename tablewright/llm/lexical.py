"""Ranked lexical search of benchmark items over all documents, by branch and bound on FP-trees of documents.

Terms are runs of ASCII letters and digits and all other non-ASCII characters, A-Z lower-cased. A pass over the texts
writes, for every document, its length and the vector of the terms that some item holds (restricted term vector); the
number of documents N with a term, the number L of all terms and the documents df that hold a term are aggregates of that
table. A term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), and a document of n terms scores the sum of
w * ((10^9 tf) div (1000 tf + 20 m)) over an item's terms, with m = 50 + (50 n N) div L.

Each task puts its vectors, terms by falling frequency, into FP-trees: sorted, the vectors that share a path lie next to
each other, and a node is such a range. A node with more than ``LEAF_DOCS`` documents has one child a next term, a
child that holds more than half of it is replaced by its own children, and small neighbours share a leaf. A node
keeps the highest tf of every term below it and the lowest m, which bound the score of all its documents. For each item
the tree is searched depth first, best bound first, and a subtree is left out if its bound is below the item's 50th best
score so far; documents of the leaves are scored exactly. Best rows so far go on from tree to tree of a task, the best of
all tasks are ranked together.

Items are searched in blocks of bounded vocabulary (``BLOCK_TERMS``; an item with more terms is a block of its own).
Null and empty texts have no terms and are never found; items without terms find nothing. Equal scores rank by ascending
id, null ids last; rows with equal ids are documents, or items, of their own (each of the latter gives its rows). Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tablewright.llm.batches import pieces, small_batches
from tablewright.session import keep

TOP = 50
LEAF_DOCS = 32
#: Cells (documents times vocabulary) that a tree may have; terms of a block of items, repeats among items included.
TREE_CELLS, BLOCK_TERMS = 1 << 24, 1 << 15

SIGNS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, repeats included."""
    return (text or "").encode().lower().translate(SIGNS).split()


class Tree:
    """An FP-tree of documents: ``lo`` and ``hi`` (range of sorted rows), ``children`` and bounds of every node."""

    def __init__(self, offsets: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, rank: np.ndarray) -> None:
        """Vectors of ``term`` and ``tf`` between ``offsets``; ``rank``: place of each term by falling frequency."""
        n = len(m)
        owner = np.repeat(np.arange(n), np.diff(offsets))
        order = np.lexsort((rank[term], owner))
        keys = rank[term][order].astype(">u4").tobytes()
        paths = [keys[4 * i : 4 * j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        self.rows = np.array(sorted(range(n), key=paths.__getitem__), np.int64)
        self.paths = [paths[i] for i in self.rows.tolist()]
        sizes = np.diff(offsets)[self.rows]
        self.offsets = np.r_[0, np.cumsum(sizes)]
        take = np.arange(self.offsets[-1]) - np.repeat(self.offsets[:-1] - offsets[:-1][self.rows], sizes)
        self.term, self.tf, self.m = term[take], tf[take], m[self.rows]
        self.gain = 1_000_000_000 * self.tf // (1000 * self.tf + 20 * np.repeat(self.m, sizes))
        self.lo, self.hi, self.children = [0], [n], [[]]
        todo = [(0, 0)]
        while todo:
            node, depth = todo.pop()
            for lo, hi, below in self._parts(self.lo[node], self.hi[node], depth):
                self.lo.append(lo), self.hi.append(hi), self.children.append([])
                self.children[node].append(len(self.lo) - 1)
                if below is not None:
                    todo.append((len(self.lo) - 1, below))
        self._bound(len(rank))

    def _split(self, lo: int, hi: int, depth: int) -> tuple[list[tuple[int, int]], int]:
        """Ranges of rows [lo, hi) that go on with one term after their common path, and the length of that in bytes."""
        first, last = self.paths[lo], self.paths[hi - 1]
        while depth < len(first) and first[depth : depth + 4] == last[depth : depth + 4]:
            depth += 4
        out, start = [], lo
        while start < hi:
            step = self.paths[start][depth : depth + 4]
            low, high = start, hi
            while high - low > 1:  # the last row with the same step
                middle = (low + high) // 2
                low, high = (middle, high) if self.paths[middle][depth : depth + 4] == step else (low, middle)
            out.append((start, high))
            start = high
        return out, depth

    def _parts(self, lo: int, hi: int, depth: int) -> list[tuple[int, int, int | None]]:
        """Children of a node: their rows, and where their paths go on (none: a leaf)."""
        if hi - lo <= LEAF_DOCS:
            return []
        found: list[tuple[int, int, int | None]] = []
        open_ = [(lo, hi, depth)]
        while open_:
            start, stop, at = open_.pop()
            parts, at = self._split(start, stop, at)
            for a, b in parts:
                if len(parts) == 1 or at >= len(self.paths[a]):
                    found.append((a, b, None))  # equal paths
                elif 2 * (b - a) > hi - lo:
                    open_.append((a, b, at + 4))
                else:
                    found.append((a, b, at + 4 if b - a > LEAF_DOCS else None))
        found.sort()
        merged: list[tuple[int, int, int | None]] = []
        for a, b, below in found:
            if below is None and merged and merged[-1][2] is None and b - merged[-1][0] <= LEAF_DOCS:
                a = merged.pop()[0]
            merged.append((a, b, below))
        return merged

    def _bound(self, n_terms: int) -> None:
        """``reach``: for every node and term what a document below can gain at most."""
        nodes = len(self.lo)
        high, low = np.zeros((nodes, n_terms), np.int32), np.full(nodes, 1 << 40)
        for node in range(nodes - 1, -1, -1):  # children have higher numbers
            if below := self.children[node]:
                high[node], low[node] = high[below].max(axis=0), low[below].min()
            elif self.hi[node] > self.lo[node]:
                i, j = self.offsets[self.lo[node]], self.offsets[self.hi[node]]
                np.maximum.at(high[node], self.term[i:j], self.tf[i:j].astype(np.int32))
                low[node] = self.m[self.lo[node] : self.hi[node]].min()
        self.reach = high  # at most 10^6
        for node in range(nodes):
            tf = high[node].astype(np.int64)
            self.reach[node] = 1_000_000_000 * tf // (1000 * tf + 20 * low[node])

    def search(self, item: np.ndarray, weight: np.ndarray, floor: int, found) -> None:
        """Call ``found(rows, scores)``, which returns the new floor, for leaves that may hold scores of ``floor`` or more."""
        bound = self.reach[:, item].astype(np.int64) @ weight
        dense = np.zeros(self.reach.shape[1], np.int64)
        dense[item] = weight
        todo = [0]
        while todo:
            node = todo.pop()
            if bound[node] < floor or bound[node] <= 0:
                continue
            if below := self.children[node]:
                todo += sorted((c for c in below if bound[c] >= floor), key=bound.__getitem__)
                continue
            lo, hi = self.lo[node], self.hi[node]
            i, j = self.offsets[lo], self.offsets[hi]
            upto = np.r_[0, np.cumsum(dense[self.term[i:j]] * self.gain[i:j])]
            scores = np.diff(upto[self.offsets[lo : hi + 1] - i])
            good = np.flatnonzero((scores >= floor) & (scores > 0))
            if len(good):
                floor = found(self.rows[lo + good], scores[good])


def vectors(docs: DataFrame, words: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n long, term array, tf array): the length of every document, and its terms among ``words`` by their place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {word: i for i, word in enumerate(words)}
        for batch in pieces(batches):
            sizes, terms_, counts = [], [], []
            for text in batch.column(1).to_pylist():
                found = terms(text)
                own = Counter([place[w] for w in found if w in place])
                sizes.append(len(found))
                terms_.append(list(own.keys()))
                counts.append(list(own.values()))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms_, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "term", "tf"])

    small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, f"id {picked.schema[0].dataType.simpleString()}, n long, term array<int>, tf array<int>")


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(row, item, word, block): the distinct terms of every row of ``items``.

    The items of a block have at most ``BLOCK_TERMS`` terms, or it is one item. Sizes are summed up within each
    partition and then over the partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            words = pa.array([list(dict.fromkeys(terms(text))) for text in batch.column(2).to_pylist()], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words], names=["row", "item", "words"])

    picked = items.select(F.monotonically_increasing_id().alias("row"), F.col(item_col).alias("item"), F.col(text_col).cast("string"))
    found = keep(picked.mapInArrow(run, f"row long, item {picked.schema[1].dataType.simpleString()}, words array<binary>"))
    sizes = found.select("row", F.size("words").alias("size"), F.shiftright("row", 33).alias("part"))
    sizes = sizes.withColumn("inside", F.sum("size").over(Window.partitionBy("part").orderBy("row")) - F.col("size"))
    parts = sizes.groupBy("part").agg(F.sum("size").alias("sum"))
    parts = parts.select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("before"))  # a row a partition
    own = F.when(F.col("size") * 2 > BLOCK_TERMS, -1 - F.col("row"))
    block = F.coalesce(own, F.floor((F.col("before") + F.col("inside")) * 2 / BLOCK_TERMS))
    placed = sizes.join(parts, "part").select("row", block.cast("long").alias("block"))
    return found.join(placed, "row").select("row", "item", "block", F.explode("words").alias("word"))


def _best(batches: Iterator[pa.RecordBatch], asked: list[tuple[int, np.ndarray, np.ndarray]], rank: np.ndarray, scale: tuple[int, int], top: int) -> dict[int, list[tuple]]:
    """The ``top`` rows (negative score, id is null, id) of each item over all trees of a task."""
    n_docs, n_terms = scale
    best: dict[int, list[tuple]] = {row: [] for row, _, _ in asked}
    room = max(LEAF_DOCS, TREE_CELLS // len(rank))
    ids, sizes, rows = [], [], []

    def flush() -> None:
        n = np.array(sizes, np.int64)
        offsets = np.r_[0, np.cumsum([len(t) for t, _ in rows])].astype(np.int64)
        term, tf = (np.concatenate(x).astype(np.int64) for x in zip(*rows))
        tree = Tree(offsets, term, tf, 50 + 50 * n * n_docs // n_terms, rank)
        for row, item, weight in asked:
            kept = best[row]

            def found(at: np.ndarray, scores: np.ndarray) -> int:
                kept.extend((-s, ids[i] is None, ids[i]) for i, s in zip(at.tolist(), scores.tolist()))
                kept.sort(key=lambda x: x[: 2 if x[1] else 3])
                del kept[top:]
                return -kept[-1][0] if len(kept) == top else 1

            tree.search(item, weight, -kept[-1][0] if len(kept) == top else 1, found)
        for x in (ids, sizes, rows):
            x.clear()

    for batch in batches:
        lists = [batch.column(k) for k in ("term", "tf")]
        starts = lists[0].offsets.to_numpy()
        flat, counts = (x.values.to_numpy() for x in lists)
        for i, (key, n) in enumerate(zip(batch.column("id").to_pylist(), batch.column("n").to_pylist())):
            ids.append(key)
            sizes.append(n)
            rows.append((flat[starts[i] : starts[i + 1]], counts[starts[i] : starts[i + 1]]))
            if len(ids) == room:
                flush()
    if ids:
        flush()
    return best


def _search(docs: DataFrame, block: DataFrame, top: int, id_col: str, text_col: str) -> DataFrame:
    """(row, doc, score) of one block: the best rows of every task."""
    pairs = block.select("row", "word").collect()  # at most BLOCK_TERMS, or one item
    words = sorted({bytes(row.word) for row in pairs})
    found = keep(vectors(docs, words, id_col, text_col))
    n_docs, n_terms = found.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(len(words), np.int64)
    for term, df in found.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # at most a row a word
        held[term] = df
    rank = np.argsort(np.lexsort((np.arange(len(words)), -held)))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)
    place = {word: i for i, word in enumerate(words)}
    items: dict[int, list[int]] = {}
    for row, word in pairs:
        items.setdefault(row, []).append(place[bytes(word)])
    asked = [(row, np.array(own, np.int64), weight[own]) for row, own in sorted(items.items())]
    id_type = to_arrow_type(found.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _best(batches, asked, rank, (n_docs, n_terms), top)
        rows = [(row, key, -score) for row, kept in best.items() for score, _, key in kept]
        if rows:
            row, key, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(key, id_type), pa.array(score, pa.int64())], names=["row", "doc", "score"])

    return found.where(F.size("term") > 0).mapInArrow(run, f"row long, doc {found.schema['id'].dataType.simpleString()}, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, rank int, doc, score long): the ``top`` documents of every item with a score above 0."""
    words = keep(item_terms(items, item_col, text_col))
    blocks = sorted(row.block for row in words.select("block").distinct().collect())  # BLOCK_TERMS or one item each
    if not blocks:
        return docs.where("false").selectExpr(f"CAST(NULL AS {words.schema['item'].dataType.simpleString()}) AS `{item_col}`", "0 AS rank", f"`{id_col}`", "0L AS score")
    found = [keep(_search(docs, words.where(F.col("block") == block), top, id_col, text_col)) for block in blocks]
    named = words.select("row", "item").distinct().withColumnRenamed("item", item_col)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    best = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(named, "row").select(item_col, "rank", F.col("doc").alias(id_col), "score")
