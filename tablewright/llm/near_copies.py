"""Near copies of documents: SimHash candidates within a radius of their own, verified by exact similarity.

Words are runs of letters and digits, lower-cased. Rows with the same words are copies; of each such class one row goes on.
Candidates are classes whose fingerprints, over two-word shingles, differ in at most ``RADIUS`` of 64 bits. Of the four
16-bit blocks of such a pair one differs in at most two bits, so the pair meets in a node if every fingerprint stands under
each of its blocks and under all patterns one bit away; nodes are searched by the Gray-ordered index of ``simhash_dedup``,
which gives edges that connect whatever lies within the radius. Every edge is then verified: five-word shingles (fewer
words are one shingle), repeats counted, have to be alike by ``SIMILARITY``, the sum of the lower counts over the sum of
the higher ones.

An edit changes fewer shingles of two words than of five, so pairs at a similarity of 0.8 lie six bits apart on
average, unrelated texts 32. What lies beyond the radius, or hung on an edge that did not hold, is found exactly: a token is a
shingle's hash with its number in the text, and all texts order their tokens alike, rare ones first (frequent ones told by counts of
32-bit cells; the order decides on the work, not on the result). Two alike texts have at least o tokens in common, o being 4/9 of the sum of their sizes, so
each, if it has n, has the first l common ones among its first n - o + l. Such fronts, for the least possible o, are listed by token; lists of one group so far are dropped, long ones settled in rounds of
random neighbours, and of the rest all pairs of different groups that share enough of their fronts are verified. A group is a connected
component of all alike classes; its row with the smallest id stays. Documents without words are copies of each other. Rows without id come after the others; of equal
ids the first row in the files counts as smaller. Columns are returned as they came, whatever their names; an empty table
gives no rows. Only ids, digests, fingerprints, cells and fronts are shuffled, and shingles of documents that have a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.batches import give_back, pieces, small_batches
from tablewright.llm.components import components
from tablewright.llm.rowkeys import RowLists, free_name, picked, with_key, worked
from tablewright.llm.simhash_dedup import _linker, bits_of, gray_rank
from tablewright.session import keep

RADIUS, FINGERPRINT_WORDS = 11, 2
SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, BLOCK_BITS = 4, 16
#: Tokens that a front holds beyond the least number; rows from which on a token is crowded; one in how many neighbours has to be alike for another round.
EXTRA, CROWD, GAIN = 3, 32, 16
#: Random orders in a round.
ORDERS = 8
#: Times from which on a cell may be common, and cells that are kept as common; an odd factor of the hashes.
COMMON, COMMON_CELLS, ODD = 4, 1 << 20, 0x9E3779B97F4A7C15


def words(text: str | None) -> list[bytes]:
    import re

    return [w.encode() for w in re.findall(r"[^\W_]+", (text or "").lower())]


def shingles(found: list[bytes], size: int) -> list[int]:
    """XXH64 of the runs of ``size`` words; fewer words make one run, no words none."""
    import xxhash

    if len(found) < size:
        return [xxhash.xxh64_intdigest(b" ".join(found), 42)] if found else []
    return [xxhash.xxh64_intdigest(b" ".join(gram), 42) for gram in zip(*(found[i:] for i in range(size)))]


def prints(docs: DataFrame, key: str, id_col: str, text_col: str) -> DataFrame:
    """(file, row, id, digest binary, fp) of every row of ``docs`` with the key column ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in pieces(batches, 3):
            found = [words(text) for text in batch.column(3).to_pylist()]
            digest = pa.array([xxhash.xxh3_128_digest(b" ".join(some)) for some in found], pa.binary())
            fp = np.array([bits_of(shingles(some, FINGERPRINT_WORDS)) for some in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), digest, pa.array(fp)], names=["file", "row", "id", "digest", "fp"])

    small_batches(docs.sparkSession)
    given = docs.select(f"{key}.file", f"{key}.row", F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, f"file long, row long, id {given.schema['id'].dataType.simpleString()}, digest binary, fp long")


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b): edges that connect the classes (number, fp) within the radius."""
    shift = lambda b: BLOCK_BITS * b
    block = lambda b: F.shiftrightunsigned("fp", shift(b)).bitwiseAND((1 << BLOCK_BITS) - 1)
    masks = F.array(F.lit(0), *(F.lit(1 << i) for i in range(BLOCK_BITS)))
    places = F.array(*(F.struct(F.lit(b).alias("top"), block(b).alias("own")) for b in range(BLOCKS)))
    rows = classes.select("number", "fp", F.explode(places).alias("at")).select("number", "fp", "at.top", "at.own", F.explode(masks).alias("flip"))
    nodes = rows.select(F.col("top").cast("long"), F.col("own").bitwiseXOR(F.col("flip").cast("long")).alias("node"), "fp", "number", gray_rank(F.col("fp")).alias("rank"))
    nodes = nodes.repartition("top", "node").sortWithinPartitions("top", "node", "rank").select("top", "node", "fp", "number")
    return nodes.mapInArrow(_linker(RADIUS), "a long, b long").distinct()


def _shingle_bags(docs: DataFrame, numbered: DataFrame, key: str, text_col: str) -> DataFrame:
    """(number, bag binary) of the classes ``numbered`` (file, row, number): the sorted shingle hashes of their row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            bags = [np.sort(np.array(shingles(words(text), SHINGLE), np.uint64)).tobytes() for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(bags, pa.binary())], names=["number", "bag"])

    given = docs.select(F.col(text_col).cast("string").alias("text"), key)
    return worked(given, key, RowLists(numbered), ["number"], run, "number long, bag binary")


def common(a: bytes, b: bytes) -> float:
    """Similarity of two sorted bags of hashes, repeats counted; no hashes at all are alike."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    (u, n), (v, m) = (np.unique(z, return_counts=True) for z in (x, y))
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(x) + len(y) - both)


def verified(edges: DataFrame, bags: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The ``edges`` (a, b) whose bags are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = [common(x, y) >= similarity - 1e-12 for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(alike, pa.bool_()))
        give_back()

    one, two = (bags.select(F.col("number").alias(side), F.col("bag").alias(f"bag_{side}")) for side in "ab")
    return edges.join(one, "a").join(two, "b").select("a", "b", "bag_a", "bag_b").mapInArrow(run, "a long, b long")


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The place of its text and a hash of every shingle, with the number of equal ones before it in the text."""
    import xxhash

    found = [words(text) for text in texts]
    flat = np.array([xxhash.xxh64_intdigest(word) for some in found for word in some], np.uint64)
    owner = np.repeat(np.arange(len(found)), [len(some) for some in found])
    n = max(0, len(flat) - SHINGLE + 1)
    whole = owner[:n] == owner[SHINGLE - 1 :][:n]
    hashes = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        hashes += flat[k : n + k] * np.uint64(ODD ** (k + 1) % 2**64)
    short = [i for i, some in enumerate(found) if 0 < len(some) < SHINGLE]
    alone = np.array([xxhash.xxh64_intdigest(b" ".join(found[i])) for i in short], np.uint64)
    owner, hashes = np.concatenate([owner[:n][whole], np.array(short, np.int64)]), np.concatenate([hashes[whole], alone])
    order = np.lexsort((hashes, owner))
    owner, hashes, place = owner[order], hashes[order], np.arange(len(order))
    new = np.concatenate([np.ones(min(1, len(order)), bool), (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])])
    hashes += (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64) * np.uint64(ODD >> 8 | 1)
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(ODD)
    return owner, hashes ^ (hashes >> np.uint64(29))


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(32)).astype(np.uint32)


def _common_cells(given: DataFrame, key: str, lists: RowLists) -> RowLists:
    """The cells (the upper 32 bits of a token) that the texts of ``given`` (text, key) in ``lists`` hold most often, with their levels: the binary logarithms."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            cells = np.sort(_cells(_tokens(batch.column(0).to_pylist())[1]))
            bounds = np.searchsorted(cells >> np.uint32(22), np.arange(1025))
            parts = np.flatnonzero(np.diff(bounds))
            data = pa.array([cells[bounds[i] : bounds[i + 1]].tobytes() for i in parts.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), data], names=["part", "cells"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def counted() -> pa.RecordBatch:
            cells, n = np.unique(np.frombuffer(b"".join(held), np.uint32), return_counts=True)
            cells, n = cells[n >= COMMON], n[n >= COMMON]
            return pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(np.log2(n).astype(np.int64))], names=["row", "level"])

        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != now:
                    yield counted()
                    now, held = part, []
                held.append(cells)
        yield counted()
        held.clear()
        give_back()

    parts = worked(given, key, lists, [], cut, "part int, cells binary").repartition("part").sortWithinPartitions("part")
    cells = keep(parts.mapInArrow(count, "row long, level long"))
    sizes = {r.level: r.n for r in cells.groupBy("level").agg(F.count("*").alias("n")).collect()}  # 64 rows at most
    lowest = min((level for level in sizes if sum(n for other, n in sizes.items() if other >= level) <= COMMON_CELLS), default=64)
    return RowLists(cells.where(F.col("level") >= lowest).select(F.lit(0).cast("long").alias("file"), "row", "level"))


def _needed(size: int | np.ndarray) -> np.ndarray:
    """Shingles that a row of ``size`` has in common with any that is alike, at least."""
    return np.ceil(SIMILARITY * size - 1e-6).astype(np.int64)


def _fronts(given: DataFrame, key: str, lists: RowLists) -> DataFrame:
    """(token, number, root, size, left): the first tokens of every class in ``lists`` (number, root), whose text ``given`` (text, key) has, rare ones first.

    ``left`` counts the tokens from this one on.
    """
    common_cells = _common_cells(given, key, lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, levels = (column.astype(kind) for column, kind in zip(common_cells.columns(0, ["level"]), (np.uint32, np.int8)))
        for batch in pieces(batches, 0):
            owner, tokens = _tokens(batch.column(0).to_pylist())
            own = _cells(tokens)
            at = np.minimum(np.searchsorted(cells, own), len(cells) - 1)
            level = np.where(cells[at] == own, levels[at], 0) if len(cells) else np.zeros(len(own), np.int8)
            order = np.lexsort((tokens, level, owner))
            size = np.bincount(owner, minlength=batch.num_rows)
            front = size - _needed(size) + 1 + np.minimum(EXTRA, size // 10)
            left = np.cumsum(size)[owner] - np.arange(len(owner))
            kept = size[owner] - left < front[owner]
            owner, tokens, left = owner[kept], tokens[order][kept], left[kept]
            columns = [tokens.view(np.int64), *(batch.column(i).to_numpy()[owner] for i in (1, 2)), *(c.astype(np.int32) for c in (size[owner], left))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "number", "root", "size", "left"])

    return worked(given, key, lists, ["number", "root"], run, "token long, number long, root long, size int, left int")


def _mixed(rows: DataFrame) -> DataFrame:
    """The ``rows`` (token, root, ...) of tokens that rows of several roots hold."""
    own = Window.partitionBy("token")
    marked = rows.withColumn("low", F.min("root").over(own)).withColumn("high", F.max("root").over(own))
    return marked.where("low < high").drop("low", "high")


def _shared(one: Column, two: Column) -> tuple[Column, Column]:
    """How many of their first tokens two alike rows of these sizes share at least, and which places count: those with so many tokens left."""
    count = 1 + F.least(F.lit(EXTRA), F.floor(F.least(one, two) / 10))
    return count, F.ceil((one + two) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6) - count + 1


def _neighbours(fronts: DataFrame, seed: int) -> DataFrame:
    """(a, b, root_a, root_b): of tokens with many rows, each row with the one before it in one of ``ORDERS`` random orders, if their roots differ."""
    own = Window.partitionBy("token")
    line = own.orderBy(F.xxhash64("number", F.pmod("token", F.lit(ORDERS)), F.lit(seed)), "number")
    before = F.lag(F.struct("number", "root", "size", "left")).over(line)
    crowded = fronts.withColumn("n", F.count("*").over(own)).withColumn("before", before).where(F.col("n") >= CROWD)
    close = F.least("left", "before.left") >= _shared(F.col("size"), F.col("before.size"))[1]
    found = crowded.where(close & (F.col("root") != F.col("before.root")))
    return found.select(F.col("number").alias("a"), F.col("before.number").alias("b"), F.col("root").alias("root_a"), F.col("before.root").alias("root_b")).distinct()


def _meeting(fronts: DataFrame) -> DataFrame:
    """(a, b, root_a, root_b): pairs of different roots that share enough of their first tokens to be alike.

    Rows of a token's most frequent root are not compared with each other.
    """
    leads = fronts.groupBy("token", "root").agg(F.count("*").alias("n")).groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("lead"))
    rows = fronts.join(leads, "token")
    one = rows.where("root <> lead").select("token", *(F.col(c).alias(f"{c}_a") for c in ("number", "root", "size", "left")))
    two = rows.select("token", "lead", *(F.col(c).alias(f"{c}_b") for c in ("number", "root", "size", "left")))
    once = (F.col("root_b") == F.col("lead")) | (F.col("number_a") < F.col("number_b"))
    near = F.least("left_a", "left_b") >= _shared(F.col("size_a"), F.col("size_b"))[1]
    pairs = one.join(two, "token").where((F.col("root_a") != F.col("root_b")) & once & near)
    ends = [F.struct(*(F.col(f"{c}_{side}").alias(c) for c in ("number", "root", "size"))) for side in "ab"]  # either may come first, by token
    counted = pairs.select(F.least(*ends).alias("x"), F.greatest(*ends).alias("y")).groupBy("x", "y").agg(F.count("*").alias("n"))
    enough = F.col("n") >= _shared(F.col("x.size"), F.col("y.size"))[0]
    return counted.where(enough).select(F.col("x.number").alias("a"), F.col("y.number").alias("b"), F.col("x.root").alias("root_a"), F.col("y.root").alias("root_b"))


def _alike(pairs: DataFrame, classes: DataFrame, keyed: DataFrame, key: str, text_col: str) -> DataFrame:
    """The ``pairs`` (a, b) of ``classes`` that are alike."""
    involved = pairs.select(F.explode(F.array("a", "b")).alias("number")).distinct()
    numbered = classes.join(involved, "number").select("first.file", "first.row", "number")
    return keep(verified(pairs, keep(_shingle_bags(keyed, numbered, key, text_col))))


def _moved(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the root that ``roots`` (node, root) give theirs."""
    given = roots.select(F.col("node").alias("root"), F.col("root").alias("other"))
    return rows.join(given, "root", "left").withColumn("root", F.coalesce("other", "root")).drop("other").select(*rows.columns)


def _between(alike: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): the roots of the ``alike`` among the ``pairs``."""
    return alike.join(pairs, ["a", "b"]).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))


def _joined(classes: DataFrame, keyed: DataFrame, key: str, text_col: str) -> DataFrame:
    """``classes`` (number, first, root, ...) with one root for all that alike classes connect, beyond the radius too."""
    lists = RowLists(classes.select("first.file", "first.row", "number", "root"))
    fronts = keep(_mixed(_fronts(keyed.select(F.col(text_col).cast("string").alias("text"), key), key, lists)))
    rounds, gaining = 0, True
    while gaining:
        pairs = keep(_neighbours(fronts, rounds))
        tried, rounds = pairs.count(), rounds + 1
        if tried:
            alike = _alike(pairs.select("a", "b"), classes, keyed, key, text_col)
            roots = components(_between(alike, pairs))
            classes, fronts = keep(_moved(classes, roots)), keep(_mixed(_moved(fronts, roots)))
            gaining = alike.count() * GAIN >= tried
        else:
            gaining = False
    pairs = keep(_meeting(fronts))
    alike = _alike(pairs.select("a", "b"), classes, keyed, key, text_col)
    classes = _moved(classes, components(_between(alike, pairs)))
    return classes


def groups(keyed: DataFrame, key: str, id_col: str, text_col: str) -> DataFrame:
    """(file, row, first): every row with the first row (late, id, file, row) of its group."""
    rows = keep(prints(keyed, key, id_col, text_col))
    order = F.struct(F.col("id").isNull().alias("late"), "id", "file", "row")
    classes = rows.groupBy("digest").agg(F.min(order).alias("first"), F.first("fp").alias("fp"))
    classes = keep(classes.withColumn("number", F.monotonically_increasing_id()))
    alike = _alike(keep(candidates(classes.select("number", "fp"))), classes, keyed, key, text_col)
    rooted = classes.join(components(alike), F.col("number") == F.col("node"), "left").select("digest", "first", "number", F.coalesce("root", "number").alias("root"))
    rooted = _joined(keep(rooted), keyed, key, text_col)
    firsts = rooted.groupBy("root").agg(F.min("first").alias("lead"))
    named = rooted.join(firsts, "root").select("digest", F.col("lead").alias("first"))
    return rows.join(named, "digest").select("file", "row", "first")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, the one with the smallest id; same columns."""
    key = free_name(docs, "_key")
    keyed = with_key(docs, key)
    found = groups(keyed, key, id_col, text_col)
    gone = found.where((F.col("file") != F.col("first.file")) | (F.col("row") != F.col("first.row"))).select("file", "row")
    return picked(keyed, key, gone, listed=False)
