"""Near-duplicate groups by SimHash fingerprints and a Gray-ordered hierarchical index.

Fingerprint: A-Z lower-cased, words are runs without ASCII white space, shingles of three words; each bit is the
majority of that bit among the shingles' XXH64 values (repeats counted). Fewer words make one shingle, no word
makes fingerprint zero. Documents whose fingerprints differ in at most two bits are linked; a group is a
connected component.

Index: the top nodes hold fingerprints that share two of four 16-bit blocks (two differences leave two blocks
equal, so every linked pair meets in one of the six nodes it shares). A node that has grown over ``NODE_ROWS``
splits on eight more bits: each fingerprint goes to its own child and, as long as it has spent no difference, to
the eight children one bit away. Two fingerprints two bits apart so meet in a child to which each has spent one
difference, and a node split to the end holds 33 fingerprints at most, however many copies there are. Within
a node fingerprints lie in Gray order; runs of them are factored into masked patterns, and a search drops a whole run
as soon as the differences accumulated down the levels exceed two.

Null texts count as empty; rows with equal ids are rows of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.batches import give_back, pieces, small_batches
from tablewright.llm.components import components
from tablewright.session import keep

SHINGLE, RADIUS = 3, 2
#: Fingerprints a node may hold before it splits; rows of a run; pairs examined at once.
NODE_ROWS = 1024
RUN = 8
PAIRS_AT_ONCE = 1 << 20

#: The two equal blocks of each of the six top nodes, and the eight-bit steps in which the other bits are added.
BLOCKS = [(i, j) for i in range(4) for j in range(i + 1, 4)]
STEPS = [[8 * k for k in range(8) if k // 2 not in pair] for pair in BLOCKS]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        grams = zip(*(words[i:] for i in range(shingle)))
        hashes = [xxhash.xxh64_intdigest(b" ".join(gram), 42) for gram in grams]
    return bits_of(hashes)


def bits_of(hashes: list[int]) -> int:
    """64 bits, each set if more than half the hashes have it; none for no hashes."""
    if not hashes:
        return 0
    count = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[start : start + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [fingerprint(text) for text in batch.column(1).to_pylist()]
            prints = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], names=[id_col, "fp"])

    small_batches(docs.sparkSession)
    picked = docs.select(id_col, F.col(text_col).cast("string"))
    return picked.mapInArrow(run, f"{id_col} {picked.schema[0].dataType.simpleString()}, fp long")


def gray_rank(fp: Column) -> Column:
    """Place of a bit pattern in the reflected Gray sequence, as a long that sorts like it."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(_signed(1 << 63)))


def _by_top(values: list[int]) -> Column:
    """The value for the row's top node."""
    return F.element_at(F.array(*(F.lit(_signed(x)) for x in values)), F.col("top") + 1)


def _children(rows: DataFrame, level: int) -> DataFrame:
    """Rows of split nodes, in their own child and, with no difference spent, in those one bit away."""
    own = F.col("fp").bitwiseAND(_by_top([0xFF << steps[level] for steps in STEPS]))
    near = [_by_top([1 << (steps[level] + bit) for steps in STEPS]) for bit in range(8)]
    child = lambda bits, spent: F.struct(F.col("node").bitwiseOR(bits).alias("node"), spent.alias("spent"))
    stay = F.array(child(own, F.col("spent")))
    move = F.array(*(child(own.bitwiseXOR(bit), F.lit(1)) for bit in near))
    moved = F.explode(F.when(F.col("spent") == 0, F.concat(stay, move)).otherwise(stay))
    return rows.select("top", "fp", moved.alias("to")).select("top", "fp", "to.node", "to.spent")


def _nodes(prints: DataFrame) -> DataFrame:
    """(top, node, fp): every fingerprint in the nodes where it meets those it is linked to, none over ``NODE_ROWS``."""
    masks = [sum(0xFFFF << (16 * block) for block in pair) for pair in BLOCKS]
    tops = F.explode(F.array(*(F.struct(F.lit(i).alias("top"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("node")) for i, m in enumerate(masks))))
    rows = prints.select("fp", tops.alias("to")).select("to.top", "fp", "to.node", F.lit(0).alias("spent"))
    done = []
    for level in range(len(STEPS[0])):
        full = keep(rows.groupBy("top", "node").count().where(F.col("count") > NODE_ROWS))
        if full.isEmpty():
            break
        done.append(rows.join(full, ["top", "node"], "left_anti").select("top", "node", "fp"))
        rows = keep(_children(rows.join(full, ["top", "node"], "left_semi"), level))
    out = rows.select("top", "node", "fp")
    for part in done:
        out = out.union(part)
    return out


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the owners, and of the ``count`` consecutive things from ``first`` on that each owner has."""
    owner = np.repeat(np.arange(len(first)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def _level(fp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pattern and mask that the rows of each run share."""
    both, any_ = np.bitwise_and.reduceat(fp, starts), np.bitwise_or.reduceat(fp, starts)
    mask = ~(both ^ any_)
    return both & mask, mask


def _roots(label: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The roots of ``rows``: every row's label is lower than the row, a root's is the root itself."""
    hooked = rows
    while len(hooked := np.unique(hooked[label[hooked] != label[label[hooked]]])):
        label[hooked] = label[label[hooked]]
    return label[rows]


def links_within(group: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (a, b), within ``radius`` bits each, that join the rows of equal ``group`` into their components.

    Rows of a group are adjacent and in Gray order. Only roots are hooked, each to the lowest root it is linked to, and a
    pair is settled only when both ends have one root. Runs that are joined with a row already are passed over whole.
    """
    n = len(fp)
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    place = np.arange(n) - np.repeat(begins, np.diff(np.r_[begins, n]))
    leaf = np.flatnonzero(place % RUN == 0)
    upper = np.flatnonzero(place % (RUN * RUN) == 0)
    leaf_pattern, leaf_mask = _level(fp, leaf) if n else (fp, fp)
    upper_pattern, upper_mask = _level(fp, upper) if n else (fp, fp)
    leaf_of_upper, uppers_of_group = np.searchsorted(leaf, upper), np.searchsorted(upper, begins)
    leaves = np.diff(np.r_[leaf_of_upper, len(leaf)])
    rows = np.diff(np.r_[leaf, n])
    uppers = np.diff(np.r_[uppers_of_group, len(upper)])
    group_no = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, n]))
    work = np.cumsum(uppers[group_no]) if n else np.zeros(0, np.int64)
    label = np.arange(n)
    joined: list[tuple[np.ndarray, np.ndarray]] = []
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(work, (work[start - 1] if start else 0) + PAIRS_AT_ONCE // RUN, side="right")))
        row = np.arange(start, stop)
        who, node = _expand(uppers_of_group[group_no[row]], uppers[group_no[row]])
        row = row[who]
        root = _roots(label, np.arange(n))
        low, high = np.minimum.reduceat(root, upper), np.maximum.reduceat(root, upper)
        open_ = (low[node] != root[row]) | (high[node] != root[row])
        row, node = row[open_], node[open_]
        spent = np.bitwise_count((fp[row] ^ upper_pattern[node]) & upper_mask[node])
        ok = spent <= radius
        row, node, spent = row[ok], node[ok], spent[ok]
        who, below = _expand(leaf_of_upper[node], leaves[node])
        row, spent, above = row[who], spent[who], upper_mask[node][who]
        spent = spent + np.bitwise_count((fp[row] ^ leaf_pattern[below]) & leaf_mask[below] & ~above)
        ok = spent <= radius
        row, below = row[ok], below[ok]
        who, other = _expand(leaf[below], rows[below])
        row = row[who]
        ok = (other > row) & (np.bitwise_count(fp[row] ^ fp[other]) <= radius)
        x, y = row[ok], other[ok]
        while True:
            a, b = _roots(label, x), _roots(label, y)
            left = a != b
            if not left.any():
                break
            x, y = x[left], y[left]
            a, b = np.maximum(a[left], b[left]), np.minimum(a[left], b[left])
            np.minimum.at(label, a, b)
            chosen = np.flatnonzero(label[a] == b)
            chosen = chosen[np.unique(a[chosen], return_index=True)[1]]
            joined.append((x[chosen], y[chosen]))
            label[a] = _roots(label, a)
        start = stop
    if not joined:
        return label[:0], label[:0]
    return tuple(np.concatenate(side) for side in zip(*joined))


def links(prints: DataFrame) -> DataFrame:
    """(a, b): edges between distinct fingerprints that connect whatever differs in at most two bits."""
    nodes = _nodes(prints).withColumn("rank", gray_rank(F.col("fp")))
    nodes = nodes.repartition("top", "node").sortWithinPartitions("top", "node", "rank").select("top", "node", "fp", F.col("fp").alias("name"))
    return nodes.mapInArrow(_linker(RADIUS), "a long, b long")


def _linker(radius: int):
    """Edges (a, b), between names, over rows (top, node, fp, name) in the order of the nodes and of Gray ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, node, fp, name = (np.zeros(0, np.int64) for _ in range(4))

        def found(stop: int) -> pa.RecordBatch:
            group = np.cumsum(np.r_[True, (top[1:stop] != top[: stop - 1]) | (node[1:stop] != node[: stop - 1])]) if stop else top[:0]
            a, b = links_within(group, fp[:stop].view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(name[a]), pa.array(name[b])], names=["a", "b"])

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
            top, node, fp, name = (np.r_[old, more] for old, more in zip((top, node, fp, name), new))
            if len(fp):
                stop = len(fp) - 1
                while stop and top[stop - 1] == top[-1] and node[stop - 1] == node[-1]:
                    stop -= 1
                yield found(stop)
                top, node, fp, name = top[stop:], node[stop:], fp[stop:], name[stop:]
        yield found(len(fp))
        give_back()

    return run


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, component_id): the smallest id reachable over links, for every row."""
    prints = keep(fingerprints(docs, id_col, text_col))
    firsts = keep(prints.groupBy("fp").agg(F.min(id_col).alias("first")))
    roots = components(links(firsts.select("fp"))).withColumnRenamed("node", "fp")
    rooted = firsts.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, "fp", "component_id")
