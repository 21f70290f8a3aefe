"""Benchmark decontamination: windows of an item's size, their SimHash, Hamming blocks, exact similarity.

Words are runs of letters and digits, lower-cased; shingles have five words (an item of fewer words is one shingle).
Only documents that share enough shingles with an item for the similarity to be possible get windows, each as many
shingles long as the item: one at every shingle of the item's from which on enough of them lie within the item's size, in
whatever order, save where the window one place before holds no fewer, and those at and between near diagonals on which
shingles meet. A window's SimHash is
looked up in the items' by the eight byte blocks: ``RADIUS`` differing bits leave one block with at most two,
so the items stand under all patterns two bits around their blocks, and no pair within the radius is missed. What
is within the radius is verified by the exact weighted similarity, the sum of the lower counts of each shingle over
the sum of the higher ones.

A similarity of 0.8 of five-word shingles lies ten bits apart on average, with a deviation of three; the radius of 23
leaves out about one such pair in a million. Null and empty texts and items match nothing. Every row of either table has
a key of its own: rows with equal ids, or without id, are matched each and reported as one, and only the rows
themselves are dropped. Other columns are ignored; empty tables give no rows. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.rowkeys import free_name, with_key
from tablewright.session import keep

SHINGLE = 5
SIMILARITY = 0.8
BLOCK_BITS, BLOCK_COUNT, BLOCK_RADIUS = 8, 8, 2
RADIUS = BLOCK_COUNT * (BLOCK_RADIUS + 1) - 1


def words(text: Column) -> Column:
    found = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^\\p{L}\\p{N}]+")
    return F.filter(found, lambda w: w != "")


def shingles(parts: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` words of an array of words."""
    starts = F.when(F.size(parts) >= size, F.sequence(F.lit(1), F.size(parts) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.element_at(parts, (i + k).cast("int")) for k in range(size))))


def simhash(hashes: Column) -> Column:
    """64 bits, each set if more than half the hashes have it."""
    bit = lambda b: F.size(F.filter(hashes, lambda h: F.getbit(h, b) == 1)) * 2 > F.size(hashes)
    one = lambda b: F.when(bit(b), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda all_, b: all_.bitwiseOR(one(b)))


def _blocks(fp: Column) -> list[Column]:
    return [F.shiftrightunsigned(fp, BLOCK_BITS * i).bitwiseAND((1 << BLOCK_BITS) - 1).cast("int") for i in range(BLOCK_COUNT)]


def _near_patterns() -> list[int]:
    """Bit patterns with at most ``BLOCK_RADIUS`` bits of a block."""
    return [x for x in range(1 << BLOCK_BITS) if x.bit_count() <= BLOCK_RADIUS]


def _looked_up(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of windows and items of the same size and shingle whose fingerprints are within the radius."""
    near = F.array(*(F.lit(x) for x in _near_patterns()))
    number = lambda fp: F.explode(F.array(*(F.struct(F.lit(i).alias("no"), b.alias("value")) for i, b in enumerate(_blocks(fp)))))
    stored = items.select("item_id", "k", "m", F.col("fp").alias("item_fp"), number(F.col("fp")).alias("block")).select("*", F.explode(near).alias("flip"))
    stored = stored.select("item_id", "k", "m", "item_fp", F.col("block.no").alias("no"), F.col("block.value").bitwiseXOR(F.col("flip")).alias("value"))
    asked = windows.select("doc", "start", "hashes", "k", "m", "fp", number(F.col("fp")).alias("block")).select("*", "block.no", "block.value").drop("block")
    pairs = asked.join(stored, ["k", "m", "no", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    return pairs.groupBy("doc", "start", "item_id", "k", "m", "fp").agg(F.first("hashes").alias("hashes"))


def _starts(diagonals: Column, m: Column) -> Column:
    """All places between neighbouring diagonals that one window may span."""
    gap = (m / 4).cast("int") + 1
    follows = lambda i: F.get(diagonals, i + 1)
    stop = lambda i: F.when(follows(i) - F.get(diagonals, i) <= gap + 1, follows(i) - 1).otherwise(F.get(diagonals, i))
    runs = F.transform(F.sequence(F.lit(0), F.size(diagonals) - 1), lambda i: F.sequence(F.get(diagonals, i), stop(i)))
    return F.flatten(runs)


def _dense_starts(places: Column, m: Column, need: Column) -> Column:
    """The sorted ``places`` from which on ``m`` shingles hold ``need`` places or more, and one before do not hold as many.

    A window that starts between places loses nothing by moving on to the next one. Nor does one by moving back
    by one, if it so gains a place at the start and loses none at the end.
    """
    at = lambda i: F.get(places, i)
    ends_full = lambda i: F.array_contains(F.slice(places, i + need, m - need + 1), at(i) + m - 1)
    follows = lambda i: F.coalesce(F.get(places, F.greatest(i - 1, F.lit(0))) == at(i) - 1, F.lit(False))
    dense = lambda i: F.coalesce(at(i + need - 1) - at(i) < m, F.lit(False))
    kept = F.filter(F.sequence(F.lit(0), F.size(places) - 1), lambda i: dense(i) & (~follows(i) | ends_full(i)))
    return F.transform(kept, at)


def _keyed(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with a number of their own, written once so that it stays the same."""
    return keep(rows.withColumn(key, F.monotonically_increasing_id()))


def _best(texts: DataFrame, benchmark: DataFrame, similarity: float, item_col: str, text_col: str) -> DataFrame | None:
    """(doc, item, top): the best window of every (doc, text) and row of the benchmark; nothing if that holds no words."""
    given = benchmark.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    given = given.withColumn("k", F.least(F.size("words"), F.lit(SHINGLE)))
    sized = F.coalesce(*(F.when(F.col("k") == k, shingles(F.col("words"), k)) for k in range(1, SHINGLE + 1)))
    items = _keyed(given.select("item", "k", sized.alias("hashes")).withColumn("m", F.size("hashes")).withColumn("fp", simhash(F.col("hashes"))), "item_id")
    sizes = sorted(row.k for row in items.select("k").distinct().collect())  # 1 to 5
    if not sizes:
        return None
    at = items.select("item_id", "k", "m", F.posexplode("hashes").alias("offset", "h"))
    spread = None
    for k in sizes:
        part = texts.select("doc", words(F.col("text")).alias("words")).select("doc", F.lit(k).alias("k"), F.posexplode(shingles(F.col("words"), k)).alias("pos", "h"))
        spread = part if spread is None else spread.unionByName(part)
    # an item can only be similar if that many of the document's shingles are its own
    met = spread.join(at, ["k", "h"]).groupBy("doc", "item_id", "k", "m").agg(F.count_distinct("pos").alias("n"), F.collect_set(F.col("pos") - F.col("offset")).alias("diagonals"), F.array_sort(F.collect_set("pos")).alias("places"))
    need = F.greatest(F.lit(1), F.ceil(similarity * F.col("m") - 1e-9).cast("int"))
    both = F.array_union(_starts(F.array_sort("diagonals"), F.col("m")), _dense_starts(F.col("places"), F.col("m"), need))
    starts = F.transform(both, lambda s: F.struct(F.col("m"), s.alias("start")))
    enough = met.where(F.col("n") >= similarity * F.col("m") - 1e-9)
    wanted = keep(enough.groupBy("doc", "k").agg(F.array_distinct(F.flatten(F.collect_list(starts))).alias("wanted")))
    # the shingles of a document are hashed once, then its windows are cut
    some = texts.join(wanted, "doc").select("doc", "k", "wanted", words(F.col("text")).alias("words"))
    some = some.select("doc", "k", F.coalesce(*(F.when(F.col("k") == k, shingles(F.col("words"), k)) for k in sizes)).alias("all"), "wanted")
    some = some.select("doc", "k", "all", F.explode("wanted").alias("at")).select("doc", "k", "all", "at.m", "at.start")
    inside = F.greatest(F.lit(0), F.least(F.col("start"), F.size("all") - F.col("m")))
    windows = some.select("doc", "k", "m", inside.alias("start"), F.slice("all", inside + 1, F.col("m")).alias("hashes")).distinct()
    pairs = keep(_looked_up(windows.withColumn("fp", simhash(F.col("hashes"))), items))
    window = ["doc", "start", "item_id", "k", "m", "fp"]
    own = pairs.select(*window, F.size("hashes").alias("w"), F.explode("hashes").alias("h")).groupBy(*window, "w", "h").agg(F.count("*").alias("n"))
    theirs = at.groupBy("item_id", "h").agg(F.count("*").alias("c"))
    common = own.join(theirs, ["item_id", "h"]).groupBy(*window, "w").agg(F.sum(F.least("n", "c")).alias("both"))
    found = common.withColumn("similarity", F.col("both") / (F.col("w") + F.col("m") - F.col("both"))).where(F.col("similarity") >= similarity - 1e-12)
    best = found.groupBy("doc", "item_id").agg(F.max(F.struct("similarity", -F.col("start"), F.col("m") + F.col("k") - 1)).alias("top"))
    return best.join(items.select("item_id", "item"), "item_id").select("doc", "item", "top")


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, item, similarity, first_word, n_words): the best window of every document that has an item, and item."""
    rows = _keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "doc")
    best = _best(rows.select("doc", "text"), benchmark, similarity, item_col, text_col)
    if best is None:
        nothing = docs.where(F.lit(False)).select(F.col(id_col))
        return nothing.crossJoin(benchmark.where(F.lit(False)).select(item_col)).selectExpr("*", "0D AS similarity", "0 AS first_word", "0 AS n_words")
    best = best.join(rows.select("doc", "id"), "doc").groupBy("id", "item").agg(F.max("top").alias("top"))
    return best.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), F.round("top.similarity", 6).alias("similarity"),
        (-F.col("top.col2")).alias("first_word"), F.col("top.col3").alias("n_words"),
    )


#: Rows that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 19


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark, whatever their ids; same columns."""
    key = free_name(docs, "_key")
    rows = with_key(docs, key)
    best = _best(rows.select(F.col(key).alias("doc"), "text"), benchmark, similarity, "item_id", "text")
    if best is None:
        return rows.drop(key)
    found = keep(best.select(F.col("doc").alias(key)).distinct())
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    return rows.join(found, key, "left_anti").select(*docs.columns)
