"""Shards of bounded size by extendible hashing.

A document's key is hashed (56 bits of its MD5). The directory starts with one bucket; a bucket over the byte limit
splits on the next bit of the hash, the others stay as they are. Sizes are counted once, for slots a few bits finer than
the shards will be on average; all splits are made on these sums, and every document is joined with the finished
directory once. Only what lies in slots that are too large still goes on, written out, to further bits. Hash and size are
written once, texts are not shuffled.

A document over the limit gets a shard of its own. Rows that share a whole hash (equal keys) can't be told apart by
bits; if they exceed the limit together they go to numbered overflow pages of their bucket. A null key hashes like the
word null, a null or empty text has no bytes, an empty table gives no shards, other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.session import keep

HASH_BITS = 56
#: Bits by which slots are finer than the average shard, and those of every further step.
STEP_BITS = 4
LIMIT_BYTES = 1 << 20


def key_hash(key: Column) -> Column:
    """The first 56 bits of the key's MD5 as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(depth: int) -> Column:
    return F.shiftright("hash", HASH_BITS - depth)


def _directory(rows: DataFrame, base: int, top: int, limit: int) -> DataFrame:
    """(slot, depth, bucket, shard_bytes) of the slots, ``top`` bits long, of ``rows``; depth is null if too large still."""
    slots = rows.groupBy(_prefix(top).alias("slot")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    levels = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), F.shiftright("slot", top - d).alias("bucket")) for d in range(base, top + 1))))
    spread = slots.select("slot", "bytes", "n", levels.alias("at")).select("slot", "bytes", "n", "at.depth", "at.bucket")
    sizes = spread.groupBy("depth", "bucket").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("n"))
    fits = F.when((F.col("shard_bytes") <= limit) | (F.col("n") == 1), F.struct("depth", "bucket", "shard_bytes"))
    chosen = spread.drop("bytes", "n").join(sizes, ["depth", "bucket"]).groupBy("slot").agg(F.min(fits).alias("leaf"))
    return chosen.select("slot", "leaf.depth", "leaf.bucket", "leaf.shard_bytes")


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Rows that share a whole hash, on pages of at most ``limit`` bytes (a larger row alone).

    Offsets are counted within each input partition and then over the partitions' sums, so no group is one task.
    """
    part = F.shiftright("seq", 33)
    inner = Window.partitionBy("hash", "part").orderBy("seq")
    rows = rows.withColumn("part", part).withColumn("upto", F.sum("bytes").over(inner))
    sums = rows.groupBy("hash", "part").agg(F.sum("bytes").alias("part_bytes"), F.max("bytes").alias("largest"))
    outer = Window.partitionBy("hash")
    before = F.sum("part_bytes").over(outer.orderBy("part")) - F.col("part_bytes")
    sums = sums.select("hash", "part", before.alias("before"), F.max("largest").over(outer).alias("largest"))
    room = F.greatest(F.lit(limit) - F.col("largest"), F.lit(1))
    page = F.floor((F.col("before") + F.col("upto") - F.col("bytes")) / room).cast("long")
    placed = rows.join(sums, ["hash", "part"]).withColumn("page", page)
    pages = placed.groupBy("hash", "page").agg(F.sum("bytes").alias("shard_bytes"))
    return placed.join(pages, ["hash", "page"]).select("key", "bytes", F.lit(HASH_BITS).alias("depth"), F.col("hash").alias("bucket"), "page", "shard_bytes")


def shards(docs: DataFrame, limit: int = LIMIT_BYTES, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, bytes, depth, bucket, page, shard_bytes) of every row: its shard is (depth, bucket, page), page 0 but for overflow."""
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    rows = keep(docs.select(F.col(key_col).alias("key"), key_hash(F.col(key_col)).alias("hash"), size.alias("bytes"), F.monotonically_increasing_id().alias("seq")))
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    left, placed, base = rows, [], 0
    top = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total) / limit))) + STEP_BITS)
    while True:
        directory = keep(_directory(left, base, top, limit))
        slot = _prefix(top).alias("slot")
        found = left.select("*", slot).join(directory.where("depth IS NOT NULL"), "slot")
        placed.append(found.select("key", "bytes", "depth", "bucket", F.lit(0).cast("long").alias("page"), "shard_bytes"))
        full = directory.where("depth IS NULL").select("slot")
        if full.isEmpty():
            break
        left = keep(left.select("*", slot).join(full, "slot", "left_semi").drop("slot"))
        if top == HASH_BITS:
            placed.append(_overflow(left, limit))
            break
        base, top = top, min(HASH_BITS, top + STEP_BITS)
    out = placed[0]
    for part in placed[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("key", key_col)


def write_shards(docs: DataFrame, placed: DataFrame, folder: str, key_col: str = "doc_id") -> None:
    """Write ``docs`` (unique keys) with one folder per shard, each of bounded size and written by one task."""
    shard = F.concat_ws("-", "depth", "bucket", "page")
    rows = docs.join(placed.select(key_col, shard.alias("shard")), key_col)
    rows.repartition("shard").write.partitionBy("shard").parquet(folder)
