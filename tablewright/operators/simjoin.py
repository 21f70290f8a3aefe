"""Joins of texts on similarity and on containment, without comparing all pairs.

Similarity. Two texts whose common subsequence makes up ``threshold`` percent of both lengths share many two-letter
grams (with a mark at either end, repeats numbered): at least ``3c - x - y + 1`` for lengths x and y and the common length
c they need. All grams are put in one order, rarest first as counted in the data at hand. The first grams that a
similar pair shares, in that order, lie near the front of both texts, so each text is listed under its front grams
only; a list that has grown long is split by the next shared gram, and that again, as long as this saves pairs. A pair counts in
the list of its first shared grams alone, which makes every candidate come up once; length, place in the order and number of
shared grams are tested there, and what remains is measured.

Containment. Short texts fall into length classes (powers of two); each is listed under the rarest of its windows of
that length. Long texts emit their windows of all classes, hashed, and what meets is verified. Where a class has few
lengths, its texts are listed whole and looked for by their lengths, if that makes fewer rows by the lengths counted.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.similarity import ratio
from tablewright.session import keep_tidy as keep

#: Pairs a list may give rise to before it is split by the next gram.
LIST_PAIRS = 1024
#: Pairs of long lists, all together, from which on a step of splitting costs less than it saves.
WORTH = 1 << 22
#: Grams a list is split by at most; what is still long then stays as it is.
DEPTH = 6
#: Contained texts have at least this many characters.
CONTAINED_FROM = 4
_EDGE, _PART = "\u0002", "\u0001"


def grams(text: Column) -> Column:
    """The two-letter grams of a text with marked ends, repeats numbered."""
    marked = F.concat(F.lit(_EDGE), text, F.lit(_EDGE))
    plain = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda at: F.substring(marked, at, F.lit(2))))
    return F.transform(plain, lambda g, at: F.concat(g, (at + 2 - F.array_position(plain, g)).cast("string")))


def _common_length(x: Column, y: Column, threshold: int) -> Column:
    """The common length that texts of these lengths need."""
    return F.ceil((x + y) * F.lit(threshold / 200.0) - F.lit(1e-9)).cast("int")


def _least_shared(size: Column, threshold: int) -> Column:
    """How many grams a text of this length shares with any similar text, at the least.

    Letters only the text has cost two grams each, letters only the other has cost one; the most of either that a similar
    pair allows bounds the loss.
    """
    own, other = (200.0 - 2 * threshold) / (200.0 - threshold), (200.0 - 2 * threshold) / threshold
    return F.greatest(F.lit(1), F.ceil(size + 1 - size * F.lit(max(2 * own, other)) - F.lit(1e-9)).cast("int"))


def _ordered_grams(texts: DataFrame) -> DataFrame:
    """``texts`` with their grams, rarest first."""
    held = keep(texts.select("text", F.explode(grams(F.col("text"))).alias("gram")))
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    order = F.array_sort(F.collect_list(F.struct("n", "gram")))["gram"]  # as long as the text
    return texts.join(held.join(counts, "gram").groupBy("text").agg(order.alias("grams")), "text")


def _lists(texts: DataFrame, threshold: int, list_pairs: int = LIST_PAIRS, worth: int = WORTH) -> DataFrame:
    """``texts`` under the lists (``path``, of ``level`` grams) in which they meet similar ones; ``at``: place of the last gram.

    A long list is split where that adds no pairs, which it does if its texts are alike anyhow.
    """
    size, kept = F.size("grams"), ["text", "grams", "least", "is_left", "is_right"]

    def spread(rows: DataFrame, level: int, first: Column, path: Column) -> DataFrame:
        # who shares too few grams for the level meets others, who share more, in any further gram
        last = F.when(F.col("least") >= level, size - F.col("least") + level).otherwise(size)
        places = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        rows = rows.select(*kept, path.alias("parent"), F.explode(places).alias("at"))
        return rows.select("*", F.lit(level).alias("level"), F.concat("parent", F.lit(_PART), F.element_at("grams", F.col("at"))).alias("path"))

    def listed(rows: DataFrame, *keys: str) -> DataFrame:
        sides = rows.groupBy(*keys).agg(F.count_if("is_left").alias("l"), F.count_if("is_right").alias("r"), F.count("*").alias("n"), F.min("at").alias("first"))
        return sides.select(*keys, (F.col("l") * F.col("r")).alias("pairs"), "n", "first")

    rows, done, level = spread(texts.withColumn("least", _least_shared(F.length("text"), threshold)), 1, F.lit(1), F.lit("")), [], 1
    while True:
        rows = keep(rows.drop("parent"))
        long = keep(listed(rows, "path").where(F.col("pairs") > list_pairs).select(F.col("path").alias("parent"), "pairs", F.col("n").alias("all")))
        if level == DEPTH or (long.agg(F.sum("pairs")).first()[0] or 0) <= worth:
            return reduce(DataFrame.unionByName, done, rows)
        below = rows.withColumnRenamed("path", "parent").join(long.select("parent"), "parent", "left_semi")
        below = keep(spread(below, level + 1, F.col("at") + 1, F.col("parent")))
        parts = keep(listed(below, "parent", "path").withColumnRenamed("pairs", "part"))
        # the next gram of any pair of a list comes no later than the first that all its texts hold
        stops = parts.join(long, "parent").groupBy("parent", "pairs").agg(F.min_by("path", F.when(F.col("n") == F.col("all"), F.col("first"))).alias("stop"))
        gram = F.array_position("grams", F.element_at(F.split("stop", _PART), -1))
        below = below.join(stops, "parent").where(F.col("stop").isNull() | (F.col("at") <= gram))
        sums = listed(below, "parent", "path").groupBy("parent").agg(F.sum("pairs").alias("parts"))
        split = long.join(sums, "parent", "left").where(F.coalesce("parts", F.lit(0)) <= F.col("pairs"))
        split = keep(split.select(F.col("parent").alias("path"), F.lit(True).alias("split")))
        # texts that need share no more grams than the path has stay together in its list
        told = rows.join(split, "path", "left").where(F.col("split").isNull() | (F.col("least") <= level))
        done.append(told.select(*rows.columns))
        rows = below.drop("pairs", "stop").join(split.select(F.col("path").alias("parent")), "parent", "left_semi")
        level += 1


def candidates(left: DataFrame, right: DataFrame, threshold: int, list_pairs: int = LIST_PAIRS, worth: int = WORTH) -> DataFrame:
    """``(a, b)``, each pair of different texts (``left``, ``right``) that may be similar once, in the order of the texts."""
    sides = left.select(F.col("left").alias("text"), F.lit(True).alias("l")).unionByName(right.select(F.col("right").alias("text"), F.lit(False).alias("l")))
    texts = sides.where(F.col("text") != "").groupBy("text").agg(F.bool_or("l").alias("is_left"), F.bool_or(~F.col("l")).alias("is_right"))
    listed = _lists(keep(_ordered_grams(keep(texts))), threshold, list_pairs, worth)
    x, y = listed.alias("x"), listed.alias("y")
    a, b = F.length("x.text"), F.length("y.text")
    common = _common_length(a, b, threshold)
    shared = 3 * common - a - b + 1
    level = F.col("x.level")
    rest = F.least(F.size("x.grams") - F.col("x.at"), F.size("y.grams") - F.col("y.at"))
    fits = (
        (F.col("x.path") == F.col("y.path")) & (F.col("x.text") < F.col("y.text"))
        & ((F.col("x.is_left") & F.col("y.is_right")) | (F.col("y.is_left") & F.col("x.is_right")))
        & (F.greatest("x.least", "y.least") >= level) & (common <= F.least(a, b)) & (level + rest >= shared)
    )
    both = F.array_intersect("x.grams", "y.grams")
    met = x.join(y, fits).select(
        F.col("x.text").alias("a"), F.col("y.text").alias("b"), F.col("x.path").alias("path"), level.alias("level"), shared.alias("shared"), both.alias("both"),
        (F.col("x.is_left") & F.col("y.is_right")).alias("forth"), (F.col("y.is_left") & F.col("x.is_right")).alias("back"),
    )
    first = F.concat(F.lit(_PART), F.array_join(F.slice("both", F.lit(1), F.col("level")), _PART)) == F.col("path")
    return met.where((F.size("both") >= F.col("shared")) & first).select("a", "b", "forth", "back")


def similar_texts(left: DataFrame, right: DataFrame, threshold: int, list_pairs: int = LIST_PAIRS, worth: int = WORTH) -> DataFrame:
    """Pairs ``(left, right)`` of distinct texts, neither blank, that are at least that similar; equal texts are."""
    if not 200 / 3 < threshold <= 100:
        raise ValueError("two-letter grams find texts that are more than two thirds alike")
    close = candidates(left, right, threshold, list_pairs, worth).where(ratio(F.col("a"), F.col("b")) >= threshold)
    ways = F.array(
        F.when(F.col("forth"), F.struct(F.col("a").alias("left"), F.col("b").alias("right"))),
        F.when(F.col("back"), F.struct(F.col("b").alias("left"), F.col("a").alias("right"))),
    )
    unlike = close.select(F.explode(F.array_compact(ways)).alias("w")).select("w.left", "w.right")
    equal = left.select("left").where(F.col("left") != "").distinct().join(right.select("right").distinct(), F.col("left") == F.col("right"))
    return unlike.unionByName(equal.select("left", "right"))


def _class(size: Column) -> Column:
    return F.floor(F.log2(size)).cast("int")


def _windows(text: Column, widths: Column) -> Column:
    """(width, hash, place) of all windows of these widths, none longer than the text."""
    of_width = lambda w: F.transform(
        F.sequence(F.lit(1), F.length(text) - w + 1),
        lambda at: F.struct(w.alias("w"), F.xxhash64(F.substring(text, at, w)).alias("h"), at.alias("at")),
    )
    return F.flatten(F.transform(widths, of_width))


def _widths(small: dict[int, int], large: dict[int, int], more: int) -> tuple[list[int], list[tuple[int, int]]]:
    """The length classes listed by a window, and (width, least length of a long text) of the windows to look for.

    Both sides come as numbers of texts by length; a long text is longer by ``more`` at least. The texts of a class meet by
    their whole length or by a window, whatever makes fewer rows; windows of short texts are shuffled to be counted, too.
    """
    sizes = sorted(large)
    texts, letters = ([*accumulate((large[n] * by(n) for n in sizes[::-1]), initial=0)][::-1] for by in (lambda n: 1, lambda n: n + 1))

    def looked_for(width: int, least: int) -> int:
        at = bisect_left(sizes, least)
        return letters[at] - width * texts[at]

    windowed, widths = [], []
    for c in sorted({size.bit_length() - 1 for size in small}):
        own = sorted(size for size in small if size >> c == 1)
        as_whole = sum(small[size] + looked_for(size, size + more) for size in own)
        as_window = looked_for(1 << c, own[0] + more) + sum(3 * small[size] * (size - (1 << c) + 1) for size in own)
        if as_whole <= as_window:
            widths += [(size, size + more) for size in own]
        else:
            windowed.append(c)
            widths.append((1 << c, own[0] + more))
    return windowed, widths


def contained(small: DataFrame, large: DataFrame, proper: bool = False) -> DataFrame:
    """Pairs ``(small, large)`` of distinct texts, the first a part of the second and four characters or more.

    ``proper``: the second is longer, so that texts no shorter than all long ones, and windows of their length, are left alone.
    """
    more, size, longest = int(proper), F.length("small"), F.length("large")
    lengths = lambda rows, n: {r[0]: r[1] for r in rows.where(n >= CONTAINED_FROM).groupBy(n).count().collect()}
    of_large = lengths(large, longest)
    most = max(of_large, default=0) - more
    windowed, widths = _widths({n: count for n, count in lengths(small, size).items() if n <= most}, of_large, more)
    short = small.where((size >= CONTAINED_FROM) & (size <= most)).select("small").distinct()
    short = short.withColumn("w", F.when(_class(size).isin(windowed), F.call_function("shiftleft", F.lit(1), _class(size))).otherwise(size))
    whole = short.where(F.col("w") == size).select("small", "w", F.xxhash64("small").alias("h"), F.lit(1).alias("at"))
    parted = short.where(F.col("w") < size)
    own = keep(parted.select("small", F.explode(_windows(F.col("small"), F.array("w"))).alias("v")).select("small", "v.*"))
    # a text counts once a window, so what is shuffled are hashes and counts, not texts
    hashes = F.array_distinct(F.transform(_windows(F.col("small"), F.array("w")), lambda v: F.struct(v["w"].alias("w"), v["h"].alias("h"))))
    counts = parted.select(F.explode(hashes).alias("v")).groupBy("v.w", "v.h").agg(F.count("*").alias("n"))
    rarest = own.join(counts, ["w", "h"]).groupBy("small").agg(F.min(F.struct("n", "w", "h", "at")).alias("v")).select("small", "v.w", "v.h", "v.at")
    listed = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(least).alias("least")) for w, least in widths]).cast("array<struct<w:int,least:int>>")
    fitting = F.transform(F.filter(listed, lambda k: k["least"] <= longest), lambda k: k["w"])
    emitted = large.where(longest >= CONTAINED_FROM).select("large", F.explode(_windows(F.col("large"), fitting)).alias("v")).select("large", "v.w", "v.h", F.col("v.at").alias("place"))
    met = emitted.join(whole.unionByName(rarest), ["w", "h"]).where(F.substring("large", F.col("place") - F.col("at") + 1, size) == F.col("small"))
    return met.where((F.col("place") >= F.col("at")) & (size + more <= longest)).select("small", "large").distinct()
