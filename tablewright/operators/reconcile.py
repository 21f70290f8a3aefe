"""Invoices against payments.

Invoices are served in row order, and a payment is used once. A reference match takes every payment that is
still free and refers to the invoice; without one, the first free payment of a similar name and amount is
taken. Three facts turn this sequence into joins:

* Of all invoices a payment refers to, only the first matters: it leaves none behind for the later ones.
* A payment with a reference is free for similar names before its own invoice only, its deadline.
* Names without similar names in common cannot influence each other: such parts are replayed side by side. In parts too large
  for a task, invoices of one name and amount can take the same payments, so classes are compared and settled, not rows.
  Classes with the same counterparts count as one.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.numbers import strict_float
from tablewright.functions.similarity import token_sort_ratio
from tablewright.functions.text import clean_reference, sort_tokens, strip
from tablewright.operators.columns import ROW, data_columns
from tablewright.operators.privacy import carried
from tablewright.operators.simjoin import contained, similar_texts
from tablewright.session import keep_tidy as keep
from tablewright.session import release, step

# Names of the columns looked for, in order of preference, and the place taken otherwise.
CUSTOMER = (("customer_name", "customer", "client", "client_name", "party_name", "party", "name", "account"), 1)
INVOICE_NO = (("invoice_no", "invoice_num", "invoice", "inv_no", "orderid", "order_id", "bill_no", "id", "ref"), 0)
INVOICE_AMOUNT = (
    ("amount", "invoice_amount", "paid_amount", "revenue", "total", "net_amount", "grand_total", "price", "val"), 2,
)
PAYMENT_REF = (("payment_ref", "invoice_ref", "invoice_no", "invoice", "inv_no", "ref", "order_id", "orderid", "id"), 0)
PAID_AMOUNT = (("paid_amount", "amount", "payment_amount", "revenue", "total", "net_amount", "val"), 2)
# Limits of the match tests.
SIMILAR_AT, CONFLICT_BELOW, AMOUNT_GAP, AMOUNT_SHARE = 80, 60, 10.0, 0.05
#: Rows of a side that a task pairs with those of the other side at once; a bucket of more is cut.
SLICE_ROWS = 4096


def find_column(columns: Sequence[str], wanted: tuple[tuple[str, ...], int]) -> str:
    """The column with the best (place of a keyword it contains, own place), else the one at the given place."""
    keywords, place = wanted
    heads = [c.lower().strip().replace(" ", "_") for c in columns]
    hits = [(rank, at) for at, head in enumerate(heads) for rank, word in enumerate(keywords) if word in head]
    return columns[min(hits)[1] if hits else min(place, len(columns) - 1)]


def _side(df: DataFrame, ref, amount, prefix: str) -> DataFrame:
    columns = data_columns(df)
    amount_name = find_column(columns, amount)
    text = {"ref": find_column(columns, ref), "cust": find_column(columns, CUSTOMER)}
    fields = [strip(F.col(f"`{c}`").cast("string")) for c in text.values()]
    return df.select(
        F.col(ROW).cast("bigint").alias(prefix),
        *[F.coalesce(f, F.lit("nan")).alias(f"{prefix}_{n}") for n, f in zip(text, fields)],
        strict_float(F.col(f"`{amount_name}`"), df.schema[amount_name].dataType).alias(f"{prefix}_amt"),
    ).select(
        "*", clean_reference(F.col(f"{prefix}_ref")).alias(f"{prefix}_key"), sort_tokens(F.lower(f"{prefix}_cust")).alias(f"{prefix}_name")
    )


def invoices_view(invoices: DataFrame) -> DataFrame:
    return _side(invoices, INVOICE_NO, INVOICE_AMOUNT, "i")


def payments_view(payments: DataFrame) -> DataFrame:
    return _side(payments, PAYMENT_REF, PAID_AMOUNT, "p")


def first_referred(inv: DataFrame, pay: DataFrame) -> DataFrame:
    """``(p_key, i)``: the first invoice each payment reference points to, by equality or containment."""
    numbers = keep(inv.where(F.col("i_key") != "").groupBy("i_key").agg(F.min("i").alias("i")))
    refs = keep(pay.where(F.col("p_key") != "").select("p_key").distinct())
    texts, keys = numbers.select(F.col("i_key").alias("text")), refs.select(F.col("p_key").alias("text"))
    equal = refs.join(numbers, refs["p_key"] == numbers["i_key"]).select("p_key", "i")
    inside = contained(texts.select(F.col("text").alias("small")), keys.select(F.col("text").alias("large")), proper=True).select(
        F.col("large").alias("p_key"), F.col("small").alias("i_key")
    )
    around = contained(keys.select(F.col("text").alias("small")), texts.select(F.col("text").alias("large")), proper=True).select(
        F.col("small").alias("p_key"), F.col("large").alias("i_key")
    )
    found = inside.unionByName(around).join(numbers, "i_key").select("p_key", "i")
    return equal.unionByName(found).groupBy("p_key").agg(F.min("i").alias("i"))


def _width(amount: Column) -> Column:
    """How far a payment may be off."""
    return F.when(amount > 0, F.greatest(F.lit(AMOUNT_GAP), amount * AMOUNT_SHARE)).otherwise(F.lit(AMOUNT_GAP))


def _level(amount: Column) -> Column:
    """Power of two that covers the width, in units of ten."""
    return F.ceil(F.log2(_width(amount) / AMOUNT_GAP)).cast("int")


def _bucket(amount: Column, level: Column) -> Column:
    return F.floor(amount / (F.pow(F.lit(2.0), level) * AMOUNT_GAP))


def _met(asked: DataFrame, offered: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rows (b, i_amt, ...) of ``asked`` with rows (b, p_amt, ...) of ``offered`` of a close amount, each such pair once.

    Amounts meet in buckets as wide as the allowed gap. What the rows of a bucket meet is not shuffled again; a bucket of more
    than ``slice_rows`` rows of a side is cut into slices that all slices of the other side meet, each two in a place of their own.
    """
    amount, paid, more = F.col("i_amt"), F.col("p_amt"), 1 + 1e-9
    width = _width(amount) * more
    asked = asked.withColumn("_level", _level(amount))
    asked = asked.withColumn("_bucket", F.explode(F.sequence(_bucket(amount - width, F.col("_level")), _bucket(amount + width, F.col("_level")))))
    lowest = _level(F.least(paid / (1 + AMOUNT_SHARE) / more, paid - AMOUNT_GAP * more))
    highest = _level(F.greatest(paid / (1 - AMOUNT_SHARE) * more, paid + AMOUNT_GAP * more))
    offered = offered.withColumn("_level", F.explode(F.sequence(lowest, F.greatest(lowest, highest))))
    offered = offered.withColumn("_bucket", _bucket(paid, F.col("_level")))
    place = ["b", "_level", "_bucket"]
    slices = lambda rows, n: rows.groupBy(*place).agg(F.ceil(F.count("*") / slice_rows).alias(n)).where(F.col(n) > 1)
    large = keep(slices(asked, "_asked").join(slices(offered, "_offered"), place, "full"))

    def sliced(rows: DataFrame, own: str, other: str) -> DataFrame:
        key = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in place]), F.coalesce(own, F.lit(1)))
        met = F.sequence(F.lit(0).cast("bigint"), F.coalesce(other, F.lit(1)) - 1)
        return rows.join(large, place, "left").select(*rows.columns, key.alias(f"_of{own}"), F.explode(met).alias(f"_of{other}"))

    gap = F.abs(amount - paid)
    close = (gap <= AMOUNT_GAP) | ((amount > 0) & (gap / F.when(amount > 0, amount) <= AMOUNT_SHARE))
    return sliced(asked, "_asked", "_offered").join(sliced(offered, "_offered", "_asked"), [*place, "_of_asked", "_of_offered"]).where(close)


def _close_classes(inv: DataFrame, pay: DataFrame, names: DataFrame) -> DataFrame:
    """``(ic, pc)``: classes (a, i_amt) and (b, p_amt) of a close amount whose names are listed in ``names`` (a, b).

    Classes are numbered by their first row.
    """
    asked = inv.groupBy("a", "i_amt").agg(F.min("i").alias("ic"))
    offered = pay.groupBy("b", "p_amt").agg(F.min("p").alias("pc"))
    return _met(asked.join(names, "a"), offered).select("ic", "pc").distinct()


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def _reach(amount: pd.Series) -> pd.DataFrame:
    """The least and the greatest number close to each amount, by the very test that pairs have to pass."""
    a = amount.to_numpy(np.float64, na_value=np.nan)
    with np.errstate(all="ignore"):

        def close(paid: np.ndarray) -> np.ndarray:
            gap = np.abs(a - paid)
            return (gap <= AMOUNT_GAP) | ((a > 0) & (gap / np.where(a > 0, a, 1.0) <= AMOUNT_SHARE))

        width = np.where(a > 0, np.maximum(AMOUNT_GAP, a * AMOUNT_SHARE), AMOUNT_GAP)
        ends = []
        for out in (-np.inf, np.inf):
            end = a - width if out < 0 else a + width
            while (off := np.isfinite(a) & ~close(end)).any():
                end = np.where(off, np.nextafter(end, -out), end)
            while (more := np.isfinite(a) & close(further := np.nextafter(end, out))).any():
                end = np.where(more, further, end)
            ends.append(end + 0.0)
    return pd.DataFrame({"low": ends[0], "high": ends[1]})


#: Order of the rows of one amount: spans that begin, payments, spans that end.
_BEGIN, _PAID, _END = range(3)


def similar_links(inv: DataFrame, pay: DataFrame) -> DataFrame:
    """``(side, row, class_id, links)``: how many payments of a similar name and a close amount each invoice has, and the reverse.

    A class, numbered by its first row, is what has one name and amount. The amounts close to an invoice's form a span;
    on each name's line of amounts, the payments before the ends of a span and the spans that begin and end before a payment
    are running totals over sorted rows. So links are counted, never listed, and rows are sorted over all tasks.
    """
    classed = lambda rows, row: rows.groupBy(*[c for c in rows.columns if c != row]).agg(F.min(row).alias("class_id"), F.count("*").alias("n"))
    asked = keep(classed(inv.select("i", F.col("i_name").alias("left"), F.col("i_amt").alias("amount")), "i"))
    offered = keep(classed(pay.select("p", F.col("p_name").alias("right"), F.col("p_amt").alias("amount")), "p"))
    names = keep(similar_texts(asked.select("left").distinct(), offered.select("right").distinct(), SIMILAR_AT))
    finite, zero = F.abs(F.col("amount")) < float("inf"), F.lit(0).cast("bigint")
    spans = asked.where(finite).withColumn("reach", _reach(F.col("amount"))).join(names, "left")
    ends = [F.struct(F.col(f"reach.{e}").alias("at"), F.lit(k).alias("kind"), (F.col("n") * sign).alias("spans")) for e, k, sign in (("low", _BEGIN, 1), ("high", _END, -1))]
    spans = spans.select("right", "left", "amount", F.explode(F.array(*ends)).alias("end")).select("right", "end.*", zero.alias("paid"), "left", "amount")
    paid = offered.where(finite).join(names.select("right").distinct(), "right")
    paid = paid.select("right", (F.col("amount") + 0.0).alias("at"), F.lit(_PAID).alias("kind"), zero.alias("spans"), F.col("n").alias("paid"), F.lit(None).cast("string").alias("left"), "amount")
    line = spans.unionByName(paid).repartitionByRange("right", "at", "kind").withColumn("_part", F.spark_partition_id())
    line = keep(line.sortWithinPartitions("right", "at", "kind"))
    totals = line.groupBy("right", "_part").agg(F.sum("spans").alias("s"), F.sum("paid").alias("p"))
    earlier = Window.partitionBy("right").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("right", "_part", *[F.coalesce(F.sum(c).over(earlier), zero).alias(f"{c}_before") for c in "sp"])
    inside = Window.partitionBy("right", "_part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = line.withColumn("s", F.sum("spans").over(inside)).withColumn("p", F.sum("paid").over(inside)).join(before, ["right", "_part"])
    counted = counted.select("right", "left", "amount", "kind", (F.col("s") + F.col("s_before")).alias("s"), (F.col("p") + F.col("p_before")).alias("p"))
    of_asked = counted.where(F.col("kind") != _PAID).groupBy("left", "amount").agg(F.sum(F.when(F.col("kind") == _END, F.col("p")).otherwise(-F.col("p"))).alias("links"))
    of_offered = counted.where(F.col("kind") == _PAID).select("right", "amount", F.col("s").alias("links"))

    def listed(side: str, rows: DataFrame, row: str, classes: DataFrame, links: DataFrame, name: str) -> DataFrame:
        by_class = classes.join(links, [name, "amount"], "left").select(name, "amount", "class_id", F.coalesce("links", zero).alias("links"))
        return rows.select(F.col(row).alias("row"), F.col(f"{row}_name").alias(name), F.col(f"{row}_amt").alias("amount")).join(by_class, [name, "amount"]).select(
            F.lit(side).alias("side"), "row", "class_id", "links"
        )

    return listed("invoice", inv, "i", asked, of_asked, "left").unionByName(listed("payment", pay, "p", offered, of_offered, "right"))


def _in_class(rows: DataFrame, name: str, amount: str, row: str, number: str) -> DataFrame:
    """``rows`` with the number of their class."""
    return rows.join(rows.groupBy(name, amount).agg(F.min(row).alias(number)), [name, amount])


def similar_pairs(inv: DataFrame, pay: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``(i, p)`` of a similar name and a close amount, the payment not reserved for this or an earlier invoice.

    This lists every pair, whose number grows with the square of a name's rows; ``similar_links`` counts them. Only rows are
    shuffled, never pairs, and names are compared once per distinct pair.
    """
    lefts, rights = inv.select(F.col("i_name").alias("left")).distinct(), pay.select(F.col("p_name").alias("right")).distinct()
    names = keep(similar_texts(lefts, rights, SIMILAR_AT))
    finite = lambda c: F.abs(F.col(c)) < float("inf")
    asked = inv.where(finite("i_amt")).join(names.withColumnsRenamed({"left": "i_name", "right": "b"}), "i_name").select("b", "i_amt", "i")
    offered = pay.where(finite("p_amt")).select(F.col("p_name").alias("b"), "p_amt", "p", "reserved")
    free = F.col("reserved").isNull() | (F.col("reserved") > F.col("i"))
    return _met(asked, offered.join(names.select(F.col("right").alias("b")).distinct(), "b"), slice_rows).where(free).select("i", "p")


def _twins(edges: DataFrame, side: str, other: str) -> DataFrame:
    """``(side, twin)``: classes that meet the same classes of the other side, numbered by the least of them."""
    met = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64(other)).alias("x"), F.bit_xor(F.xxhash64(other, F.lit(other))).alias("y"))
    signed = edges.groupBy(side).agg(met.alias("met"))
    return signed.join(signed.groupBy("met").agg(F.min(side).alias("twin")), "met").select(side, "twin")


def ranked(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``rows`` with their ``rank`` (from 1) by ``order`` among those of equal ``key``, however many these are.

    Rows are sorted over all tasks; a task ranks its own, and the numbers of rows before, one per key and task, are added.
    """
    sorted_ = keep(rows.repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy(key, "_part").orderBy(order))
    counts = sorted_.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(key).orderBy("_part")) - F.col("_n")).drop("_n")
    return sorted_.withColumn("_inside", inside).join(before, [key, "_part"]).withColumn("rank", F.col("_inside") + F.col("_before")).drop("_inside", "_before", "_part")


#: Stands for no deadline.
NEVER = (1 << 63) - 1


def _seekers(asked: DataFrame, offered: DataFrame, edges: DataFrame) -> DataFrame:
    """The invoices that may ever look for a payment of a similar name; all others keep a payment of their own for sure.

    An invoice without own payments looks for one. One whose own payments can all go to earlier seekers may become one.
    """
    asked = keep(asked.withColumn("seeks", F.col("left") == 0))
    count = -1
    while (now := asked.where("seeks").count()) != count:
        count = now
        first = edges.join(asked.where("seeks").groupBy("a").agg(F.min("i").alias("i")), "a").groupBy("b").agg(F.min("i").alias("first"))
        lost = offered.join(first, "b").where(F.col("first") < F.col("deadline")).groupBy(F.col("deadline").alias("i")).agg(F.count("*").alias("lost"))
        asked = keep(asked.drop("lost").join(lost, "i", "left").withColumn("seeks", F.col("left") == F.coalesce("lost", F.lit(0))))
    return asked.where("seeks").select("i", "a", "left")


def _two_least(edges: DataFrame, side: str, other: str, value: str) -> DataFrame:
    """Per ``side``: the ``other`` class with the least ``value``, and the least value of the rest."""
    best = edges.groupBy(side).agg(F.min(F.struct(value, other)).alias("_m")).select(side, F.col(f"_m.{other}").alias("_best"))
    rest = F.min(F.when(F.col(other) != F.col("_best"), F.col(value)))
    return edges.join(best, side).groupBy(side, "_best").agg(F.coalesce(rest, F.lit(NEVER)).alias(f"{side}_rest")).withColumnRenamed("_best", other)


def fallback_matches(asked: DataFrame, offered: DataFrame, edges: DataFrame) -> DataFrame:
    """``(i, p)``: payments that invoices without an own one take by name and amount.

    ``asked``: (i, a, left), invoices with their class and the number of own payments still there; ``offered``: (p, b,
    deadline), payments with their class and the invoice they are own to; ``edges``: (a, b). The least free payment before
    its deadline goes to the least open invoice. In a round, two classes that both come first for each other are
    settled at once: the k-th invoice takes the k-th payment, as long as no other class comes first on either side,
    the invoice has lost its own payments and the payment its deadline still ahead.
    """
    asked, offered, taken, old = keep(_seekers(asked, offered, edges)), keep(offered), None, ()
    while True:
        takers = asked.groupBy("a").agg(F.min(F.struct("i", "left")).alias("t"), F.count("*").alias("n_a"))
        gifts = offered.groupBy("b").agg(F.min(F.struct("p", "deadline")).alias("g"), F.count("*").alias("n_b"))
        open_ = keep(edges.join(takers, "a").join(gifts, "b").select("a", "b", "t.*", "g.*", "n_a", "n_b"))
        if open_.isEmpty():
            return taken if taken is not None else asked.join(offered, F.lit(False)).select("i", "p")
        old, edges = (*old, asked, offered), open_.select("a", "b")
        # a payment that no earlier invoice looks for goes to its own invoice, which then looks no further
        met = offered.join(open_.groupBy("b").agg(F.min("i").alias("first")), "b").withColumn("kept", F.col("first") >= F.col("deadline"))
        served = met.where("kept").select(F.col("deadline").alias("i")).distinct()
        asked, offered = asked.join(served, "i", "left_anti"), met.where("not kept").select("p", "b", "deadline")
        pairs = open_.join(_two_least(open_, "a", "b", "p"), ["a", "b"]).join(_two_least(open_, "b", "a", "i"), ["a", "b"])
        fits = (F.col("left") == 0) & (F.col("i") < F.col("b_rest")) & (F.col("p") < F.col("a_rest")) & (F.col("i") < F.col("deadline"))
        pairs = keep(pairs.where(fits))
        now = pairs.select("i", "p", "deadline")
        runs = pairs.where((F.col("n_a") > 1) & (F.col("n_b") > 1)).select("a", "b", "a_rest", "b_rest")
        if not runs.isEmpty():
            both = ranked(asked.join(runs, "a"), "a", "i").join(ranked(offered.join(runs.select("b"), "b", "left_semi"), "b", "p"), ["b", "rank"])
            both = both.select("a", "rank", "i", "p", "deadline", fits.alias("fits"))
            stop = both.where("not fits").groupBy("a").agg(F.min("rank").alias("stop"))
            long = both.join(stop, "a", "left").where(F.col("rank") < F.coalesce("stop", F.lit(NEVER))).select("i", "p", "deadline")
            now = keep(now.unionByName(long).distinct())
        taken = now.select("i", "p") if taken is None else taken.unionByName(now.select("i", "p"))
        lost = now.groupBy(F.col("deadline").alias("i")).agg(F.count("*").alias("lost"))
        asked = asked.join(now.select("i"), "i", "left_anti").join(lost, "i", "left")
        asked = keep(asked.select("i", "a", (F.col("left") - F.coalesce("lost", F.lit(0))).alias("left")))
        offered = keep(offered.join(now.select("p"), "p", "left_anti"))
        for df in old:  # what this round replaced; its pairs stay
            release(df)
        old = (open_,)


#: Rows (invoices and payments) of a part that one task replays in order; parts with more are divided, then go by classes.
PART_CLAIMS = 2_000_000
#: Kinds of rows of a part: similar names, invoices that may look for a payment, payments they may look at.
_NAMES, _ASKED, _OFFERED = range(3)


def _close(amount: float, paid: float) -> bool:
    gap = abs(amount - paid)
    return gap <= AMOUNT_GAP or (amount > 0 and gap / amount <= AMOUNT_SHARE)


def _span(amounts: list[float], start: int, stop: int, amount: float) -> tuple[int, int]:
    """Which of the sorted ``amounts`` between two places are close to ``amount``."""
    width = (max(AMOUNT_GAP, amount * AMOUNT_SHARE) if amount > 0 else AMOUNT_GAP) * (1 + 1e-9)
    low, high = bisect_left(amounts, amount - width, start, stop), bisect_right(amounts, amount + width, start, stop)
    while low < high and not _close(amount, amounts[low]):
        low = bisect_right(amounts, amounts[low], low, high)
    while low < high and not _close(amount, amounts[high - 1]):
        high = bisect_left(amounts, amounts[high - 1], low, high)
    return low, high


class _Free:
    """The free payments of a part by name and amount, with the least one of any stretch of these."""

    def __init__(self, rows: pd.DataFrame) -> None:
        rows = rows.sort_values(["name", "amount"], kind="stable")
        self.ids, rank = np.unique(rows["row"].to_numpy(), return_inverse=True)
        self.amounts, name, self.none = rows["amount"].tolist(), rows["name"].to_numpy(), len(self.ids)
        firsts = np.flatnonzero(np.r_[True, name[1:] != name[:-1]]) if len(name) else np.zeros(0, np.int64)
        self.places = dict(zip(name[firsts].tolist(), zip(firsts.tolist(), [*firsts[1:].tolist(), len(name)])))
        order = np.argsort(rank, kind="stable")
        self.begins, self.at = np.searchsorted(rank[order], np.arange(self.none + 1)).tolist(), order.tolist()
        self.size = 1 << max(0, len(name) - 1).bit_length()
        levels = [np.r_[rank, np.full(self.size - len(name), self.none)]]
        while len(levels[-1]) > 1:
            levels.append(levels[-1].reshape(-1, 2).min(axis=1))
        self.least = [self.none, *np.concatenate(levels[::-1]).tolist()]
        due = rows["deadline"].to_numpy()
        ends = np.argsort(due, kind="stable")
        ends = ends[due[ends] < NEVER]
        self.due, self.due_rank, self.passed = due[ends].tolist(), rank[ends].tolist(), 0

    def take(self, rank: int) -> bool:
        """Whether the payment was free; now it is not."""
        least, was = self.least, False
        for k in range(self.begins[rank], self.begins[rank + 1]):
            node = self.at[k] + self.size
            was = was or least[node] != self.none
            least[node] = self.none
            node >>= 1
            while node:
                low = min(least[2 * node], least[2 * node + 1])
                if low == least[node]:
                    break
                least[node] = low
                node >>= 1
        return was

    def served(self, i: int) -> bool:
        """Invoices up to ``i`` take their own payments; whether this one finds any."""
        found = False
        while self.passed < len(self.due) and self.due[self.passed] <= i:
            found = (self.take(self.due_rank[self.passed]) and self.due[self.passed] == i) or found
            self.passed += 1
        return found

    def first(self, name: int, amount: float) -> int:
        """The least free payment of a name that is close."""
        if name not in self.places:
            return self.none
        (low, high), least, best = _span(self.amounts, *self.places[name], amount), self.least, self.none
        low, high = low + self.size, high + self.size
        while low < high:
            if low & 1:
                best = min(best, least[low])
                low += 1
            if high & 1:
                high -= 1
                best = min(best, least[high])
            low, high = low >> 1, high >> 1
        return best


def _replay(frame: pd.DataFrame) -> pd.DataFrame:
    """Invoices of one part in order: one without a free payment of its own takes the first similar one.

    The least free payment of each stretch of amounts is kept in a tree, so an invoice costs a logarithm for each similar name.
    """
    kinds, similar, out = frame["kind"], {}, []
    free = _Free(frame[kinds == _OFFERED])
    pairs = frame[kinds == _NAMES]
    for a, b in zip(pairs["row"].tolist(), pairs["name"].tolist()):
        similar.setdefault(a, []).append(b)
    asked = frame[kinds == _ASKED].sort_values("row", kind="stable")
    rows = zip(asked["row"].tolist(), asked["name"].tolist(), asked["amount"].tolist())
    for i, same in groupby(rows, key=itemgetter(0)):
        if free.served(i):
            continue
        best = min((free.first(b, amount) for _, a, amount in same for b in similar.get(a, ())), default=free.none)
        if best != free.none:
            free.take(best)
            out.append((i, int(free.ids[best])))
    return pd.DataFrame(out, columns=["i", "p"], dtype="int64")


def _parts(edges: DataFrame) -> DataFrame:
    """``(ic, part)``: classes that share counterparts, directly or through others, have the least number of these."""
    labels = keep(edges.groupBy("pc").agg(F.min("ic").alias("part")))
    while True:
        near = keep(edges.join(labels, "pc").groupBy("ic").agg(F.min("part").alias("part")))
        near = near.join(near.select(F.col("ic").alias("part"), F.col("part").alias("far")), "part", "left").select("ic", F.least("part", "far").alias("part"))
        lower = keep(edges.join(near, "ic").groupBy("pc").agg(F.min("part").alias("part")))
        if lower.join(labels.withColumnRenamed("part", "old"), "pc").where("part <> old").isEmpty():
            return keep(near)
        labels = lower


def _sized(rows: DataFrame, part_claims: int) -> tuple[DataFrame, DataFrame]:
    """The numbers of the ``part``s with at most ``part_claims`` rows, and of the others."""
    sizes = keep(rows.groupBy("part").agg(F.count("*").alias("n")))
    return sizes.where(F.col("n") <= part_claims).select("part"), sizes.where(F.col("n") > part_claims).select("part")


def _replayed(asked: DataFrame, offered: DataFrame, names: DataFrame) -> DataFrame:
    """``(i, p)``: what invoices take by name and amount, a part a task.

    ``asked``: (part, i, a, i_amt); ``offered``: (part, p, b, p_amt, deadline); ``names``: (part, a, b), similar ones.
    """
    none, zero = F.lit(NEVER).alias("deadline"), F.lit(0.0).alias("amount")
    row, name = lambda c: F.col(c).alias("row"), lambda c: F.col(c).alias("name")
    kind = lambda k: F.lit(k).alias("kind")
    rows = names.select("part", kind(_NAMES), row("a"), name("b"), zero, none)
    rows = rows.unionByName(asked.select("part", kind(_ASKED), row("i"), name("a"), F.col("i_amt").alias("amount"), none))
    rows = rows.unionByName(offered.select("part", kind(_OFFERED), row("p"), name("b"), F.col("p_amt").alias("amount"), "deadline"))
    return rows.groupBy("part").applyInPandas(_replay, "i bigint, p bigint")


def match_payments(inv: DataFrame, pay: DataFrame, part_claims: int = PART_CLAIMS) -> DataFrame:
    """``(i, p)``: the payments each invoice uses.

    Names that have no similar name in common cannot influence each other. Such a part is replayed in order by a task if it
    has at most ``part_claims`` rows; a larger one is divided by amounts, and what is still larger is settled class by class, in rounds.
    No list of pairs is built but of classes in the latter.
    """
    # Payments without reference refer to nothing, however many there are.
    blank = F.coalesce("p_key", F.lit("")) == ""
    shown = ["p", "p_name", "p_amt", "reserved"]

    def referring() -> DataFrame:
        referred = first_referred(inv, pay).withColumnRenamed("i", "reserved")
        unreferred = pay.where(blank).withColumn("reserved", F.lit(None).cast("bigint"))
        return pay.where(~blank).join(referred, "p_key", "left").select(*shown).unionByName(unreferred.select(*shown))

    pay_to = step(referring)
    found = step(lambda: _similar_matches(inv, pay_to, part_claims))
    own = pay_to.where(F.col("reserved").isNotNull()).select(F.col("reserved").alias("i"), "p")
    used = keep(found.unionByName(own.join(found.select("p"), "p", "left_anti").select("i", "p")))
    release(pay_to)
    release(found)
    return used


def _similar_matches(inv: DataFrame, pay: DataFrame, part_claims: int) -> DataFrame:
    """``(i, p)``: the payments that invoices take by name and amount, those with a payment of their own left out."""
    own = pay.where(F.col("reserved").isNotNull()).select(F.col("reserved").alias("i"), "p")
    forms = inv.select(F.col("i_name").alias("name")).union(pay.select("p_name")).distinct()
    forms = keep(keep(forms).withColumn("number", F.monotonically_increasing_id()))
    lefts, rights = inv.select(F.col("i_name").alias("left")).distinct(), pay.select(F.col("p_name").alias("right")).distinct()
    a, b = (forms.select(F.col("name").alias(side), F.col("number").alias(n)) for side, n in (("left", "a"), ("right", "b")))
    names = keep(similar_texts(lefts, rights, SIMILAR_AT).join(a, "left").join(b, "right").select("a", "b"))
    finite = lambda c: F.abs(F.col(c)) < float("inf")
    deadline = F.coalesce("reserved", F.lit(NEVER)).alias("deadline")
    offered = pay.where(F.col("p").isNotNull() & finite("p_amt")).join(b.withColumnRenamed("right", "p_name"), "p_name")
    offered = keep(offered.select("p", "b", "p_amt", deadline).join(names.select("b").distinct(), "b"))
    # an invoice with a payment that nobody else may take never looks for one
    safe = own.join(offered.select("p"), "p", "left_anti").select("i").distinct()
    asked = inv.where(F.col("i").isNotNull()).join(a.withColumnRenamed("left", "i_name"), "i_name").select("i", "a", "i_amt")
    # an invoice belongs to the part of the payments it may lose, too
    tied = offered.join(asked.select(F.col("i").alias("deadline"), "a"), "deadline").select("a", "b")
    part_of = step(lambda: _parts(names.unionByName(tied).distinct().toDF("ic", "pc"))).withColumnRenamed("ic", "a")
    asked = keep(asked.where(finite("i_amt")).join(safe, "i", "left_anti").join(part_of, "a"))
    names = keep(names.join(part_of, "a"))
    offered = keep(offered.join(names.select("b", "part").distinct(), "b"))
    small, large = _sized(asked.select("part").unionByName(offered.select("part")), part_claims)
    found = _replayed(*(rows.join(small, "part", "left_semi") for rows in (asked, offered, names)))
    if large.isEmpty():
        return found
    return keep(found).unionByName(_divided(*(keep(rows.join(large, "part", "left_semi").drop("part")) for rows in (asked, offered, names)), part_claims))


def _divided(asked: DataFrame, offered: DataFrame, names: DataFrame, part_claims: int) -> DataFrame:
    """``(i, p)`` of large parts, whose classes of a name and an amount fall into parts of their own."""
    asked = keep(_in_class(asked, "a", "i_amt", "i", "ic"))
    offered = keep(_in_class(offered, "b", "p_amt", "p", "pc"))
    alike = keep(_close_classes(asked, offered, names))
    offered = keep(offered.join(alike.select("pc").distinct(), "pc"))
    tied = offered.join(asked.select(F.col("i").alias("deadline"), "ic"), "deadline").select("ic", "pc")
    part_of = _parts(alike.unionByName(tied).distinct())
    asked = keep(asked.join(part_of, "ic"))
    offered = keep(offered.join(alike.join(part_of, "ic").select("pc", "part").distinct(), "pc"))
    small, large = _sized(asked.select("part").unionByName(offered.select("part")), part_claims)
    some, rows = asked.join(small, "part", "left_semi"), offered.join(small, "part", "left_semi")
    found = _replayed(some, rows, some.select("part", "a").distinct().join(names, "a"))
    if large.isEmpty():
        return found
    asked, offered = asked.join(large, "part", "left_semi"), offered.join(large, "part", "left_semi")
    mine = offered.groupBy(F.col("deadline").alias("i")).agg(F.count("*").alias("left"))
    asked = keep(asked.select("i", "ic").join(mine, "i", "left").withColumn("left", F.coalesce("left", F.lit(0))))
    edges = keep(alike.join(asked.select("ic").distinct(), "ic", "left_semi"))
    return found.unionByName(_by_classes(asked, keep(offered.select("p", "pc", "deadline")), edges))


def _by_classes(asked: DataFrame, offered: DataFrame, alike: DataFrame) -> DataFrame:
    """``fallback_matches`` of the classes in ``alike``, those with the same counterparts as one."""
    of_ic = keep(_twins(alike, "ic", "pc").withColumnRenamed("twin", "a"))
    edges = alike.join(of_ic, "ic").select("a", "pc").distinct()
    of_pc = keep(_twins(edges, "pc", "a").withColumnRenamed("twin", "b"))
    edges = keep(edges.join(of_pc, "pc").select("a", "b").distinct())
    return fallback_matches(asked.join(of_ic, "ic").select("i", "a", "left"), offered.join(of_pc, "pc").select("p", "b", "deadline"), edges)


def _money(c: Column) -> Column:
    return F.concat(F.lit("₹"), F.format_number(c, 2))


def payment_ledger(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Status of every invoice, and a row per payment without invoice.

    Columns of tables that carry their class (``privacy.marked``) pass it on, the customer's name also to the explanation.
    """
    inv, pay = keep(invoices_view(invoices)), keep(payments_view(payments))
    used = match_payments(inv, pay)
    settled = keep(pay.select("p", "p_ref", "p_cust", "p_amt").join(used, "p", "left"))
    release(pay)
    release(used)
    paid = settled.where(F.col("i").isNotNull()).groupBy("i").agg(
        F.count("*").alias("n"), F.sum("p_amt").alias("paid"), F.min_by("p_cust", "p").alias("p_cust")
    )
    joined = inv.join(paid, "i", "left")
    both = (F.col("i_cust") != "") & (F.col("p_cust") != "")
    sim = token_sort_ratio(F.lower("i_cust"), F.lower(F.coalesce("p_cust", F.lit(""))))
    rated = joined.withColumn("sim", sim)
    amount, total = F.col("i_amt"), F.coalesce("paid", F.lit(0.0))
    gap = F.abs(amount - total)
    n = F.coalesce("n", F.lit(0))
    status = (
        F.when(n == 0, "Unmatched").when(n > 1, "Duplicate").when(both & (F.col("sim") < CONFLICT_BELOW), "Conflict")
        .when(gap > AMOUNT_GAP, "Partial").otherwise("Matched")
    )
    details = (
        F.when(n == 0, "No matching payment record found.")
        .when(n > 1, F.concat(F.lit("Multiple payments found referencing this invoice: "), n.cast("string"), F.lit(" records.")))
        .when(status == "Conflict", F.concat(F.lit("Name mismatch: Invoice customer '"), F.col("i_cust"), F.lit("' vs Payment customer '"), F.col("p_cust"), F.lit("'.")))
        .when(status == "Partial", F.concat(F.lit("Discrepancy: "), _money(gap), F.lit(" difference (Invoice: "), _money(amount), F.lit(", Paid: "), _money(total), F.lit(").")))
        .otherwise("Payment matches invoice reference and amount.")
    )
    served = rated.select(
        F.when(F.col("i_ref") == "", F.concat(F.lit("INV-"), F.col("i").cast("string"))).otherwise(F.col("i_ref")).alias("invoice_no"),
        F.when(F.col("i_cust") == "", "Unknown Customer").otherwise(F.col("i_cust")).alias("customer"),
        F.round(amount, 2).alias("invoice_amount"), F.round(total, 2).alias("paid_amount"), status.alias("status"), details.alias("details"),
    )
    over = settled.where(F.col("i").isNull()).select(
        F.col("p_ref").alias("invoice_no"), F.col("p_cust").alias("customer"), F.lit(0.0).alias("invoice_amount"),
        F.round("p_amt", 2).alias("paid_amount"), F.lit("Unmatched Payment").alias("status"),
        F.lit("Payment received without corresponding invoice record.").alias("details"),
    )
    sides = [(df, data_columns(df)) for df in (invoices, payments)]
    made_of = {
        "invoice_no": (INVOICE_NO, PAYMENT_REF), "customer": (CUSTOMER, CUSTOMER), "invoice_amount": (INVOICE_AMOUNT, None),
        "paid_amount": (None, PAID_AMOUNT), "details": (CUSTOMER, CUSTOMER),
    }

    def passed_on(name: str) -> dict[str, object]:
        parts = [df.select(F.col(f"`{find_column(columns, wanted)}`")) for (df, columns), wanted in zip(sides, made_of.get(name, ())) if wanted]
        both = {k: v for part in parts for k, v in carried(part, *part.columns).items()}
        return both

    ledger = served.unionByName(over)
    return ledger.select(*[F.col(c).alias(c, metadata=m) if (m := passed_on(c)) else F.col(c) for c in ledger.columns])


def ledger_stats(ledger: DataFrame) -> DataFrame:
    """Count and share per status, the two kinds of unmatched rows together; payments alone count as none."""
    status = F.when(F.col("status") == "Unmatched Payment", "Unmatched").otherwise(F.col("status"))
    names = {"matched": "Matched", "partial": "Partial", "unmatched": "Unmatched", "duplicate": "Duplicate", "conflict": "Conflict"}
    counts = [F.count_if(status == v).alias(k) for k, v in names.items()]
    totals = ledger.agg(F.count("*").alias("total"), F.count_if(F.col("status") != "Unmatched Payment").alias("invoices"), *counts)
    share = {k: F.coalesce(F.bround(F.try_divide(F.col(k) * F.lit(1.0), F.col("total")) * 100, 1), F.lit(0.0)) for k in names}
    shown = {k: F.col(k) for k in names} | {"unmatched": F.when(F.col("invoices") > 0, F.col("unmatched")).otherwise(0)}
    return totals.select(*[c.alias(k) for k, c in shown.items()], *[s.alias(f"{k}_pct") for k, s in share.items()])
