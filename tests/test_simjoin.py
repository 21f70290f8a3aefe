"""Similarity and containment joins against all pairs, and the number of candidates."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tablewright import session
from tablewright.functions.similarity import _lcs
from tablewright.operators import names, reconcile, simjoin


def ratio(a, b):
    return 200.0 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def texts_like(rng, base, count):
    out = set(base)
    while len(out) < count:
        t = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(t) + 1)
            t.insert(at, rng.choice("abxé .")) if rng.random() < 0.5 or not t else t.pop(min(at, len(t) - 1))
        out.add("".join(t))
    return sorted(out)


@pytest.mark.parametrize(("threshold", "list_pairs"), [(80, 1024), (85, 2), (70, 1), (100, 30)])
def test_similar_texts_equal_all_pairs(spark, threshold, list_pairs):
    rng = random.Random(threshold + list_pairs)
    base = ["a", "ab", "aaaa", "banana", "anna annan", "Rahul Patel", "Alice Wilson", "Customer 00001234", "Bo", "Xi Yu", "Maria del Carmen Lopez", "x" * 70, ""]
    pool = texts_like(rng, base, 130)
    left, right = rng.sample(pool, 90), rng.sample(pool, 90)
    want = sorted((a, b) for a in left for b in right if a and b and ratio(a, b) >= threshold)
    l_df, r_df = (spark.createDataFrame([(t,) for t in side], f"{name} string") for side, name in ((left, "left"), (right, "right")))
    got = [(r.left, r.right) for r in simjoin.similar_texts(l_df, r_df, threshold, list_pairs, worth=0).collect()]
    assert sorted(got) == want


def test_pairs_looked_at_grow_slower_than_the_names(spark):
    rng, tested = random.Random(4), {}
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9)))
    for count in (2000, 8000):
        made = spark.createDataFrame([(f"{word()} {word()}", True, True) for _ in range(count)], "text string, is_left boolean, is_right boolean")
        lists = simjoin._lists(simjoin._ordered_grams(made), 80).groupBy("level", "path").count()
        tested[count] = lists.agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0] / count
    assert tested[8000] < 2 * tested[2000]


def test_contained_equals_all_pairs(spark):
    rng = random.Random(9)
    small = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 20))) for _ in range(120)} | {f"inv0000{i}" for i in range(40)} | {"日本語です", "xyz"}
    large = {"".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(120)} | {f"wire inv0000{i} part" for i in range(0, 40, 3)} | {"これは日本語ですね", ""}
    want = sorted((s, t) for s in small for t in large if len(s) >= 4 and s in t)
    s_df, l_df = spark.createDataFrame([(s,) for s in small], "small string"), spark.createDataFrame([(t,) for t in large], "large string")
    found = simjoin.contained(s_df, l_df)
    assert sorted((r.small, r.large) for r in found.collect()) == want
    assert simjoin.contained(s_df.where("false"), l_df).count() == simjoin.contained(s_df, l_df.where("false")).count() == 0


def test_the_plan_does_not_grow_with_the_lengths(spark):
    plans = set()
    for lengths in (range(5, 7), range(5, 60)):
        small = spark.createDataFrame([("x" * n,) for n in lengths], "small string")
        large = spark.createDataFrame([("y" + "x" * n,) for n in lengths], "large string")
        plans.add(simjoin.contained(small, large)._jdf.queryExecution().analyzed().toString().count("\n"))
    assert len(plans) == 1


def test_equal_invoices_are_settled_in_few_rounds(spark, monkeypatch):
    rounds = []
    plain = reconcile._two_least
    monkeypatch.setattr(reconcile, "_two_least", lambda *a: rounds.append(1) or plain(*a))
    inv = spark.createDataFrame([(i, f"INV-{i:04d}", "Ann Smith", 100.0) for i in range(500)], "_row_idx long, Invoice_No string, Customer_Name string, Amount double")
    pay = spark.createDataFrame([(p, "", "Ann Smith" if p % 2 else "Ann Smyth", 100.0) for p in range(600)], "_row_idx long, Payment_Ref string, Customer string, Paid_Amount double")
    found = reconcile.match_payments(reconcile.invoices_view(inv), reconcile.payments_view(pay), part_claims=0)
    assert sorted((r.i, r.p) for r in found.collect()) == [(i, i) for i in range(500)]
    assert len(rounds) / 2 < 10


def test_ranks_over_many_tasks(spark):
    rows = spark.range(1000).select((F.col("id") % 3 * (F.col("id") % 2)).alias("k"), F.xxhash64("id").alias("o")).repartition(5)
    got = {}
    for r in reconcile.ranked(rows, "k", "o").collect():
        got.setdefault(r.k, []).append((r["rank"], r.o))
    for some in got.values():
        some.sort()
        assert [k for k, _ in some] == list(range(1, len(some) + 1)) and [o for _, o in some] == sorted(o for _, o in some)


def test_names_in_small_batches(spark):
    texts = texts_like(random.Random(2), ["Rahul Patel", "Alice Wilson", "Bo", "Maria del Carmen Lopez"], 60)
    forms = spark.createDataFrame([(t,) for t in texts if t], "norm string")
    whole, parts = ({r.norm: r.leader for r in names.leaders_of_names(forms, batch=b).collect()} for b in (1000, 7))
    assert whole == parts and set(whole) == {t for t in texts if t}


def test_longer_texts_alone_are_looked_into(spark):
    """Windows are made of texts that can hold a shorter one, by whole lengths or by windows, whichever is less."""
    assert simjoin._widths({12: 1000}, {12: 950, 20: 50}, 1) == ([], [(12, 13)])
    assert simjoin._widths(dict.fromkeys(range(8, 16), 1), {40: 1000}, 0) == ([3], [(8, 8)])
    rng = random.Random(10)
    some = lambda count, *sizes: {"".join(rng.choice("ab") for _ in range(rng.choice(sizes))) for _ in range(count)}
    for small, large in ((some(60, 6, 12), some(60, 6, 12, 20)), (some(60, *range(1, 24)), some(60, *range(60))), (some(20, 12), some(20, 5, 12))):
        s_df, l_df = spark.createDataFrame([(s,) for s in small], "small string"), spark.createDataFrame([(t,) for t in large], "large string")
        for proper in (False, True):
            want = sorted((s, t) for s in small for t in large if len(s) >= 4 and s in t and not (proper and s == t))
            assert sorted((r.small, r.large) for r in simjoin.contained(s_df, l_df, proper).collect()) == want


def test_the_ledger_deletes_what_its_steps_wrote(spark):
    """Tables and shuffle files of the steps would add up on disk."""
    at = session.shared_folder(spark).removeprefix("file:")
    tables = lambda: set(os.listdir(at)) if os.path.isdir(at) else set()
    shuffled = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    inv = spark.createDataFrame([(i, f"INV-{i:04d}", "Ann Smith", 100.0) for i in range(30)], "_row_idx long, Invoice_No string, Customer_Name string, Amount double")
    pay = spark.createDataFrame([(p, f"wire INV-{p:04d} part" if p % 3 else "", "Ann Smyth", 100.0) for p in range(30)], "_row_idx long, Payment_Ref string, Customer string, Paid_Amount double")
    before = tables()
    ledger = reconcile.payment_ledger(inv, pay)
    assert len(tables() - before) <= 2 and ledger.where("status = 'Matched'").count() == 30
    files = shuffled()
    kept = session.keep_tidy(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert shuffled() == files and kept.count() == 7
