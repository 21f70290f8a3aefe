"""Order-dependent operators against small sequential models written for the test."""

import hashlib
import random
import re

import pytest

from tablewright.functions.similarity import _lcs
from tablewright.operators import entities, names, reconcile
from tablewright.plans import business_plans


def ratio(a, b):
    return 200.0 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort(a, b):
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def norm(text):
    return " ".join(re.sub(r"[^\w\s]", "", text.lower()).split())


def ledger_model(invoices, payments):
    used, out = set(), {}
    key = lambda s: s.replace("-", "").replace(" ", "").lower()
    for i, no, cust, amt in invoices:
        a = key(no)
        hits = []
        for p, ref, _, _ in payments:
            b = key(ref)
            if p not in used and a and b and (a == b or (len(a) > 3 and a in b) or (len(b) > 3 and b in a)):
                hits.append(p)
        if not hits:
            for p, _, name, paid in payments:
                if p in used or not cust or not name or token_sort(cust.lower(), name.lower()) < 80:
                    continue
                gap = abs(amt - paid)
                if gap <= 10 or (amt > 0 and gap / amt <= 0.05):
                    hits = [p]
                    break
        used.update(hits)
        out[i] = set(hits)
    return out


def test_payments_match_the_sequence(spark):
    rng = random.Random(3)
    people = ["Ann Smith", "Ann Smyth", "Smith Ann", "Bo Li", "Bo Lee", "Carla Gomez", "Carl Gomez"]
    for trial in range(3):
        inv = [(i, rng.choice([f"INV-{i:03d}", f"INV-{i:03d}", f"INV-{i // 2:03d}", "", "A1"]), rng.choice(people), rng.choice([100.0, 104.0, 95.0, 9.0, -5.0, 1000.0])) for i in range(60)]
        pay = [
            (p, rng.choice([f"INV{rng.randrange(60):03d}", f"x INV-{rng.randrange(60):03d} y", "", "A1", "INV0", "zzz"]), rng.choice(people), rng.choice([100.0, 103.0, 96.0, 9.0, -5.0, 1000.0, 1049.0]))
            for p in range(70)
        ]
        want = {(i, p) for i, ps in ledger_model(inv, pay).items() for p in ps}
        i_df = spark.createDataFrame(inv, "_row_idx long, Invoice_No string, Customer_Name string, Amount double")
        p_df = spark.createDataFrame(pay, "_row_idx long, Payment_Ref string, Customer string, Paid_Amount double")
        views = reconcile.invoices_view(i_df), reconcile.payments_view(p_df)
        limit = 3 if trial == 2 else reconcile.PART_CLAIMS
        got = {(r.i, r.p) for r in reconcile.match_payments(*views, limit).collect()}
        assert got == want, trial


def test_ledger_statuses(spark):
    inv = spark.createDataFrame(
        [(0, "INV-101", "Rahul Patel", 10000.0), (1, "INV-102", "Alice Smith", 15000.0), (2, "INV-103", "Bob", 5.0), (3, "INV-104", "Eve Long", 70.0), (4, "INV-105", "Dan Brown", 40.0)],
        "_row_idx long, Invoice_No string, Customer_Name string, Amount double",
    )
    pay = spark.createDataFrame(
        [(0, "INV-101", "Rahul Patel", 10000.0), (1, "INV-102", "Alice Smith", 14950.0), (2, "INV104", "Someone Else", 70.0), (3, "INV-105", "Dan Brown", 20.0), (4, "INV-105", "Dan Brown", 20.0), (5, "??", "Nobody", 1.0)],
        "_row_idx long, Payment_Ref string, Customer string, Paid_Amount double",
    )
    rows = {r.invoice_no: r for r in reconcile.payment_ledger(inv, pay).collect()}
    assert {k: v.status for k, v in rows.items()} == {
        "INV-101": "Matched", "INV-102": "Partial", "INV-103": "Unmatched", "INV-104": "Conflict", "INV-105": "Duplicate", "??": "Unmatched Payment",
    }
    assert rows["INV-102"].details == "Discrepancy: ₹50.00 difference (Invoice: ₹15,000.00, Paid: ₹14,950.00)."


def name_model(texts):
    forms = sorted({norm(t.strip()) for t in texts if t.strip()})
    leader, open_forms = {}, sorted(forms, key=lambda f: hashlib.md5(f.encode()).hexdigest())
    while open_forms:
        first, rest = open_forms[0], open_forms[1:]
        leader[first] = first
        keep = []
        for other in rest:
            inside = len(first) > 3 and len(other) > 3 and (first in other or other in first)
            if ratio(first, other) >= 85 or inside:
                leader[other] = first
            else:
                keep.append(other)
        open_forms = keep
    return leader


def test_name_clusters_match_the_sequence(spark):
    rng = random.Random(5)
    base = ["Rahul Patel", "Alice Wilson", "Customer 00001234", "Bo", "Xi Yu", "Maria del Carmen Lopez"]
    texts = list(base)
    for _ in range(150):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(t) + 1)
            t.insert(at, rng.choice("abcxyz .")) if rng.random() < 0.5 or not t else t.pop(min(at, len(t) - 1))
        texts.append("".join(t))
    frame = spark.createDataFrame([(t,) for t in texts], "name string")
    forms = spark.createDataFrame([(f,) for f in {norm(t.strip()) for t in texts if t.strip()}], "norm string")
    want = name_model(texts)
    for limits in ({}, {"batch": 20}):
        got = {r.norm: r.leader for r in names.leaders_of_names(forms, **limits).collect()}
        assert got == want
    spelled = {t.strip() for t in texts if t.strip()}
    heads = {f: min(t for t in spelled if norm(t) == f) for f in want}
    groups = {}
    for t in spelled:
        groups.setdefault(heads[want[norm(t)]], set()).add(t)
    found = {r.primary: r.variations for r in names.name_clusters(frame).collect()}
    assert found == {head: len(some) - 1 for head, some in groups.items() if len(some) > 1}


def entity_model(records):
    blocks = {}
    for rec, key, feats in records:
        blocks.setdefault(key, []).append((rec, feats))
    out = {}
    for rows in blocks.values():
        leads = []
        for rec, (name, phone, email, tax) in rows:
            n = norm(name)
            for lead, (ln, lp, le, lt) in leads:
                ok = lambda x: x and x.strip().lower() != "nan"
                p10 = lambda x: re.sub(r"\D", "", x)[-10:]
                same = (ok(lt) and lt == tax) or (ok(le) and le == email) or (ok(lp) and p10(lp) == p10(phone))
                if same or (norm(ln) and n and token_sort(norm(ln), n) >= 80):
                    out[rec] = lead
                    break
            else:
                leads.append((rec, (name, phone, email, tax)))
                out[rec] = rec
    return out


def test_entities_match_the_sequence(spark):
    rng = random.Random(7)
    middle = ["", "k ", "kumar ", "bartholomew ", "constantine ", "alexander maximilian ", "q r s t u v "]
    rows = []
    for i in range(300):
        name = f"{rng.choice(['Joh', 'John', 'Johanna'])} {rng.choice(middle)}{rng.choice(['Smith', 'smith.'])}"
        email = rng.choice(["", "", "", "A@x.org", "a@x.org "])
        rows.append((i, name, rng.choice(["", "-", "12", "+1 9876543210"]), email, rng.choice(["", "", "nan", "24aaaap1234f1z9", "24AAAAP1234F1Z9"])))
    table = spark.createDataFrame(rows, "_row_idx long, Customer_Name string, Phone string, Email string, GSTIN string")
    mapping = {t: {"s": t} for t in ("Customer_Name", "Phone", "Email", "GSTIN")}
    records = entities.unify([("s", table)], mapping)
    keyed = [(r._rec, r._block, (r.name, r.rec_phone, r.rec_email, r.rec_gstin)) for r in records.orderBy("_rec").collect()]
    want = entity_model(keyed)
    for batch in (2000, 2):
        got = {r._rec: r._entity_id for r in entities.resolve(records, batch).collect()}
        assert got == want, batch
    shuffled = entities.resolve(records.repartition(7, "name"), 3)
    assert {r._rec: r._entity_id for r in shuffled.collect()} == want


def test_a_part_of_many_claims_is_replayed():
    """All payments are close to all invoices; some are own to an invoice that an earlier one may rob."""
    import pandas as pd

    rng = random.Random(5)
    count, never = 400, reconcile.NEVER
    asked = [(i, 1, 1000.0 + rng.randrange(120)) for i in range(count)]
    offered = [(p, rng.choice([1, 2]), 1000.0 + rng.randrange(120), rng.choice([never, rng.randrange(count)])) for p in range(count)]
    rows = [(0, 1, 1, 0.0, never), (0, 1, 2, 0.0, never)] + [(1, *a, never) for a in asked] + [(2, *o) for o in offered]
    frame = pd.DataFrame(rows, columns=["kind", "row", "name", "amount", "deadline"])
    used, want = set(), []
    for i, _, amount in asked:
        own = [p for p, _, _, due in offered if due == i and p not in used]
        used.update(own)
        near = [p for p, _, paid, due in offered if p not in used and abs(amount - paid) / amount <= 0.05]
        if not own and near:
            used.add(near[0])
            want.append((i, near[0]))
    assert [*reconcile._replay(frame).itertuples(index=False, name=None)] == want and len(want) > 100
    big = 20_000
    rows = [(0, 1, 1, 0.0, never)] + [(1, i, 1, 1000.0 + i / 1000, never) for i in range(big)] + [(2, p, 1, 1000.0 + p / 1000, never) for p in range(big)]
    found = reconcile._replay(pd.DataFrame(rows, columns=["kind", "row", "name", "amount", "deadline"]))
    assert (found.i == found.p).all() and len(found) == big


def test_links_are_counted_as_listed(spark):
    rng = random.Random(6)
    people = ["Ann Smith", "Ann Smyth", "Bo Li", "Carla Gomez"]
    amounts = [100.0, 110.0, 110.01, 95.0, 105.0, 200.0, 190.0, 210.0, 0.0, -5.0, -15.0, 1000.1, 950.095, 1050.105, float("inf"), float("nan")]
    inv = spark.createDataFrame([(i, f"INV-{i}", rng.choice(people), rng.choice(amounts)) for i in range(80)], "_row_idx long, Invoice_No string, Customer_Name string, Amount double")
    pay = spark.createDataFrame([(p, "", rng.choice(people), rng.choice(amounts)) for p in range(90)], "_row_idx long, Payment_Ref string, Customer string, Paid_Amount double")
    a, b = inv.collect(), pay.collect()
    near = lambda x, y: abs(x - y) <= 10 or (0 < x < float("inf") and abs(x - y) / x <= 0.05)
    pairs = [(x._row_idx, y._row_idx) for x in a for y in b if token_sort(x.Customer_Name.lower(), y.Customer.lower()) >= 80 and near(x.Amount, y.Paid_Amount)]
    want = {("invoice", x._row_idx): sum(i == x._row_idx for i, _ in pairs) for x in a} | {("payment", y._row_idx): sum(p == y._row_idx for _, p in pairs) for y in b}
    rows = reconcile.similar_links(reconcile.invoices_view(inv), reconcile.payments_view(pay)).collect()
    assert {(r.side, r.row): r.links for r in rows} == want and len(rows) == len(want)
    first = lambda rows, row, name, amount: min(r._row_idx for r in rows if (r[name], str(r[amount])) == (row[name], str(row[amount])))
    classes = {("invoice", x._row_idx): first(a, x, "Customer_Name", "Amount") for x in a} | {("payment", y._row_idx): first(b, y, "Customer", "Paid_Amount") for y in b}
    assert {(r.side, r.row): r.class_id for r in rows} == classes


@pytest.mark.parametrize("slice_rows", [3, 4096])
def test_similar_payments_are_listed_pair_by_pair(spark, monkeypatch, slice_rows):
    """The query gives every pair, not a count of pairs a row; crowded amounts are cut into slices."""
    rng = random.Random(8)
    people = ["Ann Smith", "Ann Smyth", "smith ann", "Bo Li", "", None]
    amounts = [100.0, 110.0, 95.0, 105.0, 200.0, 190.0, 0.0, -5.0, -15.0, 400.0, 420.0, 380.0, 950.095, 1000.1, 1050.105, float("inf"), float("nan"), None]
    inv = spark.createDataFrame([(i, f"INV-{i}", rng.choice(people), rng.choice(amounts)) for i in range(70)], "_row_idx long, Invoice_No string, Customer_Name string, Amount double")
    pay = spark.createDataFrame([(p, "", rng.choice(people), rng.choice(amounts)) for p in range(80)], "_row_idx long, Payment_Ref string, Customer string, Paid_Amount double")
    near = lambda x, y: abs(x - y) <= 10 or (0 < x < float("inf") and abs(x - y) / x <= 0.05)
    views = reconcile.invoices_view(inv).collect(), reconcile.payments_view(pay).collect()
    alike = lambda x, y: x.i_cust and y.p_cust and token_sort(x.i_cust.lower(), y.p_cust.lower()) >= 80
    want = sorted((x.i, y.p) for x in views[0] for y in views[1] if alike(x, y) and None not in (x.i_amt, y.p_amt) and near(x.i_amt, y.p_amt))
    monkeypatch.setattr(business_plans, "billed", lambda *a: (inv, pay))
    pairs = reconcile.similar_pairs
    monkeypatch.setattr(reconcile, "similar_pairs", lambda *a: pairs(*a, slice_rows=slice_rows))
    found = business_plans.payments_by_similarity(spark, "")
    assert found.columns == ["i", "p"] and sorted(map(tuple, found.collect())) == want and len(want) > 100
