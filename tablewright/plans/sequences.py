"""Checks of the operators that depend on an order: the sequence itself, step by step, in recursive SQL."""

from __future__ import annotations

import re

from tablewright.plans import sqltext as q
from tablewright.plans.fixtures import check_sql


def clean_ref(c: str) -> str:
    return f"lower(replace(replace({q.strip(c)}, '-', ''), ' ', ''))"


# The invoice numbers have one length here, so a longer reference is searched for all its parts of that length.
REFERRED = f"""ino AS (SELECT {clean_ref('Invoice_No')} AS ik, min(_row_idx) AS i FROM invoices GROUP BY 1),
ref AS (SELECT _row_idx AS p, {clean_ref('Payment_Ref')} AS pk FROM payments),
prt AS (SELECT p, pk, unnest(list_transform(range(1, length(pk) - 10), lambda a: substring(pk, a, 12))) AS ik FROM ref),
rfd AS (SELECT p, min(i) AS i FROM prt JOIN ino USING (ik) GROUP BY p)"""
SIMILAR = f"""nms AS (SELECT DISTINCT lower(Customer_Name) AS n FROM invoices UNION SELECT DISTINCT lower(Customer) FROM payments),
srt AS (SELECT n, {q.sort_words('n')} AS x FROM nms),
prs AS (SELECT a.n AS a, b.n AS b, a.x AS ax, b.x AS bx FROM srt a JOIN srt b ON a.n <= b.n
  AND least(length(a.x), length(b.x)) * 200 >= 80 * (length(a.x) + length(b.x))),
lik AS (SELECT a, b FROM prs WHERE {q.ratio('ax', 'bx')} >= 80), sym AS (SELECT a, b FROM lik UNION SELECT b, a FROM lik)"""
SIMILAR_PAIRS = """SELECT i._row_idx AS i, p._row_idx AS p FROM invoices i JOIN sym ON lower(i.Customer_Name) = a JOIN payments p ON b = lower(p.Customer)
WHERE abs(i.Amount - p.Paid_Amount) <= 10 OR (i.Amount > 0 AND abs(i.Amount - p.Paid_Amount) / i.Amount <= 0.05::DOUBLE)"""

# In step k the k-th invoice of every part is served. Parts share no payment that anyone contests.
_SERVED = f"""{REFERRED}, {SIMILAR}, fuz AS (SELECT * FROM ({SIMILAR_PAIRS}) z),
own AS (SELECT i, p FROM rfd),
csl AS (SELECT i, p, true AS own FROM own UNION ALL SELECT fuz.i, fuz.p, false FROM fuz LEFT JOIN own USING (p) WHERE own.i IS NULL OR own.i > fuz.i),
lnk AS (SELECT DISTINCT lower(i.Customer_Name) AS a, lower(p.Customer) AS b FROM csl JOIN invoices i ON i._row_idx = csl.i JOIN payments p ON p._row_idx = csl.p
  WHERE csl.p IN (SELECT p FROM fuz)),
bth AS (SELECT a, b FROM lnk UNION SELECT b, a FROM lnk),
par(name, part) USING KEY (name) AS (SELECT a, min(least(a, b)) FROM bth GROUP BY a
  UNION (SELECT bth.a, min(par.part) FROM par JOIN bth ON bth.b = par.name JOIN recurring.par o ON o.name = bth.a GROUP BY bth.a, o.part HAVING min(par.part) < o.part)),
ord AS (SELECT _row_idx AS i, row_number() OVER (PARTITION BY coalesce(part, lower(Customer_Name)) ORDER BY _row_idx) AS k
  FROM invoices LEFT JOIN par ON name = lower(Customer_Name)),
stp AS (SELECT csl.*, k FROM csl JOIN ord USING (i)),
used(p, i, k) USING KEY (p) AS (SELECT -1::BIGINT, -1::BIGINT, 0::BIGINT
  UNION (WITH now AS (SELECT max(used.k) + 1 AS k FROM used),
    opn AS (SELECT stp.* FROM stp JOIN now ON stp.k = now.k LEFT JOIN recurring.used g ON g.p = stp.p WHERE g.p IS NULL),
    pck AS (SELECT *, bool_or(own) OVER (PARTITION BY i) AS any_own, min(p) OVER (PARTITION BY i) AS first FROM opn)
    SELECT p, i, k FROM pck WHERE CASE WHEN any_own THEN own ELSE p = first END
    UNION ALL SELECT -1, -1, k FROM now WHERE k <= (SELECT max(k) FROM ord))),
usd AS (SELECT i, p FROM used WHERE p >= 0),
pds AS (SELECT i, count(*) AS n, sum(Paid_Amount) AS paid, min_by({q.strip('Customer')}, p) AS cust FROM usd JOIN payments ON _row_idx = p GROUP BY 1),
rtd AS (SELECT {q.strip('Invoice_No')} AS invoice_no, {q.strip('Customer_Name')} AS customer, Amount AS amount, coalesce(n, 0) AS n, coalesce(paid, 0) AS paid, cust,
  {q.sort_words(f"lower({q.strip('Customer_Name')})")} AS x, {q.sort_words("lower(cust)")} AS y FROM invoices LEFT JOIN pds ON i = _row_idx),
sta AS (SELECT *, abs(amount - paid) AS gap, CASE WHEN n = 0 THEN 'Unmatched' WHEN n > 1 THEN 'Duplicate' WHEN {q.ratio('x', 'y')} < 60 THEN 'Conflict'
  WHEN abs(amount - paid) > 10 THEN 'Partial' ELSE 'Matched' END AS status FROM rtd),
led AS (SELECT invoice_no, customer, round(amount, 2) AS invoice_amount, round(paid, 2) AS paid_amount, status,
  CASE status WHEN 'Unmatched' THEN 'No matching payment record found.'
    WHEN 'Duplicate' THEN 'Multiple payments found referencing this invoice: ' || n || ' records.'
    WHEN 'Conflict' THEN 'Name mismatch: Invoice customer ' || chr(39) || customer || chr(39) || ' vs Payment customer ' || chr(39) || cust || chr(39) || '.'
    WHEN 'Partial' THEN 'Discrepancy: ₹' || MONEY(gap) || ' difference (Invoice: ₹' || MONEY(amount) || ', Paid: ₹' || MONEY(paid) || ').'
    ELSE 'Payment matches invoice reference and amount.' END AS details FROM sta
  UNION ALL SELECT {q.strip('Payment_Ref')}, {q.strip('Customer')}, 0, round(Paid_Amount, 2), 'Unmatched Payment', 'Payment received without corresponding invoice record.'
    FROM payments WHERE _row_idx NOT IN (SELECT p FROM usd))"""
SERVED = re.sub(r"MONEY\((\w+)\)", r"format('{:,}', trunc(round(\1, 2))::BIGINT) || right(printf('%.2f', round(\1, 2)), 3)", _SERVED)


def served_sql(select: str) -> str:
    return check_sql(["invoices", "payments"], f", {SERVED} {select}").replace("WITH ", "WITH RECURSIVE ", 1)


# Names in order of their digest, one after the other: the first leader that is near takes it, or it leads.
CLUSTERED = f"""sps AS (SELECT DISTINCT {q.strip('name')} AS name FROM persons_text WHERE {q.strip('name')} <> ''), spn AS (SELECT name, {q.squeeze('name')} AS norm FROM sps),
frm AS (SELECT norm, min(name) AS head, length(norm) AS n, row_number() OVER (ORDER BY md5(norm)) AS k FROM spn GROUP BY norm),
prs AS (SELECT a.k AS a, b.k AS b, a.norm AS x, b.norm AS y, a.n > 3 AND b.n > 3 AND (contains(a.norm, b.norm) OR contains(b.norm, a.norm)) AS inside, a.n + b.n AS size
  FROM frm a JOIN frm b ON a.k < b.k WHERE least(a.n, b.n) * 200 >= 85 * (a.n + b.n) OR contains(a.norm, b.norm) OR contains(b.norm, a.norm)),
cls AS (SELECT * FROM prs WHERE NOT inside AND 200 * length(regexp_replace(x, '[^' || y || ']', '', 'g')) >= 85 * size AND 200 * length(regexp_replace(y, '[^' || x || ']', '', 'g')) >= 85 * size),
nea AS (SELECT a, b FROM prs WHERE inside UNION ALL SELECT a, b FROM cls WHERE {q.ratio('x', 'y')} >= 85),
lea(k, lead) USING KEY (k) AS (SELECT 0::BIGINT, 0::BIGINT
  UNION (SELECT t.k, coalesce(min(g.k), t.k) FROM (SELECT max(lea.k) + 1 AS k FROM lea) t LEFT JOIN nea ON nea.b = t.k
    LEFT JOIN recurring.lea g ON g.k = nea.a AND g.lead = g.k WHERE t.k <= (SELECT max(k) FROM frm) GROUP BY t.k)),
mem AS (SELECT h.head, s.name, h.norm AS x, s.norm AS y FROM spn s JOIN frm f ON f.norm = s.norm JOIN lea ON lea.k = f.k JOIN frm h ON h.k = lea.lead WHERE s.name <> h.head),
sim AS (SELECT head, name AS variant, {q.ratio('x', 'y')} AS similarity FROM mem)"""


def clustered_sql(select: str) -> str:
    return check_sql(["persons_text"], f", {CLUSTERED} {select}").replace("WITH ", "WITH RECURSIVE ", 1)


def _share(name: str) -> str:
    return f"round_even({name}::DOUBLE / total * 100, 1) AS {name}_pct"


CHECKS = {
    "payments_by_reference": check_sql(["invoices", "payments"], f", {REFERRED} SELECT p, i FROM rfd"),
    "payments_by_similarity": check_sql(["invoices", "payments"], f", {SIMILAR} {SIMILAR_PAIRS}"),
    "payment_ledger": served_sql("SELECT * FROM led"),
    "payment_stats": served_sql(
        f""", cnt AS (SELECT count(*) AS total, count(*) FILTER (status = 'Matched') AS matched, count(*) FILTER (status = 'Partial') AS partial,
        count(*) FILTER (status LIKE 'Unmatched%') AS unmatched, count(*) FILTER (status = 'Duplicate') AS duplicate, count(*) FILTER (status = 'Conflict') AS conflict FROM led)
        SELECT matched, partial, unmatched, duplicate, conflict, {', '.join(map(_share, ('matched', 'partial', 'unmatched', 'duplicate', 'conflict')))} FROM cnt"""
    ),
    "name_members": clustered_sql('SELECT head AS "primary", variant, similarity FROM sim'),
    "name_clusters": clustered_sql(
        """SELECT head AS "primary", count(*) AS variations, CASE WHEN max(similarity) > 0 THEN cast(floor(max(similarity)) AS INT) ELSE 90 END AS similarity,
        CASE WHEN max(similarity) >= 90 THEN 'High' ELSE 'Medium' END AS confidence FROM sim GROUP BY 1"""
    ),
}
