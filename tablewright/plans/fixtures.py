"""Business-like input tables derived from the given ones by modular arithmetic.

Each text is one SELECT that Spark and DuckDB both run, so a query and its check read the same rows. A given
table is written ``{orders}``; other derived tables are named plainly and listed in ``NEEDS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GIVEN = (
    "Aaron Bianca Cedric Daphne Elliot Fiona Gustav Harriet Ingrid Jasper Kirsten Leopold "
    "Miriam Nathan Ophelia Percival Quentin Rosalind Stephan Tabitha Ursula Vincent Wilhelm Yolanda"
).split()
FAMILY = (
    "Abernathy Blackwood Castellan Dunmore Eastwick Fairbanks Goldsmith Hutchings Ironside Jankowski "
    "Kowalczyk Lindqvist Montague Novakovic Okonkwo Pemberton Quimby Rutherford Szymanski Thibault "
    "Underhill Vasquez Whitlock Xenakis Youngblood Zimmerman Ashcroft Birchwell Crompton Delacroix "
    "Engstrom Featherly Gallagher Holloway Ivarsson Jorgensen Kettering Lombardi Mcallister Nightingale"
).split()


def _words(words: list[str]) -> str:
    return ", ".join(f"({i}, '{w}')" for i, w in enumerate(words))


def _money(x: str) -> str:
    return f"cast(cast({x} AS decimal(18,2)) AS string)"


SQL = {
    "given": f"SELECT * FROM (VALUES {_words(GIVEN)}) AS g(i, w)",
    "family": f"SELECT * FROM (VALUES {_words(FAMILY)}) AS f(i, w)",
    "people": """
        SELECT c.c_custkey AS k, g.w AS given_name, f.w AS family_name, concat(g.w, ' ', f.w) AS name,
               concat('9', lpad(cast(c.c_custkey AS string), 9, '0')) AS phone,
               concat(lower(g.w), cast(c.c_custkey AS string), '@example.com') AS email,
               CASE WHEN c.c_custkey % 2 = 0 THEN
                 concat(lpad(cast(c.c_custkey % 100 AS string), 2, '0'), 'AAAAP',
                        lpad(cast(cast(floor(c.c_custkey / 100) AS bigint) % 10000 AS string), 4, '0'),
                        'F1Z', cast(c.c_custkey % 10 AS string)) END AS gstin,
               c.c_acctbal AS balance
        FROM {customer} c
        JOIN given g ON c.c_custkey % 24 = g.i
        JOIN family f ON cast(floor(c.c_custkey / 24) AS bigint) % 40 = f.i""",
    "messy_one": """
        SELECT o.o_orderkey AS k, concat('ORD-', cast(o.o_orderkey AS string)) AS order_id,
               CASE o.o_orderkey % 40 WHEN 0 THEN upper(p.name) WHEN 1 THEN lower(p.name)
                 WHEN 2 THEN concat(p.given_name, ' K ', p.family_name) WHEN 3 THEN concat(p.name, ' ')
                 ELSE p.name END AS client,
               CASE WHEN o.o_orderkey % 12 = 0 THEN NULL WHEN o.o_orderkey % 12 = 1 THEN 'unknown' ELSE p.phone END AS phone,
               CASE o.o_orderkey % 15 WHEN 0 THEN lower(r.w) WHEN 1 THEN upper(r.w) WHEN 2 THEN concat(r.w, chr(9))
                 ELSE r.w END AS region,
               CASE WHEN o.o_orderkey % 250 = 7 THEN '1250000' WHEN o.o_orderkey % 10 = 0 THEN ''
                 WHEN o.o_orderkey % 25 = 1 THEN concat('$', MONEY)
                 WHEN o.o_orderkey % 25 = 2 THEN concat(cast(1 + o.o_orderkey % 300 AS string), ',',
                      lpad(cast(o.o_orderkey % 1000 AS string), 3, '0'))
                 WHEN o.o_orderkey % 50 = 3 THEN concat('-', MONEY) ELSE MONEY END AS revenue,
               CASE WHEN o.o_orderkey % 30 = 0 THEN 'invalid-date-format'
                 WHEN o.o_orderkey % 30 = 1 THEN concat(substring(DAY, 9, 2), '-', substring(DAY, 6, 2), '-', substring(DAY, 1, 4))
                 ELSE DAY END AS order_date
        FROM {orders} o JOIN people p ON o.o_custkey = p.k
        JOIN (VALUES (0, 'North'), (1, 'South'), (2, 'East'), (3, 'West')) AS r(i, w) ON o.o_custkey % 4 = r.i
        """.replace("MONEY", _money("o.o_totalprice")).replace("DAY", "cast(cast(o.o_orderdate AS date) AS string)"),
    "messy_orders": """
        SELECT k AS _row_idx, order_id AS OrderID, client AS Client, phone AS Phone, region AS Region,
               revenue AS Revenue, order_date AS OrderDate FROM messy_one
        UNION ALL
        SELECT k + 1000000000000, order_id, client, phone, region, revenue, order_date
        FROM messy_one WHERE k % 100 = 5""",
    "churn": """
        SELECT c_custkey AS _row_idx, concat('CUST-', cast(c_custkey AS string)) AS CustomerID,
               CASE WHEN c_custkey % 15 = 0 THEN '' ELSE cast(c_custkey % 72 AS string) END AS Tenure,
               CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE MONEY END AS MonthlyCharges,
               CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE YEARLY END AS TotalCharges,
               CASE WHEN c_custkey % 100 < 20 THEN concat('2024-0', cast(1 + c_custkey % 9 AS string), '-15') END AS CancellationDate,
               CASE WHEN c_custkey % 100 < 20 THEN '1' ELSE '0' END AS Churn
        FROM {customer}""".replace("MONEY", _money("c_acctbal")).replace("YEARLY", _money("c_acctbal * 12")),
    "src_crm": """
        SELECT k AS _row_idx, concat('C-', cast(k AS string)) AS Customer_ID, name AS Customer_Name,
               CASE WHEN k % 11 = 0 THEN NULL ELSE phone END AS Phone,
               CASE WHEN k % 4 = 0 THEN email END AS Email,
               MONEY AS Revenue, '2026-01-05' AS Last_Login
        FROM people WHERE k % 5 < 3""".replace("MONEY", _money("balance")),
    "src_tally": """
        SELECT k AS _row_idx, concat('P-', cast(k AS string)) AS Party_ID, upper(name) AS Party_Name,
               CASE WHEN k % 11 = 0 THEN '-' ELSE phone END AS Mobile,
               CASE WHEN k % 6 = 0 THEN gstin END AS GSTIN,
               CASE WHEN k % 7 = 0 THEN MORE ELSE MONEY END AS Sales
        FROM people WHERE k % 5 > 1""".replace("MORE", _money("balance + 100")).replace("MONEY", _money("balance")),
    "src_pos": """
        SELECT k AS _row_idx, concat('POS-', cast(k AS string)) AS POS_ID,
               CASE WHEN k % 9 = 0 THEN concat(given_name, ' Bartholomew Constantine ', family_name)
                 ELSE concat(given_name, ' K ', family_name) END AS Customer,
               CASE WHEN k % 11 = 0 THEN '' ELSE phone END AS Contact,
               MONEY AS Bill_Amount, '2026-02-10' AS Invoice_Date
        FROM people WHERE k % 3 = 0""".replace("MONEY", _money("balance")),
    "invoices": """
        SELECT o.o_orderkey AS _row_idx, concat('INV-', lpad(cast(o.o_orderkey AS string), 9, '0')) AS Invoice_No,
               p.name AS Customer_Name, o.o_totalprice AS Amount
        FROM {orders} o JOIN people p ON o.o_custkey = p.k""",
    "payments": """
        SELECT o._row_idx * 2 AS _row_idx,
               CASE o._row_idx % 20 WHEN 3 THEN concat('INV', lpad(cast(o._row_idx AS string), 9, '0'))
                 WHEN 4 THEN concat('PAY', lpad(cast(o._row_idx AS string), 9, '0'))
                 WHEN 6 THEN concat('wire ', o.Invoice_No, ' part') ELSE o.Invoice_No END AS Payment_Ref,
               CASE o._row_idx % 20 WHEN 5 THEN 'Zzyzx Qwortch Bvlgari' WHEN 4 THEN lower(o.Customer_Name)
                 ELSE o.Customer_Name END AS Customer,
               CASE o._row_idx % 20 WHEN 1 THEN floor(o.Amount * 50) / 100 WHEN 2 THEN round(o.Amount - 50, 2) ELSE o.Amount END AS Paid_Amount
        FROM invoices o WHERE o._row_idx % 20 <> 0
        UNION ALL
        SELECT o._row_idx * 2 + 1, o.Invoice_No, o.Customer_Name, floor(o.Amount * 50) / 100 FROM invoices o WHERE o._row_idx % 20 = 1
        UNION ALL
        SELECT o._row_idx * 2 + 1, concat('TXN', lpad(cast(o._row_idx AS string), 9, '0')), 'Mxyzptlk Jhvwqz', 77.5
        FROM invoices o WHERE o._row_idx % 20 = 7""",
    "pos_sales": """
        SELECT l_partkey AS _row_idx, concat('SKU-', cast(l_partkey AS string)) AS SKU,
               concat('Part ', cast(l_partkey AS string)) AS Product_Name,
               cast(cast(sum(l_quantity) AS bigint) AS string) AS Quantity_Sold
        FROM {lineitem} WHERE l_partkey % 19 <> 0 GROUP BY l_partkey""",
    "stock": """
        SELECT p_partkey * 2 AS _row_idx, concat('SKU-', cast(p_partkey AS string), CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE '' END) AS SKU,
               concat('Part ', cast(p_partkey AS string)) AS Product_Name, cast(p_size - 5 AS string) AS Stock_Remaining
        FROM {part} WHERE p_partkey % 17 <> 0
        UNION ALL
        SELECT p_partkey * 2 + 1, concat('SKU-', cast(p_partkey AS string)), concat('Part ', cast(p_partkey AS string)), '999'
        FROM {part} WHERE p_partkey % 23 = 0 AND p_partkey % 17 <> 0""",
    "files": """
        SELECT event_id AS _row_idx,
               concat(CASE event_id % 9 WHEN 0 THEN 'crm_customers' WHEN 1 THEN 'tally_export' WHEN 2 THEN 'pos_receipts'
                 WHEN 3 THEN 'sales_sheet' WHEN 4 THEN 'data' WHEN 5 THEN 'vendor_ledger' WHEN 6 THEN 'export'
                 WHEN 7 THEN 'customer_billing' ELSE 'misc' END, '_', cast(event_id AS string), '.csv') AS filename,
               CASE user_id % 7 WHEN 0 THEN 'Customer_ID|Customer_Name|Phone|Email|Last_Login'
                 WHEN 1 THEN 'Party_ID|Party_Name|Mobile|GSTIN|Sales' WHEN 2 THEN 'POS_ID|Customer|Contact|Bill_Amount|Invoice_Date'
                 WHEN 3 THEN 'OrderID|Client|Phone|Region|Revenue|OrderDate' WHEN 4 THEN 'a|b|c'
                 WHEN 5 THEN 'GSTIN|customer|invoice_no|total_amt' ELSE 'OrderID|Customer Name|Phone|Revenue|OrderDate|Created_By|Internal_Notes'
               END AS headers
        FROM {events}""",
    "schemas": """
        SELECT s_key AS _row_idx, concat('table_', cast(s_key AS string)) AS dataset,
               CASE s_key % 3 WHEN 0 THEN 'OrderID|Client|Phone|Region|Revenue|OrderDate'
                 WHEN 1 THEN 'Customer_Name|Phone|Revenue' ELSE 'order_id|client_name|net_total|created_at' END AS baseline,
               CASE s_key % 5 WHEN 0 THEN 'OrderID|Client|Mobile|Region|Revenues|Order_Date'
                 WHEN 1 THEN 'CustomerName|Mobile|SalesAmount|Extra_Col' WHEN 2 THEN 'Customer_Name|Phone|Revenue'
                 WHEN 3 THEN 'orderid|clientname|nettotal|created_on|note' ELSE 'x|y' END AS current
        FROM (SELECT c_custkey AS s_key FROM {customer}) c""",
    "rules": """
        SELECT * FROM (VALUES
          ('rule_1', 'Critical Quality Score Drop', 'Data Quality', 'Overall Quality Score', '<', 52.0, 'CRITICAL', 'Email|WhatsApp|Slack', 60, true),
          ('rule_2', 'Anomaly Count Spike', 'Data Quality', 'Anomaly Count', '>', 5.0, 'HIGH', 'Slack|Teams', 30, true),
          ('rule_4', 'Revenue Anomaly Discrepancy', 'Business Risk', 'Revenue Deviation (%)', '>', 15.0, 'WARNING', 'Email|Slack', 120, true),
          ('rule_5', 'Unused', 'Data Quality', 'Anomaly Count', '>', 0.0, 'HIGH', 'Slack', 30, false)
        ) AS r(rule_id, rule_name, category, metric, operator, threshold, severity, channels, cooldown_minutes, active)""",
    "state_rules": """
        SELECT * FROM (VALUES
          ('rule_2', 'Anomaly Count Spike', 'Data Quality', 'Anomaly Count', '>', '8', 'HIGH', 'Slack|Teams', 30, true),
          ('rule_3', 'Malware & Security Threat Flag', 'Security', 'File Threat / Malware Flag', '==', 'INFECTED', 'CRITICAL', 'Email|WhatsApp|SMS', 15, true),
          ('rule_6', 'Not clean', 'Security', 'File Threat / Malware Flag', '!=', 'CLEAN', 'LOW', 'Slack', 15, false),
          ('rule_7', 'Unheard of', 'Data Quality', 'Moon Phase', '>', '1', 'LOW', 'Slack', 15, true)
        ) AS r(rule_id, rule_name, category, metric, operator, threshold, severity, channels, cooldown_minutes, active)""",
    "audit_lines": """
        SELECT event_id AS _row_idx,
               concat(cast(date_trunc('second', ts) AS string), chr(9), 'User', cast(user_id AS string), chr(9), event_type,
                 CASE WHEN event_id % 13 = 0 THEN '' ELSE concat(chr(9), CASE WHEN value < 50 THEN 'SUCCESS' ELSE 'FAILED' END) END,
                 CASE WHEN event_id % 7 = 0 OR event_id % 13 = 0 THEN '' ELSE concat(chr(9), 'props ', props) END) AS line
        FROM {events}""",
    "payloads": """
        SELECT event_id AS _row_idx, CASE user_id % 4 WHEN 0 THEN 'shopify_pos' WHEN 1 THEN 'tally_prime' WHEN 2 THEN 'salesforce_crm'
                 ELSE 'sap_erp' END AS system_id, ts,
               CASE WHEN event_id % 50 = 0 THEN '{{bad' WHEN event_id % 50 = 1 THEN '{{}}' ELSE props END AS payload
        FROM {events}""",
    "contacts": """
        SELECT k * 2 AS _row_idx, name AS Customer_Name, CASE WHEN k % 11 = 0 THEN NULL ELSE phone END AS Phone,
               CASE WHEN k % 4 = 0 THEN email END AS Email, CASE WHEN k % 6 = 0 THEN gstin END AS GSTIN FROM people
        UNION ALL
        SELECT k * 2 + 1, CASE WHEN k % 9 = 0 THEN concat(given_name, ' Bartholomew Constantine ', family_name) ELSE upper(name) END,
               CASE WHEN k % 11 = 0 THEN '-' ELSE concat('+91 ', phone) END, CASE WHEN k % 8 = 0 THEN email END,
               CASE WHEN k % 12 = 0 THEN lower(gstin) END FROM people WHERE k % 3 = 0""",
    "overrides": """
        SELECT concat(name, '_', CASE WHEN k % 2 = 0 THEN 'Revenue' ELSE 'Internal_Notes' END) AS override_key,
               concat('picked ', cast(min(k) AS string)) AS value
        FROM people WHERE k % 7 = 0 GROUP BY concat(name, '_', CASE WHEN k % 2 = 0 THEN 'Revenue' ELSE 'Internal_Notes' END)""",
    "findings": """
        SELECT event_id AS _row_idx, CASE event_id % 3 WHEN 0 THEN 'missing_contacts' WHEN 1 THEN 'negative_stock' ELSE 'no_such_finding' END AS finding_key,
               CASE user_id % 3 WHEN 0 THEN 'English' WHEN 1 THEN 'German' ELSE 'Klingon' END AS language, event_type AS dataset FROM {events}""",
    "dictionary": """
        SELECT * FROM (VALUES
          ('missing_contacts', 'English', 'Contacts are missing in {{dataset}}', 'Customers cannot be reached', 'Empty cells', 'Fill {{unknown}} cells'),
          ('missing_contacts', 'German', 'Kontakte fehlen in {{dataset}}', 'Kunden nicht erreichbar', 'Leere Zellen', 'Zellen füllen'),
          ('negative_stock', 'English', 'Stock below zero', 'Sales without goods', 'Values under 0 in {{dataset}}', 'Count again')
        ) AS d(finding_key, language, finding, business_meaning, technical_explanation, recommended_fix)""",
    "catalog": """
        SELECT c_custkey AS _row_idx,
               CASE WHEN c_custkey = 1 THEN 'retail_sales' WHEN c_custkey = 2 THEN 'customer_churn'
                 ELSE concat('uploaded_', cast(c_custkey AS string)) END AS dataset_id,
               CASE c_custkey % 5 WHEN 0 THEN 'Guest' WHEN 1 THEN 'guest' WHEN 2 THEN '' WHEN 3 THEN NULL
                 ELSE 'System' END AS creator
        FROM {customer}""",
    "requests": """
        SELECT event_id AS _row_idx, CASE user_id % 4 WHEN 0 THEN 'ADMIN' WHEN 1 THEN ' data analyst ' WHEN 2 THEN 'Viewer' ELSE 'ROBOT' END AS role,
               CASE event_id % 4 WHEN 0 THEN 'view_datasets' WHEN 1 THEN 'merge_datasets' WHEN 2 THEN 'apply_safe_fixes' ELSE 'view_reports' END AS permission
        FROM {events}""",
    "people_secret": """
        SELECT k AS _row_idx, name AS Customer_Name, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 11 = 1 THEN 'ab@x.org' ELSE email END AS Email,
               CASE WHEN k % 7 = 0 THEN '-' WHEN k % 7 = 1 THEN '12 34' ELSE phone END AS Phone, gstin AS GSTIN,
               cast(cast(balance AS decimal(18,2)) AS string) AS Revenue,
               CASE WHEN k % 3 = 0 THEN '120%' WHEN k % 3 = 1 THEN '15' ELSE 'n/a' END AS Discount,
               CASE WHEN k % 5 = 0 THEN '2031-03-04' WHEN k % 5 = 1 THEN 'soon' ELSE '2020-01-02' END AS Join_Date, 'free text' AS Notes
        FROM people""",
    "persons_text": """
        SELECT k AS _row_idx, CASE k % 6 WHEN 0 THEN name WHEN 1 THEN upper(name)
                 WHEN 2 THEN concat(substring(name, 1, 4), substring(name, 6, 40)) WHEN 3 THEN concat(name, ' Jr')
                 WHEN 4 THEN family_name ELSE concat(given_name, '. ', family_name) END AS name
        FROM people""",
}

NEEDS = {
    "people": ("given", "family"),
    "messy_one": ("people",),
    "messy_orders": ("messy_one",),
    "src_crm": ("people",),
    "src_tally": ("people",),
    "src_pos": ("people",),
    "invoices": ("people",),
    "payments": ("invoices",),
    "persons_text": ("people",),
    "people_secret": ("people",),
    "contacts": ("people",),
    "overrides": ("people",),
}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def with_clause(names: list[str], tables: dict[str, str]) -> str:
    """``WITH`` text that defines the named derived tables and what they need."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        for need in NEEDS.get(name, ()):
            add(need)
        done[name] = SQL[name].format(**tables)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({text})" for n, text in done.items())


def check_sql(names: list[str], select: str) -> str:
    """Text for the check engine, where the given tables are views of their own name."""
    return f"{with_clause(names, {t: t for t in TABLES})}\n{select}"


_analyzed: dict[tuple[str, str, str], DataFrame] = {}


def derived(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The derived table as a DataFrame over the Parquet files in ``folder``; analyzed once per session."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _analyzed:
        tables = {t: f"parquet.`{folder}/{t}.parquet`" for t in TABLES}
        _analyzed[key] = spark.sql(f"{with_clause([name], tables)} SELECT * FROM {name}")
    return _analyzed[key]


def given_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
