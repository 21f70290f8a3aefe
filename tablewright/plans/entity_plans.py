"""Entity resolution and merge queries over three overlapping sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.similarity import entity_ratio, ratio, token_sort_ratio
from tablewright.operators import entities, merge
from tablewright.operators.columns import ROW
from tablewright.plans import sqltext as q
from tablewright.plans.fixtures import check_sql, derived

MAPPING = {
    "Customer_ID": {"crm": "Customer_ID", "tally": "Party_ID", "pos": "POS_ID"},
    "Customer_Name": {"crm": "Customer_Name", "tally": "Party_Name", "pos": "Customer"},
    "Phone": {"crm": "Phone", "tally": "Mobile", "pos": "Contact"},
    "Email": {"crm": "Email"},
    "GSTIN": {"tally": "GSTIN"},
    "Revenue": {"crm": "Revenue", "tally": "Sales", "pos": "Bill_Amount"},
    "Invoice_Date": {"pos": "Invoice_Date"},
    "Last_Login": {"crm": "Last_Login"},
}
SOURCES = ("crm", "tally", "pos")


def records(spark, folder):
    return entities.unify([(s, derived(spark, folder, f"src_{s}")) for s in SOURCES], MAPPING)


def resolved(spark, folder):
    return entities.resolve(records(spark, folder))


def block_keys(spark, folder):
    keys = entities.block_keys(F.col("Customer_Name"), F.col("Phone"), F.col("Email"), F.col("GSTIN"))
    table = derived(spark, folder, "contacts")
    return table.select(ROW, F.explode(F.array_compact(F.array(*keys))).alias("key"))


def fuzzy_ratio(spark, folder):
    pairs = derived(spark, folder, "payments").alias("p").join(
        derived(spark, folder, "invoices").alias("i"), F.floor(F.col("p._row_idx") / 2) == F.col("i._row_idx")
    )
    a, b = F.lower("i.Customer_Name"), F.lower("p.Customer")
    return pairs.select(
        F.col("p._row_idx").alias("_row_idx"), F.round(ratio(a, b), 6).alias("ratio"),
        F.round(token_sort_ratio(a, b), 6).alias("token_sort"),
        F.round(entity_ratio(F.col("i.Customer_Name"), F.col("p.Customer")), 6).alias("entity"),
    )


def conflict_rows(spark, folder):
    shown = F.array_join(F.transform(F.map_entries("values"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return merge.conflicts(resolved(spark, folder), MAPPING).select("_entity_id", "entity_id", "field", shown.alias("shown"), "status")


def golden(strategy, picked=False):
    def run(spark, folder):
        over = derived(spark, folder, "overrides") if picked else None
        return merge.apply_merge(resolved(spark, folder), list(SOURCES), strategy, over)

    return run


def merge_log(spark, folder):
    return merge.log_parts(resolved(spark, folder))


def merge_strategy(spark, folder):
    tables = derived(spark, folder, "contacts").select(
        F.concat(F.lit("set_"), F.floor(F.col(ROW) / 4).cast("string")).alias("dataset"),
        F.when(F.col("GSTIN").isNotNull(), "GSTIN").when(F.col("Email").isNotNull(), "Customer_ID").otherwise("Phone").alias("target_field"),
        F.col(ROW).alias("source_id"),
    )
    return merge.recommend_strategy(tables)


QUERIES = {
    "block_keys": block_keys,
    "fuzzy_ratio": fuzzy_ratio,
    "union_records": lambda s, d: records(s, d).select("_rec", "_source_id", ROW, "name", "rec_phone", "rec_email", "rec_gstin", "Revenue", "_block"),
    "entity_groups": lambda s, d: resolved(s, d).select("_rec", "_source_id", "name", "_entity_id"),
    "duplicate_clusters": lambda s, d: entities.duplicate_clusters(resolved(s, d)),
    "cluster_variants": lambda s, d: entities.cluster_variants(resolved(s, d)),
    "entity_stats": lambda s, d: entities.match_stats(resolved(s, d)),
    "probable_duplicates": lambda s, d: entities.probable_duplicates(derived(s, d, "contacts"), "Customer_Name")[0],
    "probable_duplicate_rows": lambda s, d: entities.probable_duplicates(derived(s, d, "contacts"), "Customer_Name")[1],
    "merge_strategy": merge_strategy,
    "conflicts": conflict_rows,
    "source_contributions": lambda s, d: merge.contributions(records(s, d)),
    "merge_preview": lambda s, d: merge.preview(resolved(s, d), MAPPING),
    "merge_outer": golden("Outer Join"),
    "merge_left": golden("Left Join"),
    "merge_inner": golden("Inner Join"),
    "merge_overrides": golden("Entity Resolution", True),
    "provenance": lambda s, d: merge.provenance(resolved(s, d)),
    "provenance_log": merge_log,
}


def key_sql(name: str, phone: str, email: str, tax: str) -> list[str]:
    norm = q.squeeze(name)
    words = f"string_split({norm}, ' ')"
    number = f"regexp_replace({phone}, '\\D', '', 'g')"
    return [
        f"CASE WHEN length({q.strip(tax)}) >= 10 AND upper({q.strip(tax)}) <> 'NAN' THEN 'gstin_' || upper({q.strip(tax)}) END",
        f"CASE WHEN contains({email}, '@') AND length({q.strip(email)}) > 5 THEN 'email_' || lower({q.strip(email)}) END",
        f"CASE WHEN length({number}) >= 10 THEN 'phone_' || right({number}, 10) END",
        f"CASE WHEN {norm} <> '' THEN 'name_' || left({words}[1], 3) || CASE WHEN len({words}) > 1 THEN '_' || {words}[-1] ELSE '' END END",
    ]


def record_sql() -> str:
    parts = []
    for position, sid in enumerate(SOURCES):
        def col(target: str, none: str = "NULL") -> str:
            return MAPPING.get(target, {}).get(sid, none)

        fields = ", ".join(f"cast({col(t)} AS VARCHAR) AS {t}" for t in entities.TARGETS)
        parts.append(
            f"SELECT {position}::BIGINT * {1 << 52} + _row_idx AS _rec, '{sid}' AS _source_id, {position} AS _src_pos, _row_idx, "
            f"{q.strip(col('Customer_Name'))} AS name, coalesce({col('Phone')}, '') AS rec_phone, "
            f"coalesce({col('Email')}, '') AS rec_email, coalesce({col('GSTIN')}, '') AS rec_gstin, {fields} FROM src_{sid}"
        )
    keys = ", ".join(key_sql("name", "rec_phone", "rec_email", "rec_gstin"))
    return f"""r0 AS (SELECT * FROM ({' UNION ALL '.join(parts)}) z WHERE name <> ''),
recs AS (SELECT *, coalesce({keys}) AS _block, {q.sort_words(q.squeeze('name'))} AS sname FROM r0)"""


# Only name blocks hold names of two kinds, so two levels of leaders settle every block here.
GROUPS = f"""{record_sql()},
l1 AS (SELECT _block, min(_rec) AS lead, min_by(sname, _rec) AS lname, min_by(rec_phone, _rec) AS lphone FROM recs GROUP BY _block),
d1 AS (SELECT r._block, r.sname, r.rec_phone, l.lead, {q.ratio('r.sname', 'l.lname')} >= 80
    OR (lphone <> '' AND regexp_replace(lphone, '\\D', '', 'g') = regexp_replace(r.rec_phone, '\\D', '', 'g')) AS hit
  FROM (SELECT DISTINCT _block, sname, rec_phone FROM recs) r JOIN l1 l ON r._block = l._block),
m1 AS (SELECT r.*, CASE WHEN r._block NOT LIKE 'name_%' OR d.hit THEN d.lead END AS e1 FROM recs r JOIN d1 d ON r._block = d._block AND r.sname = d.sname AND r.rec_phone = d.rec_phone),
l2 AS (SELECT _block, min(_rec) AS lead FROM m1 WHERE e1 IS NULL GROUP BY _block),
ent AS (SELECT m.* EXCLUDE (e1), coalesce(e1, l2.lead) AS _entity_id FROM m1 m LEFT JOIN l2 ON m._block = l2._block)"""
NAMES = f"""heads AS (SELECT _entity_id, min_by(name, _rec) AS "primary", count(*) AS size FROM ent GROUP BY 1),
nm AS (SELECT e._entity_id, "primary", size, name, count(*) AS c FROM ent e JOIN heads h ON e._entity_id = h._entity_id GROUP BY 1, 2, 3, 4),
prs AS (SELECT "primary" AS a, name AS b, {q.sort_words(q.squeeze('"primary"'))} AS na, {q.sort_words(q.squeeze('name'))} AS nb,
  {q.sort_words('"primary"')} AS ra, {q.sort_words('name')} AS rb FROM (SELECT DISTINCT "primary", name FROM nm) z),
sims AS (SELECT a, b, {q.ratio('na', 'nb')} AS sim, {q.ratio('ra', 'rb')} AS raw FROM prs),
best AS (SELECT _entity_id, "primary", size, max(sim) AS best, max(raw) AS raw, count(*) FILTER (lower(name) <> lower("primary")) AS variants
  FROM nm JOIN sims ON "primary" = a AND name = b WHERE size > 1 AND (name <> "primary" OR c > 1) GROUP BY 1, 2, 3)"""


def bare(t: str) -> str:
    return f"CASE WHEN NOT {q.empty(t, q.FIX)} THEN {q.strip(t)} END"


FIELDS = [t for t in entities.TARGETS if t != "Customer_Name" and t in MAPPING]
CONFLICT = "vals AS (" + " UNION ALL ".join(
    f"SELECT _entity_id, _source_id, '{t}' AS field, max_by({t}_v, _rec) AS v FROM (SELECT *, {bare(t)} AS {t}_v FROM ent) z "
    f"WHERE {t}_v IS NOT NULL GROUP BY 1, 2" for t in FIELDS
) + """), cf AS (SELECT v._entity_id, "primary" AS entity_id, field, string_agg(_source_id || '=' || v, ';' ORDER BY _source_id) AS shown,
  'CONFLICT' AS status FROM vals v JOIN heads h ON v._entity_id = h._entity_id GROUP BY 1, 2, 3 HAVING count(DISTINCT v) > 1)"""


def entity_sql(ctes: str, select: str, more: tuple[str, ...] = ()) -> str:
    return check_sql([f"src_{s}" for s in SOURCES] + list(more), f", {ctes}\n{select}")


def golden_sql(where: str, picked: bool = False) -> str:
    first = ", ".join(f"coalesce(min_by({t}_v, _rec) FILTER ({t}_v IS NOT NULL), '') AS {t}" for t in entities.TARGETS)
    clean = ", ".join(f"{bare(t)} AS {t}_v" for t in entities.TARGETS)
    if picked:
        shown = ", ".join(f"coalesce(o_{t}.value, g.{t}) AS {t}" for t in entities.TARGETS)
        joins = " ".join(f"LEFT JOIN overrides o_{t} ON o_{t}.override_key = _entity_match_id || '_{t}'" for t in entities.TARGETS)
        rest = "g._entity_id, g._entity_match_id, g._source_crm, g._source_tally, g._source_pos, g._source_excel, g._merge_confidence"
        body = f"SELECT {shown}, {rest} FROM g {joins}"
    else:
        body = "SELECT * FROM g"
    return entity_sql(
        f"""{GROUPS}, {NAMES}, g AS (SELECT z._entity_id, {first}, min_by(name, _rec) AS _entity_match_id,
        max((_source_id = 'crm')::INT) AS _source_crm, max((_source_id = 'tally')::INT) AS _source_tally,
        max((_source_id = 'pos')::INT) AS _source_pos, 0 AS _source_excel,
        max(coalesce(CASE WHEN b.raw = 0 THEN 90 ELSE cast(round_even(b.raw, 0) AS INT) END, 100)) AS _merge_confidence
        FROM (SELECT *, {clean} FROM ent) z LEFT JOIN best b ON z._entity_id = b._entity_id GROUP BY z._entity_id HAVING {where})""",
        body,
        ("overrides",) if picked else (),
    )


def probable_sql(select: str) -> str:
    """Four passes over the contacts; a NULL cell reads as the text 'nan' here."""
    text = """c0 AS (SELECT _row_idx AS rec, coalesce(Customer_Name, 'nan') AS name, coalesce(Phone, 'nan') AS phone,
      coalesce(Email, 'nan') AS email, coalesce(GSTIN, 'nan') AS gstin FROM contacts)"""
    keys = key_sql("name", "phone", "email", "gstin")
    text += f""", f0 AS (SELECT *, {', '.join(f'{k} AS k{i}' for i, k in enumerate(keys))}, {q.sort_words(q.squeeze('name'))} AS sname,
      right(regexp_replace(phone, '\\D', '', 'g'), 10) AS p10 FROM c0)"""
    for i in range(4):
        text += f""", lead{i} AS (SELECT k{i} AS k, min(rec) AS lrec FROM f{i} WHERE k{i} IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
      c{i}_ AS (SELECT f.*, l.rec AS primary_row, l.name AS "primary", l.sname AS lname,
        (l.gstin = f.gstin AND lower(l.gstin) <> 'nan') OR (l.email = f.email AND lower(l.email) <> 'nan')
        OR (l.p10 = f.p10 AND lower(l.phone) <> 'nan') AS same
        FROM f{i} f JOIN lead{i} x ON f.k{i} = x.k JOIN f{i} l ON l.rec = x.lrec WHERE f.rec <> l.rec),
      s{i} AS (SELECT primary_row, "primary", rec AS "row", name, CASE WHEN same THEN 100.0::DOUBLE ELSE {q.ratio('sname', 'lname')} END AS sim FROM c{i}_),
      t{i} AS (SELECT * FROM s{i} WHERE sim >= 80),
      f{i + 1} AS (SELECT * FROM f{i} WHERE rec NOT IN (SELECT "row" FROM t{i}) AND rec NOT IN (SELECT primary_row FROM t{i}))"""
    text += ", mem AS (" + " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(4)) + ")"
    return check_sql(["contacts"], f", {text}\n{select}")


CHECKS = {
    "block_keys": check_sql(
        ["contacts"],
        " UNION ALL ".join(
            f"SELECT _row_idx, {k} AS key FROM contacts WHERE {k} IS NOT NULL" for k in key_sql("Customer_Name", "Phone", "Email", "GSTIN")
        ),
    ),
    "fuzzy_ratio": check_sql(
        ["payments", "invoices"],
        f""", prs AS (SELECT p._row_idx AS k, lower(i.Customer_Name) AS a, lower(p.Customer) AS b FROM payments p JOIN invoices i ON floor(p._row_idx / 2) = i._row_idx),
        ab AS (SELECT DISTINCT a, b, {q.sort_words('a')} AS sa, {q.sort_words('b')} AS sb FROM prs),
        sims AS (SELECT a, b, round({q.ratio('a', 'b')}, 6) AS ratio, round({q.ratio('sa', 'sb')}, 6) AS token_sort FROM ab)
        SELECT k AS _row_idx, ratio, token_sort, token_sort AS entity FROM prs JOIN sims USING (a, b)""",
    ),
    "union_records": entity_sql(record_sql(), "SELECT _rec, _source_id, _row_idx, name, rec_phone, rec_email, rec_gstin, Revenue, _block FROM recs"),
    "entity_groups": entity_sql(GROUPS, "SELECT _rec, _source_id, name, _entity_id FROM ent"),
    "duplicate_clusters": entity_sql(
        f"{GROUPS}, {NAMES}",
        """SELECT _entity_id, "primary", variants, CASE WHEN best > 0 THEN cast(trunc(best) AS INT) ELSE 90 END AS similarity,
        CASE WHEN best >= 90 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, 'MERGE' AS action FROM best WHERE variants > 0""",
    ),
    "cluster_variants": entity_sql(
        f"{GROUPS}, {NAMES}", 'SELECT _entity_id, "primary", name AS variant FROM nm WHERE size > 1 AND lower(name) <> lower("primary")'
    ),
    "entity_stats": entity_sql(
        f"{GROUPS}, {NAMES}",
        """SELECT (SELECT cast(sum(size) AS BIGINT) FROM heads WHERE size > 1) AS matched_entities, (SELECT count(*) FROM heads WHERE size = 1) AS unmatched_records,
        (SELECT count(*) FROM best WHERE variants > 0) AS potential_duplicates, (SELECT count(*) FROM best WHERE best >= 90) AS high_confidence_matches""",
    ),
    "probable_duplicates": probable_sql(
        """SELECT primary_row, "primary", count(*) AS members, CASE WHEN max(sim) > 0 THEN cast(trunc(max(sim)) AS INT) ELSE 90 END AS similarity,
        CASE WHEN max(sim) >= 90 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM mem GROUP BY 1, 2"""
    ),
    "probable_duplicate_rows": probable_sql("SELECT * FROM mem"),
    "merge_strategy": check_sql(
        ["contacts"],
        """SELECT 'set_' || cast(floor(_row_idx / 4) AS BIGINT) AS dataset, CASE WHEN count(*) FILTER (GSTIN IS NOT NULL) >= 2 THEN 'GSTIN'
        WHEN count(*) FILTER (GSTIN IS NULL AND Email IS NOT NULL) >= 2 THEN 'Customer_ID' ELSE 'Customer_Name' END AS key,
        'Entity Resolution' AS strategy FROM contacts GROUP BY 1""",
    ),
    "conflicts": entity_sql(f"{GROUPS}, {NAMES}, {CONFLICT}", "SELECT * FROM cf"),
    "source_contributions": entity_sql(record_sql(), "SELECT _source_id, count(*) AS records FROM recs GROUP BY 1"),
    "merge_preview": entity_sql(
        f"{GROUPS}, {NAMES}, {CONFLICT}",
        """SELECT count(*) AS unique_entities, cast(sum(size) FILTER (size > 1) AS BIGINT) AS matched_records, count(*) FILTER (size = 1) AS unmatched_records,
        cast(sum(size - 1) AS BIGINT) AS duplicates_resolved, (SELECT count(*) FROM cf) AS conflicts_detected, 16 AS new_columns FROM heads""",
    ),
    "merge_outer": golden_sql("true"),
    "merge_left": golden_sql("bool_or(_src_pos = 0)"),
    "merge_inner": golden_sql("count(DISTINCT _source_id) = 3"),
    "merge_overrides": golden_sql("true", True),
    "provenance": entity_sql(GROUPS, "SELECT _entity_id, _rec, _source_id AS source, _row_idx AS row_idx, name AS original_name FROM ent"),
    "provenance_log": entity_sql(
        GROUPS,
        """SELECT _entity_id, _source_id AS source, _row_idx // 1000 AS part, '[' || string_agg('{"source":"' || _source_id || '","row_idx":' || _row_idx || ',"original_name":"' || name || '"}', ',' ORDER BY _row_idx)
        || ']' AS _provenance_log FROM ent GROUP BY 1, 2, 3""",
    ),
}
