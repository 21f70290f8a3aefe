"""Profile, quality and fix queries over the messy orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions import cells as cell_fn
from tablewright.functions import numbers, text
from tablewright.operators import profile, quality
from tablewright.operators.columns import ROW, data_columns, text_cells
from tablewright.plans import sqltext as q
from tablewright.plans.fixtures import check_sql, derived

COLUMNS = ["OrderID", "Client", "Phone", "Region", "Revenue", "OrderDate"]


def messy(spark: SparkSession, folder: str) -> DataFrame:
    return derived(spark, folder, "messy_orders")


def number_parse(spark, folder):
    cells = text_cells(messy(spark, folder), keep=[ROW])
    v = F.col("value")
    return cells.select(
        ROW, "column", numbers.parse_money(v).alias("money"), numbers.parse_plain(v).alias("plain"),
        numbers.strict_float(v).alias("strict"), numbers.strict_int(v).alias("whole"), numbers.percent_text(v).alias("pct"),
    )


def text_forms(spark, folder):
    c, p = F.col("Client"), F.col("Phone")
    return messy(spark, folder).select(
        ROW, text.strip(F.col("Region")).alias("region"), text.title_case(text.strip(c)).alias("title"),
        text.normalize(c).alias("norm"), text.sort_tokens(text.normalize(c)).alias("sorted"),
        text.last_ten_digits(p).alias("phone10"), text.clean_reference(F.col("OrderID")).alias("ref"),
        text.normalize_header(F.col("OrderDate")).alias("header"),
    )


def cell_types(spark, folder):
    cells = text_cells(messy(spark, folder))
    kind = F.coalesce(cell_fn.cell_type(F.col("value")), F.lit("empty"))
    return cells.groupBy("column", kind.alias("kind")).agg(F.count("*").alias("cells"))


def column_profile(spark, folder):
    return profile.column_profile(messy(spark, folder))


def missing_issues(spark, folder):
    found = quality.issues(messy(spark, folder))
    return found.where(F.col("type") == "Completeness").select("id", "column", "severity", "description")


def all_issues(spark, folder):
    return quality.issues(messy(spark, folder)).select("seq", "id", "column", "severity", "type", "title", "description")


QUERIES = {
    "number_parse": number_parse,
    "text_forms": text_forms,
    "cell_types": cell_types,
    "column_profile": column_profile,
    "table_profile": lambda s, d: profile.table_profile(messy(s, d)),
    "missing_cells": lambda s, d: profile.missing_cells(messy(s, d)),
    "missing_issues": missing_issues,
    "tiered_completeness": lambda s, d: profile.tiered_completeness(messy(s, d)),
    "preview_head": lambda s, d: profile.preview(messy(s, d)),
    "case_variants": lambda s, d: quality.case_variants(messy(s, d)),
    "negative_values": lambda s, d: quality.column_checks(messy(s, d)).where("negatives > 0").select("column", "negatives"),
    "duplicate_rows": lambda s, d: quality.duplicate_count(messy(s, d)),
    "mixed_types": lambda s, d: quality.column_checks(messy(s, d)).select(
        "column", "num_cells", "date_cells", "text_cells", "mixed"
    ),
    "iqr_outliers": lambda s, d: quality.outlier_report(messy(s, d), ["Revenue", "Phone", "Region"]),
    "iqr_outlier_rows": lambda s, d: quality.outlier_rows(messy(s, d), ["Revenue", "Phone"]),
    "quality_issues": all_issues,
    "quality_scorecard": lambda s, d: quality.scorecard(messy(s, d), "messy_orders"),
}

TIERS = {"critical": ["OrderID", "Revenue"], "standard": ["Phone", "OrderDate"], "optional": ["Client", "Region"]}
MIXED = """CASE WHEN num_cells + date_cells + text_cells = 0 THEN false ELSE
  greatest(num_cells, date_cells, text_cells)::DOUBLE / (num_cells + date_cells + text_cells) < 0.95::DOUBLE END"""


def penalty(count: str, over: str, factor: int, low: int) -> str:
    return f"cast(greatest({low}, least(100, round_even(100 - {count}::DOUBLE / {over} * {factor}, 0))) AS INTEGER)"


def tier_case(tiers: dict[str, list[str]]) -> str:
    return "CASE \"column\" " + " ".join(f"WHEN '{c}' THEN '{t}'" for t, cs in tiers.items() for c in cs) + " END"


class Steps:
    """SQL of every step from the cells of one table to its scores."""

    def __init__(self, table: str, columns: list[str], tiers: dict[str, list[str]], positive: list[str], p: str = ""):
        quoted = ", ".join(f"'{c}'" for c in positive) or "''"
        self.p, self.tier = p, tier_case(tiers)
        self.cells = f"{p}cells AS ({q.cells(table, columns)})"
        self.facts = f"""{self.cells},
{p}typed AS (SELECT *, {q.cell_type('v')} AS t, {q.money('v')} AS x, {q.empty('v')} AS e FROM {p}cells),
{p}facts AS (SELECT ord, "column", count(*) AS n, count(v) AS present, count(*) FILTER (e) AS missing,
  count(*) FILTER (t = 'num') AS num_cells, count(*) FILTER (t = 'date') AS date_cells, count(*) FILTER (t = 'text') AS text_cells,
  count(*) FILTER (x < 0) AS negatives, count(DISTINCT v) AS cardinality,
  bool_and(x IS NOT NULL OR {q.money_text('v')} = '') FILTER (v IS NOT NULL) AS all_numeric,
  avg(x) AS mean, min(x) AS min, max(x) AS max, stddev_samp(x) AS std FROM {p}typed GROUP BY ord, "column"),
{p}dates AS (SELECT ord, bool_and({q.date('v')} IS NOT NULL) AS dated FROM {p}cells WHERE v IS NOT NULL GROUP BY ord),
{p}kinds AS (SELECT f.*, CASE WHEN present > 0 AND all_numeric THEN 'Numeric' WHEN dated THEN 'DateTime/Other' ELSE 'Categorical' END AS type
  FROM {p}facts f LEFT JOIN {p}dates e ON f.ord = e.ord)"""
        self.variants = f"""{p}spell AS (SELECT ord, "column", lower(s) AS folded, s, min(_row_idx) AS first FROM (
  SELECT *, {q.strip('v')} AS s FROM {p}cells WHERE NOT {q.empty('v')}) z GROUP BY 1, 2, 3, 4),
{p}folds AS (SELECT ord, "column", folded, count(*) AS variants, string_agg(s, ', ' ORDER BY first) AS shown FROM {p}spell
  GROUP BY 1, 2, 3 HAVING count(*) > 1),
{p}variants AS (SELECT ord, "column", count(*) AS groups, cast(sum(variants - 1) AS BIGINT) AS surplus,
  min_by(shown, folded) AS example FROM {p}folds GROUP BY 1, 2)"""
        self.fences = f"""{p}quart AS (SELECT ord, "column", count(x) AS numbers, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b
  FROM {p}typed WHERE x IS NOT NULL GROUP BY 1, 2 HAVING count(x) >= 4),
{p}fences AS (SELECT ord, "column", numbers, a - 1.5::DOUBLE * (b - a) AS lower_bound, b + 1.5::DOUBLE * (b - a) AS upper_bound FROM {p}quart),
{p}outl AS (SELECT t.ord, t."column", max(numbers) AS numbers, max(lower_bound) AS lower_bound, max(upper_bound) AS upper_bound,
  count(*) FILTER (x < lower_bound OR x > upper_bound) AS outliers_count
  FROM {p}typed t JOIN {p}fences f ON t.ord = f.ord WHERE x IS NOT NULL GROUP BY 1, 2)"""
        self.dups = f"""{p}dups AS (SELECT cast(sum(c) AS BIGINT) AS num_rows, cast(sum(c - 1) AS BIGINT) AS duplicates FROM (
  SELECT count(*) AS c FROM {table} GROUP BY {', '.join(columns)}) z)"""
        checks = f"""{p}checks AS (SELECT f.ord, f."column", n, missing, num_cells, date_cells, text_cells, example, {MIXED} AS mixed,
  CASE WHEN f."column" IN ({quoted}) THEN negatives ELSE 0 END AS negatives, coalesce(surplus, 0) AS surplus,
  coalesce(outliers_count, 0) AS outliers
  FROM {p}facts f LEFT JOIN {p}variants v ON f.ord = v.ord LEFT JOIN {p}outl o ON f.ord = o.ord)"""
        self.all = f"{self.facts}, {self.variants}, {self.fences}, {self.dups}, {checks}"
        sums = ", ".join(
            f"sum(n) FILTER ({self.tier} = '{t}') AS {t}_n, sum(missing) FILTER ({self.tier} = '{t}') AS {t}_m" for t in tiers
        )
        shares = ", ".join(f"{q.pct(f'({t}_n - {t}_m)', f'{t}_n')} AS {t}_completeness" for t in tiers)
        self.scores = f"""{self.all},
{p}sums AS (SELECT sum(n) AS cells, sum(missing) AS missing, sum(surplus) AS surplus, sum(negatives) AS negatives,
  count(*) FILTER (mixed) AS mixed, sum(outliers) AS outliers, {sums} FROM {p}checks),
{p}dims AS (SELECT {q.pct('(cells - missing)', 'cells')} AS completeness, {shares},
  {penalty('surplus', 'num_rows', 100, 20)} AS consistency, {penalty('negatives', 'num_rows', 100, 30)} AS validity,
  {q.pct('(num_rows - duplicates)', 'num_rows')} AS duplicates, {penalty('mixed', str(len(columns)), 50, 30)} AS structure,
  {penalty('outliers', 'num_rows', 80, 40)} AS anomalies FROM {p}sums, {p}dups),
{p}scores AS (SELECT '{table}' AS dataset, *, cast(round_even(completeness * 0.20::DOUBLE + consistency * 0.20::DOUBLE
  + validity * 0.20::DOUBLE + duplicates * 0.15::DOUBLE + structure * 0.15::DOUBLE + anomalies * 0.10::DOUBLE, 0) AS INTEGER)
  AS overall_quality FROM {p}dims)"""


MESSY = Steps("messy_orders", COLUMNS, TIERS, ["Revenue"])
CELLS, FACTS, VARIANTS, FENCES, DUPS, ALL = MESSY.cells, MESSY.facts, MESSY.variants, MESSY.fences, MESSY.dups, MESSY.all
TIER_CASE = MESSY.tier


def messy_sql(ctes: str, select: str) -> str:
    return check_sql(["messy_orders"], f", {ctes}\n{select}")


TITLE = (
    "array_to_string(list_transform(regexp_extract_all({x}, '([A-Za-z]+|[^A-Za-z]+)'), "
    "lambda r: upper(r[1]) || lower(r[2:])), '')"
).format(x=q.strip("Client"))
ISSUE_SQL = f"""SELECT 100000 + ord AS seq, 'missing_' || "column" AS id, "column",
    CASE WHEN {q.pct('missing', 'n')} > 20 THEN 'Critical' ELSE 'High' END AS severity, 'Completeness' AS type,
    'Missing values in column "' || "column" || '"' AS title,
    missing || ' cells (' || {q.pct('missing', 'n')} || '%) are empty or null.' AS description FROM checks WHERE missing > 0
  UNION ALL SELECT 200000 + ord, 'consistent_' || "column", "column", 'Medium', 'Consistency',
    'Capitalization inconsistency in "' || "column" || '"',
    'Different spelling/casing variations detected (e.g. ' || example || ').' FROM checks WHERE surplus > 0
  UNION ALL SELECT 300000 + ord, 'invalid_neg_' || "column", "column", 'Critical', 'Validity',
    'Negative metrics in positive field "' || "column" || '"',
    'Found ' || negatives || ' negative records (e.g., negative revenues or warehouse count).' FROM checks WHERE negatives > 0
  UNION ALL SELECT 400000, 'duplicate_rows', 'All Columns', 'High', 'Duplicates', 'Exact duplicate rows',
    'Found ' || duplicates || ' duplicate records in dataset.' FROM dups WHERE duplicates > 0
  UNION ALL SELECT 500000 + ord, 'structure_' || "column", "column", 'Medium', 'Structure', 'Mixed data types in "' || "column" || '"',
    'Column contains mixed string and numeric inputs (e.g. numeric metrics containing string format units).' FROM checks WHERE mixed
  UNION ALL SELECT 600000 + ord, 'outlier_' || "column", "column", 'High', 'Anomaly', 'Extreme numeric outliers in "' || "column" || '"',
    'Detected ' || outliers || ' statistical outlier elements.' FROM checks WHERE outliers > 0 AND "column" IN ('Revenue')"""
STRICT = "regexp_replace(v, '[^0-9.\\-]', '', 'g')"
CHECKS = {
    "number_parse": messy_sql(
        CELLS,
        f"""SELECT _row_idx, "column", {q.money('v')} AS money, {q.plain('v')} AS plain,
        coalesce({q.number(STRICT)}, 0) AS strict,
        coalesce(cast(trunc({q.plain('v')}) AS BIGINT), 0) AS whole, {q.number(q.strip("replace(v, '%', '')"))} AS pct FROM cells""",
    ),
    "text_forms": check_sql(
        ["messy_orders"],
        f"""SELECT _row_idx, {q.strip('Region')} AS region, {TITLE} AS title, {q.squeeze('Client')} AS norm,
        {q.sort_words(q.squeeze('Client'))} AS sorted, right(regexp_replace(Phone, '\\D', '', 'g'), 10) AS phone10,
        lower(replace(replace({q.strip('OrderID')}, '-', ''), ' ', '')) AS ref,
        trim(regexp_replace(lower({q.strip('OrderDate')}), '[_\\-\\s]+', ' ', 'g')) AS header FROM messy_orders""",
    ),
    "cell_types": messy_sql(
        CELLS, f"""SELECT "column", coalesce({q.cell_type('v')}, 'empty') AS kind, count(*) AS cells FROM cells GROUP BY 1, 2"""
    ),
    "column_profile": messy_sql(
        FACTS,
        f"""SELECT ord AS ordinal, "column", type, cardinality, missing, {q.pct('missing', 'n')} AS missing_pct,
        {', '.join(f"CASE WHEN type = 'Numeric' THEN round_even({s}, 2) END AS {s}" for s in ('mean', 'min', 'max', 'std'))} FROM kinds""",
    ),
    "table_profile": messy_sql(
        FACTS,
        """SELECT max(n) AS num_rows, count(*) AS num_cols, max(n) * count(*) AS total_cells,
        count(*) FILTER (type = 'Numeric') AS numeric_cols, count(*) FILTER (type = 'Categorical') AS categorical_cols,
        count(*) FILTER (type = 'DateTime/Other') AS datetime_cols FROM kinds""",
    ),
    "missing_cells": messy_sql(
        FACTS, """SELECT ord AS ordinal, "column", missing, round_even(missing * 100.0::DOUBLE / n, 1) AS missing_pct FROM facts"""
    ),
    "missing_issues": messy_sql(
        ALL, f"SELECT id, \"column\", severity, description FROM ({ISSUE_SQL}) i WHERE type = 'Completeness'"
    ),
    "tiered_completeness": messy_sql(
        FACTS,
        f"""SELECT {TIER_CASE} AS tier, cast(sum(n) AS BIGINT) AS cells, cast(sum(missing) AS BIGINT) AS missing,
        {q.pct('(sum(n) - sum(missing))', 'sum(n)')} AS completeness FROM facts GROUP BY 1""",
    ),
    "preview_head": check_sql(
        ["messy_orders"],
        f"SELECT _row_idx, {', '.join(f'coalesce({c}, {chr(39)*2}) AS {c}' for c in COLUMNS)} FROM messy_orders ORDER BY _row_idx LIMIT 10",
    ),
    "case_variants": messy_sql(f"{CELLS}, {VARIANTS}", "SELECT * FROM variants"),
    "negative_values": messy_sql(ALL, 'SELECT "column", negatives FROM checks WHERE negatives > 0'),
    "duplicate_rows": messy_sql(DUPS, "SELECT * FROM dups"),
    "mixed_types": messy_sql(FACTS, f'SELECT "column", num_cells, date_cells, text_cells, {MIXED} AS mixed FROM facts'),
    "iqr_outliers": messy_sql(
        f"{FACTS}, {FENCES}",
        """SELECT f."column", coalesce(outliers_count, 0) AS outliers_count, coalesce(lower_bound, 0) AS lower_bound,
        coalesce(upper_bound, 0) AS upper_bound FROM facts f LEFT JOIN outl o ON f.ord = o.ord
        WHERE f."column" IN ('Revenue', 'Phone', 'Region')""",
    ),
    "iqr_outlier_rows": messy_sql(
        f"{FACTS}, {FENCES}",
        """SELECT t."column", _row_idx, x AS value FROM typed t JOIN fences f ON t.ord = f.ord
        WHERE (x < lower_bound OR x > upper_bound) AND t."column" IN ('Revenue', 'Phone')""",
    ),
    "quality_issues": messy_sql(ALL, ISSUE_SQL),
    "quality_scorecard": messy_sql(MESSY.scores, "SELECT * FROM scores"),
}
