"""Tables from and to files: CSV, Parquet, several tagged sources, the admission gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.columns import ROW, data_columns
from tablewright.operators.privacy import mask_for_role
from tablewright.operators.schemas import detect_sources

# Admission limits.
MAX_BYTES = 10 * 1024 * 1024
EXTENSIONS = ("csv", "xlsx", "xls")
# Texts a reader takes for a missing cell.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
CORRUPT = "_corrupt_record"
#: What the reader puts in the place of bytes that are not UTF-8.
UNDECODED = "\ufffd"


def read_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None) -> DataFrame:
    """CSV as text columns; the usual missing marks become NULL, rows that do not fit go to ``_corrupt_record``.

    Bytes that are not UTF-8 are dropped.
    Without ``columns`` the header of the files is used.
    """
    names = list(columns) if columns else spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
    table = (
        spark.read.schema(schema)
        .options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, encoding="UTF-8", nullValue="", enforceSchema=False, escape='"')
        .csv(path)
    )
    cells = {c: F.replace(F.col(f"`{c}`"), F.lit(UNDECODED), F.lit("")) for c in names}
    return table.select(*[F.when(~cell.isin(*MISSING), cell).alias(c) for c, cell in cells.items()], CORRUPT)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_row_order(df: DataFrame, order: str) -> DataFrame:
    """Take a unique whole-number column as the row order; a table has no other order in Spark."""
    return df.withColumn(ROW, F.col(order).cast("bigint"))


def tagged(df: DataFrame, source_id: str) -> DataFrame:
    return df.withColumn("_source_id", F.lit(source_id)).withColumn("_file", F.input_file_name())


def source_report(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """File name, detected kind, rows, columns and size of each CSV source."""
    rows = None
    for sid, path in paths.items():
        names = spark.read.option("header", True).csv(path).columns
        table = spark.read.option("header", True).csv(path)
        sizes = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("size"))
        counted = table.agg(F.count("*").alias("rows")).select(
            F.lit(sid).alias("id"), F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("filename"), "rows",
            F.lit(len(names)).alias("cols"), F.array(*[F.lit(n) for n in names]).alias("columns"),
        ).join(sizes.withColumn("id", F.lit(sid)), "id")
        rows = counted if rows is None else rows.unionByName(counted)
    return detect_sources(rows).drop("columns", "reason").withColumnRenamed("detected_source", "source_type")


def admission(spark: SparkSession, path: str, signature: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Verdict per file, checks in the order size, content, extension; the bytes of larger files are never read."""
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= max_bytes)
    infected = small.where(F.contains(F.col("content"), F.lit(signature.encode()))).select("path", F.lit(True).alias("infected"))
    extension = F.lower(F.element_at(F.split("path", r"\."), -1))
    reason = (
        F.when(F.col("length") > max_bytes, "File too large. Limits are set at 10MB.")
        .when(F.col("infected"), "Security Scan Blocked")
        .when(~extension.isin(*EXTENSIONS), "Unsupported file format. Please upload CSV or Excel spreadsheet.")
    )
    return files.select("path", "length").join(infected, "path", "left").select("path", "length", reason.alias("reason"), reason.isNull().alias("accepted"))


def export_masked(df: DataFrame, role: str, path: str) -> None:
    """CSV of what the role may see."""
    masked = mask_for_role(df, role)
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    masked.select(*data_columns(masked)).write.mode("overwrite").options(header=True, escape='"', **kept).csv(path)


def save_merged(golden: DataFrame, folder: str, name: str, meta: dict[str, str]) -> None:
    """Write the unified table and append its metadata row."""
    golden.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    spark = golden.sparkSession
    row = spark.createDataFrame([(name, meta)], "dataset_id string, details map<string,string>")
    row.withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/_metadata.parquet")


def append_audit(entries: DataFrame, path: str) -> None:
    """Append ``line`` texts to the audit log, one folder per day."""
    entries.select("line", F.current_date().alias("day")).write.mode("append").partitionBy("day").text(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def dataset_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table."""
    rows = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("id"), "rows", F.lit(len(data_columns(df))).alias("cols"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def payload_intake(payloads: DataFrame, schema: str, required: Sequence[str] = ()) -> DataFrame:
    """``payloads`` (payload, ...) with the fields of the JSON ``schema`` and why a payload is turned away (null: accepted).

    A payload is turned away if it is no JSON object or lacks a required field. Batch and stream alike, one pass.
    """
    corrupt = "_broken"
    parsed = F.from_json("payload", f"{schema}, {corrupt} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    rows = payloads.withColumn("_json", parsed)
    fields = [n for n in rows.schema["_json"].dataType.fieldNames() if n != corrupt]
    lacking = F.array_compact(F.array(*[F.when(F.col(f"_json.`{n}`").isNull(), F.lit(n)) for n in required] or [F.lit(None).cast("string")]))
    broken = F.col("payload").isNull() | F.col("_json").isNull() | F.col(f"_json.{corrupt}").isNotNull()
    reason = F.when(broken, "malformed").when(F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(lacking, ", ")))
    return rows.select(*payloads.columns, *[F.when(~broken, F.col(f"_json.`{n}`")).alias(n) for n in fields], reason.alias("reason"))


def json_payloads(raw: DataFrame, system: Column, time: Column) -> DataFrame:
    """Payload rows from a text or JSON-line reader, batch or stream alike."""
    return raw.select(
        F.xxhash64("value").alias("payload_id"), system.alias("system_id"), time.alias("ts"), F.col("value").alias("payload")
    )
