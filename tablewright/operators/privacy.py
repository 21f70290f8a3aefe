"""Sensitive columns and role-based masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.masking import mask_value
from tablewright.functions.text import any_keyword, has_keyword

# Name parts per class; the first class that fits counts.
FINANCIAL = ("revenue", "sales", "profit", "amount", "salary", "bill", "paid")
SENSITIVE = ("pan", "aadhaar", "ssn", "bank", "account", "gstin", "tax")
PERSONAL = ("email", "phone", "mobile", "address", "contact", "customer", "name", "client")


def sensitivity(name: str) -> str:
    if has_keyword(name, FINANCIAL):
        return "Financial"
    if has_keyword(name, SENSITIVE):
        return "Sensitive"
    return "PII" if has_keyword(name, PERSONAL) else "Standard"


def sensitivity_column(name: Column) -> Column:
    return (
        F.when(any_keyword(name, FINANCIAL), "Financial")
        .when(any_keyword(name, SENSITIVE), "Sensitive")
        .when(any_keyword(name, PERSONAL), "PII")
        .otherwise("Standard")
    )


def risk_level(columns: list[str]) -> str:
    classes = {sensitivity(c) for c in columns}
    return "High" if "Sensitive" in classes else "Medium" if "PII" in classes else "Low"


def scan_catalog(columns: DataFrame) -> DataFrame:
    """Sensitivity of each column and risk of each dataset, for a ``(dataset, column)`` table."""
    classed = columns.select("dataset", "column", sensitivity_column(F.col("column")).alias("classification"))
    risk = classed.groupBy("dataset").agg(
        F.when(F.bool_or(F.col("classification") == "Sensitive"), "High")
        .when(F.bool_or(F.col("classification") == "PII"), "Medium")
        .otherwise("Low")
        .alias("risk_level"),
        F.count_if(F.col("classification").isin("Sensitive", "PII")).alias("sensitive_columns"),
    )
    return classed.join(risk, "dataset")


#: Key of a column's metadata under which its class and the columns it stems from are carried.
CARRIED = "sensitivity"


def marked(df: DataFrame) -> DataFrame:
    """``df`` with the class of every column in its metadata, which selections, filters, joins and files keep."""
    return df.select(
        *[
            F.col(f"`{f.name}`").alias(f.name, metadata={**f.metadata, CARRIED: {"class": sensitivity(f.name), "origin": [f.name]}})
            if not f.name.startswith("_") and CARRIED not in f.metadata
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def carried(df: DataFrame, *names: str) -> dict[str, object]:
    """Metadata for a column made from the named columns: the strictest of their classes and all origins."""
    found = [m for f in df.schema.fields if f.name in names and (m := f.metadata.get(CARRIED))]
    if not found:
        return {}
    classes = [m["class"] for m in found]
    strictest = next((c for c in ("Sensitive", "PII", "Financial") if c in classes), "Standard")
    return {CARRIED: {"class": strictest, "origin": sorted({o for m in found for o in m["origin"]})}}


def hidden_columns(df: DataFrame) -> list[str]:
    """Columns that are personal or sensitive by their name or by the class they carry."""
    kept = ("PII", "Sensitive")
    return [f.name for f in df.schema.fields if not f.name.startswith("_") and (sensitivity(f.name) in kept or f.metadata.get(CARRIED, {}).get("class") in kept)]


def mask_for_role(df: DataFrame, role: str) -> DataFrame:
    """ADMIN sees all, VIEWER no rows, everybody else masked personal and sensitive columns, by name or by carried class."""
    if role == "ADMIN":
        return df
    if role == "VIEWER":
        return df.limit(0)
    hidden = hidden_columns(df)
    return df.select(*[mask_value(F.col(f"`{c}`").cast("string")).alias(c) if c in hidden else F.col(f"`{c}`") for c in df.columns])
