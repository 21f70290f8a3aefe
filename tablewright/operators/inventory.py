"""Sales against stock."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.numbers import strict_int
from tablewright.functions.text import strip
from tablewright.operators.columns import ROW, data_columns

# Column names, exact and lower case, in order of preference; else the column at that place.
SKU = (("sku", "product_id"), 0)
PRODUCT = (("product_name", "product"), 1)
SOLD = (("quantity_sold", "quantity", "qty"), 2)
STOCK = (("stock_remaining", "quantity", "stock"), 2)
#: A test of (stock, sold), such as a comparison with a stock count.
Variance = Callable[[Column, Column], Column]
# Stock below this is low.
LOW_STOCK = 5


def pick(df: DataFrame, wanted: tuple[tuple[str, ...], int]) -> Column:
    columns = data_columns(df)
    by_name = {c.lower(): c for c in columns}
    name = next((by_name[n] for n in wanted[0] if n in by_name), None)
    return F.col(f"`{name or columns[wanted[1]]}`").cast("string")


def matched_sales(pos: DataFrame, inventory: DataFrame) -> DataFrame:
    """Every sales row with the stock of the first inventory row of its SKU, NULL if there is none."""
    sales = pos.select(
        F.col(ROW).alias("_pos_row"), strip(pick(pos, SKU)).alias("sku"), strip(pick(pos, PRODUCT)).alias("product_name"),
        strict_int(pick(pos, SOLD)).alias("sold"),
    )
    # min_by combines on the map side, so a SKU listed very often is no hot key.
    first = inventory.groupBy(strip(pick(inventory, SKU)).alias("sku")).agg(
        F.min_by(strict_int(pick(inventory, STOCK)), ROW).alias("stock")
    )
    return sales.join(first, "sku", "left")


def _finding(test: Column, kind: str, severity: str, details: Column) -> Column:
    row = F.struct(F.lit(kind).alias("anomaly_type"), F.lit(severity).alias("severity"), details.alias("details"))
    return F.when(test, row)


def reconcile_inventory(pos: DataFrame, inventory: DataFrame, variance: Variance | None = None) -> DataFrame:
    """All findings: unknown SKUs on either side, negative and low stock, and stock that ``variance`` finds to deviate."""
    stock, sold = F.col("stock"), F.col("sold")
    units = stock.cast("string")
    findings = F.array(
        _finding(stock.isNull(), "Missing SKU in Stock Logs", "High", F.concat(
            F.lit("Product is recorded in POS sales ("), sold.cast("string"), F.lit(" units sold) but does not exist in inventory lists."))),
        _finding(stock < 0, "Negative Stock Balance", "Critical", F.concat(
            F.lit("Inventory database records negative stock balance: "), units, F.lit(" units remaining."))),
        _finding((stock >= 0) & (stock < LOW_STOCK), "Critical Low Stock", "Warning", F.concat(
            F.lit("Stock is depleted. Only "), units, F.lit(" units remaining in warehouse inventory."))),
        _finding(variance(stock, sold) if variance else F.lit(False), "Stock-Sales Discrepancy", "High", F.concat(
            F.lit("POS and warehouse inventory logs differ by "), sold.cast("string"), F.lit(" units. Discrepancy requires physical audit."))),
    )
    by_sale = matched_sales(pos, inventory).select("sku", "product_name", F.explode(F.array_compact(findings)).alias("f"))
    stocked = inventory.select(
        strip(pick(inventory, SKU)).alias("sku"), strip(pick(inventory, PRODUCT)).alias("product_name"), pick(inventory, STOCK).alias("_raw")
    )
    sold_skus = pos.select(strip(pick(pos, SKU)).alias("sku")).distinct()
    unsold = stocked.join(sold_skus, "sku", "left_anti").select(
        "sku", "product_name", F.lit("Missing SKU in POS Sales").alias("anomaly_type"), F.lit("Info").alias("severity"),
        F.concat(F.lit("SKU exists in stock logs ("), F.coalesce("_raw", F.lit("nan")), F.lit(" units remaining) but has no record of POS sales.")).alias("details"),
    )
    return by_sale.select("sku", "product_name", "f.*").unionByName(unsold)


def inventory_stats(pos: DataFrame, inventory: DataFrame, variance: Variance | None = None) -> DataFrame:
    """Row counts of each finding and of the sales rows with stock."""
    kinds = {
        "mismatch_skus": ("Stock-Sales Discrepancy",), "negative_stock_skus": ("Negative Stock Balance",),
        "low_stock_skus": ("Critical Low Stock",), "missing_skus": ("Missing SKU in Stock Logs", "Missing SKU in POS Sales"),
    }
    zero = F.lit(0).cast("bigint")
    found = reconcile_inventory(pos, inventory, variance).agg(
        zero.alias("reconciled_skus"), *[F.count_if(F.col("anomaly_type").isin(*v)).alias(k) for k, v in kinds.items()]
    )
    fine = matched_sales(pos, inventory).agg(F.count("stock").alias("reconciled_skus"), *[zero.alias(k) for k in kinds])
    return found.unionByName(fine).agg(*[F.sum(c).alias(c) for c in found.columns])
