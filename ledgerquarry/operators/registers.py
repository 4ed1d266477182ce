"""Order, receipt, invoice and payment lines to registers of what is outstanding. Quantities are in thousandths and money
in cents (BIGINT), so sums are exact in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chain(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One row per order line from tagged lines (keys, kind, qty_m, amt_c): ordered, received, invoiced, credited and the
    order's amount. A single aggregation instead of four joins; orders only."""
    total = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0)).cast("bigint")
    out = lines.groupBy(*keys).agg(
        total("order", "qty_m").alias("ordered_m"), total("order", "amt_c").alias("amt_c"), total("receipt", "qty_m").alias("received_m"),
        total("invoice", "qty_m").alias("invoiced_m"), total("credit", "qty_m").alias("credited_m"), F.count_if(F.col("kind") == "order").alias("n_orders"),
    )
    return out.where("n_orders > 0").drop("n_orders")


def outstanding(chains: DataFrame, keys: list[str], left: Column, right: Column) -> DataFrame:
    """Rows where ``left`` exceeds ``right``, with the difference in thousandths and what it is worth: its share of the
    order line's amount, in whole cents (null where nothing was ordered)."""
    gap = (left - right).cast("bigint")
    worth = F.when(F.col("ordered_m") > 0, F.expr("amt_c") * gap)
    return chains.where(left > right).select(*keys, left.cast("bigint").alias("left_m"), right.cast("bigint").alias("right_m"), gap.alias("open_m"), F.floor(worth.cast("decimal(38,0)") / F.col("ordered_m")).cast("bigint").alias("value_c"))


def statement_matches(entries: DataFrame, held: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Entries listed and held (``left_semi``) or not held (``left_anti``); null keys are never held."""
    return entries.join(held.select(*keys).distinct(), keys, how)


def recall_precision(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row: true, found and shared keys with recall and precision; null where there is nothing to divide by."""
    t, f = truth.select(*keys).distinct().withColumn("in_truth", F.lit(1)), found.select(*keys).distinct().withColumn("in_found", F.lit(1))
    both = t.join(f, keys, "full_outer")
    out = both.agg(F.count("in_truth").alias("n_true"), F.count("in_found").alias("n_found"), F.count_if(F.col("in_truth").isNotNull() & F.col("in_found").isNotNull()).alias("n_both"))
    return out.select("n_true", "n_found", "n_both", F.try_divide("n_both", "n_true").alias("recall"), F.try_divide("n_both", "n_found").alias("precision"))
