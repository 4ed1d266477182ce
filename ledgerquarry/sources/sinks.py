"""Documents and registers to JSON and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def field_documents(values: DataFrame, key: str = "read_id") -> DataFrame:
    """(key, document): one JSON text per document with its fields sorted by name, each with value, confidence, evidence."""
    field = F.struct("field_name", F.col("value"), F.col("confidence"), F.col("evidence"))
    return values.where("value <> ''").groupBy(key).agg(F.to_json(F.array_sort(F.collect_set(field)), {"ignoreNullFields": "false"}).alias("document"))


def money_text(c):
    """$1,234.56 from cents; n/a for null."""
    return F.when(c.isNull(), "n/a").otherwise(F.concat(F.lit("$"), F.format_number((c / 100).cast("decimal(20,2)"), 2)))


def write_json(df: DataFrame, folder: str) -> None:
    """One dataset of JSON lines; written by the tasks, replaced as a whole."""
    df.write.mode("overwrite").json(folder)


def report_lines(sections: list[tuple[str, DataFrame, str, str, str | None]]) -> DataFrame:
    """(place, line): the lines of a text report in their order.

    ``sections``: (heading, a small aggregate, its key column, count column, cents column or None). Every section gives its
    heading with the total, then a line per key in the key's order; sections without rows give their heading alone.
    """
    parts = []
    for i, (heading, df, key, n, cents) in enumerate(sections):
        amount = F.concat(F.lit("  "), money_text(F.col("c"))) if cents else F.lit("")
        rows = df.select(F.col(key).cast("string").alias("k"), F.col(n).cast("bigint").alias("n"), (F.col(cents) if cents else F.lit(None)).cast("bigint").alias("c"))
        total = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("c").alias("c"))
        parts.append(total.select(F.lit(i).alias("section"), F.lit("").alias("k"), F.concat(F.lit(f"{heading}: "), F.col("n").cast("string"), amount).alias("line")))
        parts.append(rows.select(F.lit(i).alias("section"), F.coalesce("k", F.lit("?")).alias("k"), F.concat(F.lit("  "), F.coalesce("k", F.lit("?")), F.lit(": "), F.col("n").cast("string"), amount).alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # A report has as many lines as its aggregates have keys: one task may number them.
    return out.select(F.row_number().over(W.orderBy("section", "k")).alias("place"), "line")


def score_json(tallies: DataFrame, folder: str) -> None:
    """Tallies (field_name, source, n_right, n_all) as JSON lines with their share, for the scorer's readers."""
    write_json(tallies.withColumn("share", F.round(F.try_divide("n_right", "n_all"), 6)), folder)
