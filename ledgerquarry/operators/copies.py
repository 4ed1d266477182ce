"""Repeated items and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerquarry.runtime import cut, fresh_name, hot_keys


def mark_copies(df: DataFrame, content: Column, order: Column, name: str = "first_seen") -> DataFrame:
    """Keeps every row; ``name`` holds the order value of the first row with the same content (its own if it is first).

    One aggregation of (hash, order) with map-side combine; only contents that occur more than once are joined back, and
    the rows of a content that many share are spread over partitions. Null content is no copy of anything.
    """
    h, o = fresh_name(df, "content_hash"), fresh_name(df, "content_order")
    keyed = df.withColumn(h, F.sha2(content.cast("binary"), 256)).withColumn(o, order)
    seen = cut(keyed.where(F.col(h).isNotNull()).groupBy(F.col(h).alias("__c")).agg(F.min(o).alias(name), F.count("*").alias("__n")).where("__n > 1"))
    hot = hot_keys(seen, ["__c"], "__n")
    marked = F.broadcast(hot.select(F.col("__c").alias("__hc"), F.lit(True).alias("__hot")))
    spread = lambda d, key: d.join(marked, d[key] == F.col("__hc"), "left")
    salted = spread(keyed, h).withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(o), F.lit(64))).otherwise(0).cast("int")).drop("__hc", "__hot")
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(0)))
    firsts = spread(seen, "__c").select(F.col("__c"), F.col(name), F.explode(every).alias("__s"))
    return salted.join(firsts, (F.col(h) == F.col("__c")) & (F.col("__salt") == F.col("__s")), "left").withColumn(name, F.coalesce(F.col(name), F.col(o))).drop("__c", "__salt", "__s", h, o)


def canonical_documents(df: DataFrame, key: list[Column], order: str, ref: str) -> DataFrame:
    """One row per key that occurs: first order value, number of distinct orders, their refs sorted (at most as many as
    the documents of one number). Rows with a null or empty key part never merge and are left out."""
    names = [f"key_{i}" for i in range(len(key))]
    keyed = df.select(*[k.alias(n) for k, n in zip(key, names)], F.col(order).alias("__o"), F.col(ref).alias("__r"))
    keyed = keyed.where(" and ".join(f"{n} is not null and {n} <> ''" for n in names))
    return keyed.groupBy(*names).agg(F.min("__o").alias("first_id"), F.count_distinct("__o").alias("copies"), F.min("__r").alias("first_ref"))
