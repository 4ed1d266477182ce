"""Mixed timestamp formats and zones to one unambiguous form, through a dictionary of distinct values.

The distinct (text, zone) pairs of all columns form a dictionary; each entry is parsed exhaustively once; entries can be
kept in a folder and later runs parse only what is new; the results are joined back to the rows.

Defined cases: a null or blank zone is no zone; null or empty text, text that is no date and days that do not exist give no row; repeated rows give
repeated rows; an empty table gives none; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import inspect
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerquarry.functions import instants
from ledgerquarry.runtime import cut, hot_keys, join_spread, shared_dir, ship_package

ENTRY = "raw string, zone string, normal_form string"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(normal_form=[instants.normal_form(t, z or None) for t, z in zip(pdf["raw"], pdf["zone"])])


def parse_dictionary(distinct: DataFrame) -> DataFrame:
    """(raw, zone) pairs with their normal form, null where nothing is settled."""
    return distinct.select("raw", "zone").mapInPandas(_parse, ENTRY)


def dictionary_folder(spark) -> str:
    """Where entries are kept between runs: in the shared folder, apart for every version of the parser's rules."""
    rules = hashlib.sha256(inspect.getsource(instants).encode()).hexdigest()[:12]
    return f"{shared_dir(spark)}/instants-{rules}"


def dictionary(distinct: DataFrame, folder: str | None = None) -> DataFrame:
    """The entries of ``distinct`` (raw, zone; zone '' for none). With a folder, known entries are read, only new ones are
    parsed and added; entries that two runs add at once are the same and count once."""
    if folder is None:
        return parse_dictionary(distinct)
    spark = distinct.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(folder, "_SUCCESS"))
    known = spark.read.schema(ENTRY).parquet(folder) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None
    new = distinct if known is None else distinct.join(known, ["raw", "zone"], "left_anti")
    parse_dictionary(new).write.mode("append").parquet(folder)
    return spark.read.schema(ENTRY).parquet(folder).groupBy("raw", "zone").agg(F.max("normal_form").alias("normal_form"))


def normalise(df: DataFrame, id_col: str, columns: list[str], zone_col: str, folder: str | None = None) -> DataFrame:
    """(id, field_name, normal_form) for every column value that settles a day or instant.

    One shuffle counts the distinct (text, zone) pairs, with map-side combine; the counted pairs are the dictionary's
    entries and tell which of them are hot. The rows meet their entries in one join on (text, zone), in which the rows of
    hot entries are spread over many partitions.
    """
    ship_package(df.sparkSession)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("raw")) for c in columns]))
    zone = F.trim(F.coalesce(F.col(zone_col), F.lit("")))
    long = df.select(F.col(id_col).alias("__id"), zone.alias("zone"), cells.alias("cell")).select("__id", "zone", "cell.field_name", "cell.raw").where(F.length(F.trim("raw")) > 0)
    counts = cut(long.groupBy("raw", "zone").agg(F.count("*").alias("n")))
    entries = dictionary(counts.select("raw", "zone"), folder).where("normal_form is not null")
    joined = join_spread(long, entries, ["raw", "zone"], hot_keys(counts, ["raw", "zone"], "n"), F.col("__id"))
    return joined.select(F.col("__id").alias(id_col), "field_name", "normal_form")
