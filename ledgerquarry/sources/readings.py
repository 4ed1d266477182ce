"""What a page reader says, and the context a folder comes with.

A page reader is any function from image bytes to JSON text; the engine only takes its answer apart. ``Reader`` names the
interface, so callers can bring a model of their own; none is called by default.

Defined cases: text that is no JSON object is an empty reading of type 'unknown'; a type that is not known is 'unknown';
page n of m counts only where both are whole numbers; null and empty fields are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerquarry.operators.fields import HEADER_OF


class Reader(Protocol):
    def read_page(self, image: bytes) -> str: ...


_RAW = "struct<doc_type:string,page_no:string,page_of:string,fields:map<string,string>,lines:array<map<string,string>>>"


def page_reading(raw: Column) -> Column:
    """struct(doc_type, page_n, page_m, fields, lines) of a reader's JSON answer."""
    x = F.from_json(raw, _RAW)
    kind = F.when(x["doc_type"].isin(*HEADER_OF), x["doc_type"]).otherwise("unknown")
    whole = x["page_no"].rlike(r"^\d+$") & x["page_of"].rlike(r"^\d+$")
    kept = lambda m: F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: F.coalesce(F.trim(v), F.lit("")) != "")
    return F.struct(
        F.coalesce(kind, F.lit("unknown")).alias("doc_type"), F.when(whole, x["page_no"].try_cast("int")).alias("page_n"), F.when(whole, x["page_of"].try_cast("int")).alias("page_m"),
        kept(x["fields"]).alias("fields"), F.filter(F.transform(F.coalesce(x["lines"], F.array().cast("array<map<string,string>>")), kept), lambda m: F.size(m) > 0).alias("lines"),
    )


def read_pages(pages: DataFrame, make_reader: Callable[[], Reader], *, at_once: int = 1) -> DataFrame:
    """``pages`` (ref, page, content) with ``reading``: a reader is made once per task; ``at_once`` tasks run, since readers
    are often limited in their rate. A page the reader fails on has an empty reading."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make_reader()
        for pdf in batches:
            answers = []
            for content in pdf["content"]:
                try:
                    answers.append(reader.read_page(bytes(content)))
                except Exception:  # the page stays, unread
                    answers.append(None)
            yield pd.DataFrame({"ref": pdf["ref"], "page": pdf["page"], "raw": answers})

    raw = pages.select("ref", "page", "content").repartition(at_once).mapInPandas(run, "ref string, page int, raw string")
    return raw.select("ref", "page", page_reading(F.col("raw")).alias("reading"))


def load_context(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(buyer, suppliers) of a context file {buyer: {name, abn}, suppliers: [{name, abn, aliases}]}: the buyer as one row,
    suppliers numbered in their order, which decides ties."""
    schema = "buyer struct<name:string,abn:string>, suppliers array<struct<name:string,abn:string,aliases:array<string>>>"
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    suppliers = whole.select(F.posexplode("suppliers").alias("n", "s")).select((F.col("n") + 1).cast("bigint").alias("supplier_id"), "s.name", "s.abn", "s.aliases")
    return whole.select("buyer.name", "buyer.abn"), suppliers
