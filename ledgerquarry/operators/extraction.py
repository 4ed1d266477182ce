"""Rows of cells to documents: type, header fields with their evidence, and lines.

``extract`` joins the parts: the title gives the type, the type says what the number is called and which fields and lines
there are, tables bound where amounts are looked for, and the parties are settled in tiers: a business number of the
master list, a name of the master list on the page, a label, and last the letterhead.

Defined cases: a document whose title names no type is held, with no fields and no lines; a page without any name gives
no supplier; ties between entries of the master list go to the lower id; an empty master list leaves labels and letterhead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerquarry.functions.text import LEGAL_WORDS, find_abns, name_key
from ledgerquarry.operators import fields, titles
from ledgerquarry.runtime import broadcast_if_small, cut

#: Filled rows from the top in which a letterhead stands.
LETTERHEAD_ROWS = 14


@dataclass
class Extraction:
    """``documents`` (key, doc_type, score, status), ``values`` (key, field, value, printed, evidence), ``lines``."""

    documents: DataFrame
    values: DataFrame
    lines: DataFrame


def row_text(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " ")


def company_like(text: Column) -> Column:
    """A name with a word of a legal form in it."""
    return fields.name_like(text) & F.arrays_overlap(F.split(F.regexp_replace(F.lower(text), "[^a-z]+", " "), " "), F.array(*[F.lit(w) for w in LEGAL_WORDS if len(w) > 2]))


def same_party(a: Column, b: Column) -> Column:
    """Whether two names stand for one party: equal keys, or one the beginning of the other; false where either is empty."""
    x, y = name_key(a), name_key(b)
    return (x != "") & (y != "") & ((x == y) | F.concat(x, F.lit(" ")).startswith(F.concat(y, F.lit(" "))) | F.concat(y, F.lit(" ")).startswith(F.concat(x, F.lit(" "))))


def listed_suppliers(rows: DataFrame, suppliers: DataFrame, key: str = "ref", buyer_abn: str | None = None) -> DataFrame:
    """(key, tier, seq, row_no, value): entries of the master list found on a page, by business number (tier 0) or by a name
    or alias as a run of words (tier 1). Names meet rows in an equi-join on their first word; the whole run is then checked."""
    ready = rows.select(key, "row_no", row_text(F.col("cells")).alias("text"))
    digits = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")
    numbers = ready.select(key, "row_no", F.explode(find_abns(F.col("text"))).alias("abn")).withColumn("abn", digits(F.col("abn"))).where(F.col("abn") != F.lit(buyer_abn or ""))
    master = suppliers.select(F.col("supplier_id").alias("seq"), "name", digits(F.col("abn")).alias("abn"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    by_number = numbers.join(broadcast_if_small(master.where("abn <> ''").select("seq", "name", "abn")), "abn").select(key, F.lit(0).alias("tier"), "seq", "row_no", F.col("name").alias("value"))
    named = master.select("seq", F.col("name").alias("value"), F.explode(F.concat(F.array("name"), "aliases")).alias("n")).select("seq", "value", name_key(F.col("n")).alias("run")).where("run <> ''").distinct()
    named = named.withColumn("word", F.split("run", " ")[0])
    lines = ready.select(key, "row_no", name_key(F.col("text")).alias("line"))
    words = lines.select(key, "row_no", "line", F.explode(F.array_distinct(F.split("line", " "))).alias("word"))
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    by_name = words.join(broadcast_if_small(named), "word").where(F.contains(pad("line"), pad("run"))).select(key, F.lit(1).alias("tier"), "seq", "row_no", "value")
    return by_number.unionByName(by_name)


def infer_supplier(rows: DataFrame, labelled: DataFrame, suppliers: DataFrame | None, key: str = "ref", buyer_name: str | None = None, buyer_abn: str | None = None) -> DataFrame:
    """(key, value, evidence): the supplier by the first tier that gives one. ``labelled``: (key, value) of the label."""
    own = same_party(F.col("value"), F.lit(buyer_name or ""))
    tiers = [labelled.where(~own).select(key, F.lit(2).alias("tier"), F.lit(0).cast("bigint").alias("seq"), F.lit(0).alias("row_no"), "value")]
    if suppliers is not None:
        tiers.append(listed_suppliers(rows, suppliers, key, buyer_abn).select(key, "tier", F.col("seq").cast("bigint"), "row_no", "value"))
    # A letterhead's line stands alone in its row.
    alone = F.size(F.filter("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")) == 1
    top = rows.withColumn("value", F.when(alone, F.trim(row_text(F.col("cells")))).otherwise("")).where(F.trim(row_text(F.col("cells"))) != "").withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy("row_no")))
    tiers.append(top.where((F.col("__n") <= LETTERHEAD_ROWS) & company_like(F.col("value")) & ~own).select(key, F.lit(3).alias("tier"), F.lit(0).cast("bigint").alias("seq"), "row_no", "value"))
    out = tiers[0]
    for t in tiers[1:]:
        out = out.unionByName(t)
    best = out.groupBy(key).agg(F.min_by(F.struct("tier", "value"), F.struct("tier", "seq", "row_no", "value")).alias("b"))
    return best.select(key, "b.value", F.when(F.col("b.tier") <= 1, "master").when(F.col("b.tier") == 2, "label").otherwise("layout").alias("evidence"))


def extract(rows: DataFrame, suppliers: DataFrame | None = None, key: str = "ref", *, buyer_name: str | None = None, buyer_abn: str | None = None) -> Extraction:
    """Documents of ``rows`` (key, row_no, cells, perhaps xs)."""
    rows = cut(rows)
    flat = rows.where(F.trim(row_text(F.col("cells"))) != "").withColumn("row_no", F.row_number().over(W.partitionBy(key).orderBy("row_no")) - 1)
    # A cell that is a label and nothing else is no title, even where it has a title's words.
    unlabelled = F.transform("cells", lambda c: F.when(F.coalesce(fields.match_label(F.coalesce(c, F.lit("")), fields.known_labels())["rest"], F.lit("-")) != "", c))
    kinds = titles.classify(flat.select(key, "row_no", F.posexplode(unlabelled).alias("cell_no", "text")), key)
    documents = cut(kinds.select(key, "doc_type", "score", F.when(F.col("doc_type") == "unknown", "held").otherwise("read").alias("status")))
    known = rows.join(documents.where("status = 'read'").select(key, "doc_type"), key)
    tables = cut(fields.table_rows(known.drop("doc_type"), key))
    lines = fields.typed_lines(tables.join(documents.select(key, "doc_type"), key), key)
    values = cut(fields.label_values(known, key, tables=tables))
    labelled = values.where("field = 'supplier_name'").select(key, "value")
    supplier = infer_supplier(known.drop("doc_type"), labelled, suppliers, key, buyer_name, buyer_abn)
    typed = values.where("field <> 'supplier_name'").select(key, "field", "value", "printed", F.lit("label").alias("evidence"))
    printed = values.where("field = 'supplier_name'").select(key, "printed")
    named = supplier.join(printed, key, "left").select(key, F.lit("supplier_name").alias("field"), "value", F.coalesce("printed", "value").alias("printed"), "evidence")
    return Extraction(documents, typed.unionByName(named), lines)
