"""Queries of the training-data problems over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerquarry.llm import canonical, leaks, linkage, packing, subjects, survivors
from ledgerquarry.runtime import table


def invoice_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.link_invoices(*[table(spark, sf_dir, t) for t in ("model_read", "model_line", "po_line", "suppliers")])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invoice_orders(spark, sf_dir).select("read_id", "po")


def supplier_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.map_names(table(spark, sf_dir, "model_read"), "read_id", "supplier_name", table(spark, sf_dir, "suppliers"), "supplier_id", "name", "aliases")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_mapping(spark, sf_dir).select("read_id", F.col("entry_id").alias("supplier_id"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.surviving_readings(table(spark, sf_dir, "model_read"), table(spark, sf_dir, "field_value")).select("doc_type", "number_key", "field_name", "read_id")


def p7_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.fused_readings(table(spark, sf_dir, "model_read"), table(spark, sf_dir, "field_value"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p8_packed(spark, sf_dir))


def document_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.assign_subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_seed"), table(spark, sf_dir, "subject_area"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_subjects(spark, sf_dir).select("doc_id", "subject")


QUERIES = {f.__name__: f for f in (p1_found, p6_found, p7_found, p7_fused, p8_packed, p8_fill, p9_found, p10_found)}
_NUMBER = r"list_extract(regexp_extract_all(regexp_replace(coalesce(doc_number, ''), '([^0-9\s])', '\1\1', 'g'), '(^|[^0-9])([0-9](?:\s?[0-9]){8})($|[^0-9])', 2), 1)"
_P7 = f"""
WITH k AS (
  SELECT read_id, doc_type, status, received_at, regexp_replace({_NUMBER}, '\\s', '', 'g') AS number_key FROM model_read),
g AS (
  SELECT k.* FROM k JOIN (SELECT doc_type, number_key FROM k WHERE number_key IS NOT NULL GROUP BY ALL HAVING count(DISTINCT read_id) > 1) s USING (doc_type, number_key)),
c AS (
  SELECT g.doc_type, g.number_key, v.field_name, g.read_id,
         row_number() OVER (PARTITION BY g.doc_type, g.number_key, v.field_name ORDER BY
           CASE g.status WHEN 'read' THEN 0 WHEN 'flagged' THEN 1 WHEN 'held' THEN 2 ELSE 3 END,
           CASE coalesce(nullif(trim(v.evidence), ''), 'none') WHEN 'master' THEN 0 WHEN 'structure' THEN 1 WHEN 'label' THEN 2 WHEN 'layout' THEN 3 WHEN 'model' THEN 4 WHEN 'none' THEN 5 ELSE 6 END,
           coalesce(v.confidence, -1) DESC, g.received_at DESC, g.read_id) AS rn
  FROM g JOIN field_value v ON v.read_id = g.read_id
  WHERE trim(coalesce(v.value, '')) <> '' AND g.status IS DISTINCT FROM 'duplicate')
SELECT doc_type, number_key, field_name, read_id FROM c WHERE rn = 1
"""

_WIDE = "".join(chr(c + 0xFEE0) for c in [*range(48, 58), *range(65, 91), *range(97, 123)])
_PLAIN = "".join(chr(c) for c in [*range(48, 58), *range(65, 91), *range(97, 123)])


def _letters_and_digits(c: str) -> str:
    """Compatibility forms that occur in the tables (wide letters, two ligatures, sharp s) folded, case ignored."""
    return f"regexp_replace(lower(translate(replace(replace(replace({c}, 'ß', 'ss'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '{_WIDE}', '{_PLAIN}')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


_P9 = f"""
WITH i AS (SELECT item_id, list_transform(regexp_split_to_array(trim(text), '\\s+'), lambda w: {_letters_and_digits("w")}) AS w FROM eval_item WHERE text IS NOT NULL),
s AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], '') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 1))) AS k FROM i)),
d AS (SELECT doc_id, {_letters_and_digits("text")} AS t FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT doc_id, item_id FROM d JOIN s ON contains(d.t, s.s) WHERE s.s <> ''
"""

SQL = {"p7_found": _P7, "p9_found": _P9}
