"""Queries of the general data problems over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerquarry.functions.ids import canonical_id, digit_runs
from ledgerquarry.functions.money import money_cents, number_cents
from ledgerquarry.operators import differences, orphans, shredding, timestamps
from ledgerquarry.runtime import cut, table


def _statement_side(df: DataFrame, row_id: str, amount, closing) -> DataFrame:
    entries = df.select("statement_no", canonical_id(F.col("reference")).alias("ref_key"), amount.alias("amount"), closing.alias("closing_balance"), "loaded_at", F.col(row_id).alias("row_id"))
    entries = entries.where("statement_no is not null and ref_key <> ''")
    return differences.latest_per_key(entries, ["statement_no", "ref_key"], [F.col("loaded_at"), F.col("row_id")], ["amount", "closing_balance"])


def statement_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _statement_side(table(spark, sf_dir, "stmt_ledger"), "entry_id", number_cents(F.col("amount")), number_cents(F.col("closing_balance")))
    read = _statement_side(table(spark, sf_dir, "stmt_read"), "row_id", money_cents(F.col("amount")), money_cents(F.col("closing_balance")))
    out = differences.compare_copies(ledger, read, ["statement_no", "ref_key"], ["amount", "closing_balance"])
    named = F.when(F.col("diff") == differences.LEFT_ONLY, "ledger_only").when(F.col("diff") == differences.RIGHT_ONLY, "read_only").otherwise(F.col("diff"))
    return out.select("statement_no", "ref_key", named.alias("diff"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement_differences(spark, sf_dir)


def p2_all_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every loaded version takes part, so keys hold several rows: identical ones cancel, the rest are paired."""
    side = lambda t, amount: table(spark, sf_dir, t).select("statement_no", canonical_id(F.col("reference")).alias("ref_key"), amount("amount").alias("amount"), amount("closing_balance").alias("closing_balance")).where("ref_key <> ''")
    left = side("stmt_ledger", lambda c: number_cents(F.col(c)))
    right = side("stmt_read", lambda c: money_cents(F.col(c)))
    return differences.compare_copies(left, right, ["statement_no", "ref_key"], ["amount", "closing_balance"])


def document_references(reads: DataFrame) -> DataFrame:
    """(read_id, field_name, ref_key, received_at): the order and invoice numbers a reading quotes, once each."""
    refs = F.concat(
        F.transform(digit_runs(F.col("po_reference"), 8), lambda x: F.struct(F.lit("po_reference").alias("field_name"), F.concat(F.lit("PO-"), x).alias("ref_key"))),
        F.transform(digit_runs(F.col("original_invoice"), 9), lambda x: F.struct(F.lit("original_invoice").alias("field_name"), x.alias("ref_key"))),
    )
    return reads.select("read_id", "received_at", F.explode(refs).alias("r")).select("read_id", "received_at", "r.field_name", "r.ref_key")


def invoice_numbers(reads: DataFrame) -> DataFrame:
    return reads.where("doc_type = 'supplier_invoice'").select("read_id", "received_at", F.explode(digit_runs(F.col("doc_number"), 9)).alias("ref_key"))


def orphan_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, orders = table(spark, sf_dir, "model_read"), table(spark, sf_dir, "po_line")
    refs = document_references(reads)
    orders_known = orphans.key_lifetimes(orders, F.col("po"), F.col("created_at"), F.col("deleted_at"))
    numbers = invoice_numbers(reads)
    invoices_known = orphans.key_lifetimes(numbers, F.col("ref_key"), F.col("received_at"))
    found = orphans.find_orphans(refs.where("field_name = 'po_reference'"), orders_known, "received_at").unionByName(
        orphans.find_orphans(refs.where("field_name = 'original_invoice'"), invoices_known, "received_at")
    )
    return found.withColumn("period", F.date_format("received_at", "yyyy-MM"))


def p3_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct orphans (depth 0, with field, key, reason and period) and readings orphaned through the invoice they quote."""
    reads = table(spark, sf_dir, "model_read")
    links = document_references(reads).where("field_name = 'original_invoice'").select(F.col("read_id").alias("node"), "ref_key")
    edges = links.join(invoice_numbers(reads).select("ref_key", F.col("read_id").alias("parent")), "ref_key").select("node", "parent")
    nodes = reads.select("read_id", F.date_format("received_at", "yyyy-MM").alias("period"))
    return orphans.orphan_report(orphan_references(spark, sf_dir), edges, nodes, "read_id", "original_invoice")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's direct level; TESTDATA.md's reasons name no inherited orphans, which p3_cascade adds."""
    return p3_cascade(spark, sf_dir).where("depth = 0").drop("depth")


def p3_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per referenced table and month, directly orphaned and inherited."""
    target = F.when(F.col("field_name") == "po_reference", "po_line").otherwise("model_read")
    kind = F.when(F.col("depth") == 0, F.col("reason")).otherwise(F.lit("inherited"))
    return p3_cascade(spark, sf_dir).groupBy(target.alias("target"), "period", kind.alias("kind")).agg(F.count("*").alias("n_refs"), F.count_distinct("read_id").alias("n_reads"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shredding.flatten_records(table(spark, sf_dir, "raw_record"))


def p4_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many children each level has, through the parent links."""
    nodes = shredding.parent_links(p4_found(spark, sf_dir))
    return nodes.groupBy("node_kind", "parent_kind").agg(F.count("*").alias("n_nodes"), F.count_distinct("rec_id", "parent_path").alias("n_parents"))


def p4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of lines with all leaves, each with its document's number and type through the parent link."""
    wanted = {"document": {"doc_number": "doc_number", "doc_type": "doc_type"}, "line": {x: x for x in ("sku", "description", "quantity", "unit", "unit_price", "amount")}}
    nodes = cut(shredding.parent_links(shredding.shred_records(table(spark, sf_dir, "raw_record"), wanted)))
    documents = nodes.where("node_kind = 'document'").select("rec_id", F.col("node_path").alias("parent_path"), "doc_number", "doc_type")
    lines = nodes.where("node_kind = 'line'").select("rec_id", "node_path", "parent_path", "sku", "description", "quantity", "unit", "unit_price", "amount")
    return lines.join(documents, ["rec_id", "parent_path"])


def p4_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of lots with their quantities, four levels down, each with its parent's path."""
    return shredding.node_table(table(spark, sf_dir, "raw_record"), "lot")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the dictionary kept in the shared folder: a second run parses only what is new."""
    return timestamps.normalise(table(spark, sf_dir, "model_read"), "read_id", ["date", "due_date", "delivery_date"], "origin_zone", timestamps.dictionary_folder(spark))


QUERIES = {f.__name__: f for f in (p2_found, p2_all_versions, p3_found, p3_cascade, p3_by_period, p4_found, p4_children, p4_lines, p4_lots, p5_found)}

_CENTS_TEXT = """
CASE WHEN regexp_matches({c}, '[0-9]') THEN
  (CASE WHEN contains({c}, '(') OR contains({c}, '-') OR regexp_matches(upper({c}), '(^|[^A-Z])CR([^A-Z]|$)') THEN -1 ELSE 1 END)
  * CAST(regexp_replace({c}, '[^0-9]', '', 'g') AS BIGINT) END"""
_REF_KEY = "regexp_replace(upper(reference), '[^A-Z0-9]', '', 'g')"

_P2 = f"""
WITH l AS (
  SELECT statement_no, {_REF_KEY} AS ref_key, CAST(round(amount * 100) AS BIGINT) AS amount, CAST(round(closing_balance * 100) AS BIGINT) AS closing,
         row_number() OVER (PARTITION BY statement_no, {_REF_KEY} ORDER BY loaded_at DESC, entry_id DESC) AS rn
  FROM stmt_ledger WHERE {_REF_KEY} <> ''),
r AS (
  SELECT statement_no, {_REF_KEY} AS ref_key, {_CENTS_TEXT.format(c="amount")} AS amount, {_CENTS_TEXT.format(c="closing_balance")} AS closing,
         row_number() OVER (PARTITION BY statement_no, {_REF_KEY} ORDER BY loaded_at DESC, row_id DESC) AS rn
  FROM stmt_read WHERE {_REF_KEY} <> ''),
j AS (
  SELECT coalesce(a.statement_no, b.statement_no) AS statement_no, coalesce(a.ref_key, b.ref_key) AS ref_key,
         a.statement_no IS NULL AS no_l, b.statement_no IS NULL AS no_r, a.amount AS la, b.amount AS ra, a.closing AS lc, b.closing AS rc
  FROM (SELECT * FROM l WHERE rn = 1) a FULL JOIN (SELECT * FROM r WHERE rn = 1) b ON a.statement_no = b.statement_no AND a.ref_key = b.ref_key)
SELECT statement_no, ref_key, 'ledger_only' AS diff FROM j WHERE no_r
UNION ALL SELECT statement_no, ref_key, 'read_only' FROM j WHERE no_l
UNION ALL SELECT statement_no, ref_key, 'amount' FROM j WHERE NOT no_l AND NOT no_r AND la IS DISTINCT FROM ra
UNION ALL SELECT statement_no, ref_key, 'closing_balance' FROM j WHERE NOT no_l AND NOT no_r AND lc IS DISTINCT FROM rc
"""


def _runs(c: str, n: int) -> str:
    doubled = rf"regexp_replace(coalesce({c}, ''), '([^0-9\s])', '\1\1', 'g')"
    found = rf"regexp_extract_all({doubled}, '(^|[^0-9])([0-9](?:\s?[0-9]){{{n - 1}}})($|[^0-9])', 2)"
    return rf"list_distinct(list_transform({found}, lambda x: regexp_replace(x, '\s', '', 'g')))"


_P3 = f"""
WITH refs AS (
  SELECT read_id, received_at, 'po_reference' AS field_name, 'PO-' || unnest({_runs("po_reference", 8)}) AS ref_key FROM model_read
  UNION ALL
  SELECT read_id, received_at, 'original_invoice', unnest({_runs("original_invoice", 9)}) FROM model_read),
orders_known AS (
  SELECT po AS ref_key, min(created_at) AS first_seen, CASE WHEN count(*) = count(deleted_at) THEN max(deleted_at) END AS gone FROM po_line WHERE po IS NOT NULL GROUP BY po),
inv AS (SELECT unnest({_runs("doc_number", 9)}) AS ref_key, received_at FROM model_read WHERE doc_type = 'supplier_invoice'),
known AS (
  SELECT 'po_reference' AS field_name, ref_key, first_seen, gone FROM orders_known
  UNION ALL SELECT 'original_invoice', ref_key, min(received_at), CAST(NULL AS TIMESTAMPTZ) FROM inv GROUP BY ref_key),
judged AS (
  SELECT r.*, CASE WHEN k.ref_key IS NULL THEN 'missing' WHEN k.first_seen > r.received_at THEN 'late' WHEN k.gone <= r.received_at THEN 'deleted' END AS reason
  FROM refs r LEFT JOIN known k ON r.field_name = k.field_name AND r.ref_key = k.ref_key)
SELECT read_id, field_name, ref_key, reason, strftime(received_at AT TIME ZONE 'UTC', '%Y-%m') AS period FROM judged WHERE reason IS NOT NULL
"""

_CASCADE = f"""
WITH RECURSIVE direct AS ({_P3}),
inv AS (SELECT unnest({_runs("doc_number", 9)}) AS ref_key, read_id AS parent FROM model_read WHERE doc_type = 'supplier_invoice'),
edges AS (SELECT DISTINCT r.read_id AS node, inv.parent FROM (SELECT read_id, unnest({_runs("original_invoice", 9)}) AS ref_key FROM model_read) r JOIN inv USING (ref_key)),
walk AS (SELECT DISTINCT read_id AS node, 0 AS depth FROM direct UNION SELECT e.node, w.depth + 1 FROM walk w JOIN edges e ON e.parent = w.node WHERE w.depth < (SELECT count(*) FROM edges)),
least AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)
SELECT read_id, field_name, ref_key, reason, period, 0 AS depth FROM direct
UNION ALL SELECT l.node, 'original_invoice', '', 'inherited', strftime(m.received_at AT TIME ZONE 'UTC', '%Y-%m'), l.depth FROM least l JOIN model_read m ON m.read_id = l.node WHERE l.depth > 0
"""
_BY_PERIOD = f"""
SELECT CASE field_name WHEN 'po_reference' THEN 'po_line' ELSE 'model_read' END AS target, period, CASE WHEN depth = 0 THEN reason ELSE 'inherited' END AS kind, count(*) AS n_refs, count(DISTINCT read_id) AS n_reads
FROM ({_CASCADE}) GROUP BY ALL
"""

# Nested records: JSON by its functions, XML by the text between tags.
def _open(x: str) -> str:
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x} ->> '$') THEN CAST({x} ->> '$' AS JSON) ELSE {x} END"


def _list(x: str) -> str:
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN CAST({x} AS JSON[]) WHEN 'OBJECT' THEN [{x}] ELSE [] END"


def _json_level(name: str, source: str, inner: str, path: str) -> str:
    """CTEs: the elements of one level, with their paths; texts of JSON are opened, what is no object gives no row."""
    return f"""
{name}0 AS (SELECT rec_id, {path} AS above, {_open(_open(inner))} AS v FROM {source}),
{name}1 AS (SELECT rec_id, above, {_list("v")} AS items FROM {name}0),
{name}2 AS (SELECT rec_id, above, unnest(items) AS v, generate_subscripts(items, 1) AS i FROM {name}1),
{name} AS (SELECT rec_id, CASE WHEN above = '' THEN '' ELSE above || '.' END || i AS path, e FROM (SELECT rec_id, above, i, {_open(_open("v"))} AS e FROM {name}2) WHERE json_type(e) = 'OBJECT')"""


def _tag(names: str) -> str:
    return rf"<(?:[A-Za-z0-9_]+:)?(?:{names})(?:\s[^>]*)?>.*?</(?:[A-Za-z0-9_]+:)?(?:{names})>"


def _inner(x: str, *tags: str) -> str:
    """Text of the first element along the tags, marked sections and entities opened; null if none."""
    pattern = r"\s*".join(rf"<(?:[A-Za-z0-9_]+:)?{t}(?:\s[^>]*)?>" for t in tags) + r"\s*(?:<!\[CDATA\[)?\s*([^<\]]*)(?:\]\]>)?\s*<"
    return f"nullif(trim(replace(replace(replace(regexp_extract({x}, '{pattern}', 1, 's'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), '')"


def _xml_level(name: str, source: str, tags: str, path: str) -> str:
    found = f"regexp_extract_all(e, '{_tag(tags)}', 0, 's')"
    return f"""
{name}1 AS (SELECT rec_id, {path} AS above, {found} AS items FROM {source}),
{name} AS (SELECT rec_id, above || '.' || i AS path, e FROM (SELECT rec_id, above, unnest(items) AS e, generate_subscripts(items, 1) AS i FROM {name}1))"""


_WHOLE_UBL = r"regexp_matches(payload, '^[\s\x{FEFF}]*(<\?[^>]*\?>\s*)?<(?:[A-Za-z0-9_]+:)?(Invoice|CreditNote)[\s>]') AND regexp_matches(payload, '</(?:[A-Za-z0-9_]+:)?(Invoice|CreditNote)\s*>\s*$')"
_LEVELS = (
    "WITH j AS (SELECT rec_id, CAST(payload AS JSON) AS p FROM raw_record WHERE fmt = 'json' AND json_valid(payload)),"
    + f"\nroot AS (SELECT rec_id, {_open(_open('p'))} AS e FROM j),"
    + _json_level("jd", "root", "CASE WHEN json_type(e) = 'OBJECT' AND json_exists(e, '$.documents') THEN e -> 'documents' ELSE e END", "''") + ","
    + _json_level("jl", "jd", "e -> 'lines'", "path") + "," + _json_level("jv", "jl", "e -> 'deliveries'", "path") + "," + _json_level("jt", "jv", "e -> 'lots'", "path")
    + f",\nxd AS (SELECT rec_id, '1' AS path, payload AS e FROM raw_record WHERE fmt = 'ubl_xml' AND {_WHOLE_UBL}),"
    + _xml_level("xl", "xd", "InvoiceLine|CreditNoteLine", "path") + "," + _xml_level("xv", "xl", "Delivery", "path") + "," + _xml_level("xt", "xv", "GoodsItem", "path")
)
_FIRST_ID = r"nullif(regexp_extract(e, '^<[^>]*>\s*<(?:[A-Za-z0-9_]+:)?ID>\s*([^<]*?)\s*<', 1, 's'), '')"
_LOT = _inner("e", "LotNumberID")
_P4 = f"""{_LEVELS}
SELECT rec_id, 'line' AS node_kind, path AS node_path, coalesce(e ->> 'sku', '') AS node_key FROM jl
UNION ALL SELECT rec_id, 'delivery', path, coalesce(e ->> 'docket', '') FROM jv
UNION ALL SELECT rec_id, 'lot', path, coalesce(e ->> 'heat', '') FROM jt
UNION ALL SELECT rec_id, 'line', path, coalesce({_inner("e", "SellersItemIdentification", "ID")}, '') FROM xl
UNION ALL SELECT rec_id, 'delivery', path, coalesce({_FIRST_ID}, '') FROM xv
UNION ALL SELECT rec_id, 'lot', path, coalesce({_LOT}, '') FROM xt"""
_P4_CHILDREN = f"SELECT node_kind, CASE node_kind WHEN 'line' THEN 'document' WHEN 'delivery' THEN 'line' ELSE 'delivery' END AS parent_kind, count(*) AS n_nodes, count(DISTINCT (rec_id, regexp_replace(node_path, '\\.[0-9]+$', ''))) AS n_parents FROM ({_P4}) GROUP BY 1, 2"
_P4_LOTS = f"""{_LEVELS}
SELECT rec_id, path AS node_path, regexp_replace(path, '\\.[0-9]+$', '') AS parent_path, nullif(e ->> 'heat', '') AS heat, nullif(e ->> 'qty', '') AS qty FROM jt
UNION ALL SELECT rec_id, path, regexp_replace(path, '\\.[0-9]+$', ''), {_LOT}, {_inner("e", "Quantity")} FROM xt"""
_UNIT = r"""nullif(regexp_extract(e, '<(?:[A-Za-z0-9_]+:)?(?:Invoiced|Credited)Quantity\s[^>]*unitCode="([^"]*)"', 1), '')"""
_P4_LINES = f"""{_LEVELS},
d AS (
  SELECT rec_id, path AS parent_path, nullif(e -> 'fields' ->> 'doc_number', '') AS doc_number, nullif(e ->> 'doc_type', '') AS doc_type FROM jd
  UNION ALL SELECT rec_id, path, {_inner("e", "ID")}, CASE WHEN regexp_matches(e, '<(?:[A-Za-z0-9_]+:)?CreditNote[\\s>]') THEN 'CreditNote' ELSE 'Invoice' END FROM xd),
l AS (
  SELECT rec_id, path AS node_path, {", ".join(f"nullif(e ->> '{c}', '') AS {c}" for c in ("sku", "description", "quantity", "unit", "unit_price", "amount"))} FROM jl
  UNION ALL SELECT rec_id, path, {_inner("e", "SellersItemIdentification", "ID")}, {_inner("e", "Name")}, {_inner("e", "(?:Invoiced|Credited)Quantity")}, {_UNIT}, {_inner("e", "PriceAmount")}, {_inner("e", "LineExtensionAmount")} FROM xl)
SELECT l.*, d.parent_path, d.doc_number, d.doc_type FROM l JOIN d ON l.rec_id = d.rec_id AND d.parent_path = regexp_replace(l.node_path, '\\.[0-9]+$', '')"""

_PAYABLE, _INCLUSIVE = _inner("e", "PayableAmount"), _inner("e", "TaxInclusiveAmount")


def _part(tag: str) -> str:
    return f"regexp_extract(e, '{_tag(tag)}', 0, 's')"


_UBL_DOCUMENTS = f"WITH xd AS (SELECT rec_id, '1' AS path, payload AS e FROM raw_record WHERE {_WHOLE_UBL})"
_UBL_HEADERS = f"""{_UBL_DOCUMENTS}
SELECT rec_id, CASE WHEN regexp_matches(e, '<(?:[A-Za-z0-9_]+:)?CreditNote[\\s>]') THEN 'credit_note' ELSE 'supplier_invoice' END AS doc_type, {_inner("e", "ID")} AS doc_number, {_inner("e", "IssueDate")} AS date, {_inner("e", "DueDate")} AS due_date,
  {_inner("e", "OrderReference", "ID")} AS po_reference, {_inner(_part("BillingReference"), "ID")} AS original_invoice, {_inner(_part("AccountingSupplierParty"), "RegistrationName")} AS supplier_name, {_inner(_part("AccountingSupplierParty"), "CompanyID")} AS supplier_abn,
  {_inner(_part("AccountingCustomerParty"), "RegistrationName")} AS buyer_name, {_inner(_part("LegalMonetaryTotal"), "LineExtensionAmount")} AS subtotal, {_inner(_part("TaxTotal"), "TaxAmount")} AS gst,
  CASE WHEN coalesce(TRY_CAST({_PAYABLE} AS DOUBLE), 0) <> 0 THEN {_PAYABLE} ELSE {_INCLUSIVE} END AS total
FROM xd"""
_UBL_LINES = f"""{_UBL_DOCUMENTS},{_xml_level("xl", "xd", "InvoiceLine|CreditNoteLine", "path")}
SELECT rec_id, CAST(string_split(path, '.')[2] AS INTEGER) AS line_no, {_inner("e", "SellersItemIdentification", "ID")} AS sku, {_inner("e", "Name")} AS description, {_inner("e", "(?:Invoiced|Credited)Quantity")} AS quantity, {_inner("e", "PriceAmount")} AS unit_price, {_inner("e", "LineExtensionAmount")} AS amount
FROM xl"""

SQL = {
    "p2_found": _P2, "p3_found": _P3, "p3_cascade": _CASCADE, "p3_by_period": _BY_PERIOD, "p4_found": _P4, "p4_children": _P4_CHILDREN, "p4_lots": _P4_LOTS, "p4_lines": _P4_LINES,
    "ubl_headers": _UBL_HEADERS, "ubl_lines": _UBL_LINES,
}
