"""Queries of the paperwork operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerquarry.functions import text as T
from ledgerquarry.functions.ids import canonical_id, digit_runs
from ledgerquarry.functions.money import money_cents
from ledgerquarry.operators import copies, registers, segments, titles
from ledgerquarry.sources import grids, sinks, ubl
from ledgerquarry.runtime import table

# ---- the paperwork projection of lineitem and orders: one row per line and kind ------------------------------------------
KEYS = ["po", "line_no"]


def order_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(po, line_no, ordered_m, amt_c, received_m, invoiced_m, credited_m): one pass over the lines with conditional sums,
    combined before the one shuffle."""
    qty, amt = F.round(F.col("l_quantity") * 1000).cast("bigint"), F.round(F.col("l_extendedprice") * 100).cast("bigint")
    received, invoiced = F.col("l_linestatus") == "F", F.col("l_returnflag").isin("A", "R")
    credited = (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.05)
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)  # noqa: E731
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("po"), F.col("l_linenumber").cast("int").alias("line_no")).agg(
        total(qty, "ordered_m"), total(amt, "amt_c"), total(F.when(received, qty), "received_m"), total(F.when(invoiced, qty), "invoiced_m"), total(F.when(credited, qty), "credited_m")
    )


def goods_owed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.outstanding(order_chains(spark, sf_dir), KEYS, F.col("ordered_m"), F.col("received_m"))


def paperwork_owed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.outstanding(order_chains(spark, sf_dir), KEYS, F.col("received_m"), F.col("invoiced_m") - F.col("credited_m"))


def invoiced_not_received(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.outstanding(order_chains(spark, sf_dir), KEYS, F.col("invoiced_m") - F.col("credited_m"), F.col("received_m"))


def money_owed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice totals less credits and payments, one row per order with something left."""
    amt = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    invoiced, credited = F.col("l_returnflag").isin("A", "R"), (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.05)
    cents = lambda c: F.coalesce(F.sum(F.when(c, amt)), F.lit(0)).cast("bigint")  # noqa: E731
    billed = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("po")).agg(cents(invoiced).alias("invoiced_c"), cents(credited).alias("credited_c")).where("invoiced_c > 0")
    status = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("po"), "o_orderstatus")
    paid = F.when(F.col("o_orderstatus") == "F", F.col("invoiced_c")).when(F.col("o_orderstatus") == "P", F.expr("invoiced_c div 2")).otherwise(F.lit(0)).cast("bigint")
    out = billed.join(status, "po", "left").withColumn("paid_c", paid).withColumn("open_c", F.col("invoiced_c") - F.col("credited_c") - F.col("paid_c"))
    return out.where("open_c > 0").select("po", "invoiced_c", "credited_c", "paid_c", "open_c")


REGISTERS = {"goods_owed": ("ordered_m", "received_m"), "paperwork_owed": ("received_m", "invoiced_m - credited_m"), "invoiced_not_received": ("invoiced_m - credited_m", "received_m")}


def register_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and quantity of each register, in fixed order: one aggregation over the chains, then one row per register."""
    sums = [F.struct(F.count_if(F.expr(f"{a} > {b}")).alias("n"), F.sum(F.when(F.expr(f"{a} > {b}"), F.expr(f"{a} - ({b})"))).cast("bigint").alias("open_m")).alias(k) for k, (a, b) in REGISTERS.items()]
    one = order_chains(spark, sf_dir).agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("register"), F.col(k)["n"].alias("n"), F.col(k)["open_m"].alias("open_m")) for i, k in enumerate(REGISTERS)]))
    return one.select(rows.alias("r")).select("r.*")


def register_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines that are still open against those that are not billed, as a full outer join of keys."""
    chains = order_chains(spark, sf_dir)
    return registers.recall_precision(chains.where("invoiced_m < ordered_m"), chains.where("received_m < ordered_m"), KEYS)


def largest_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten orders with most money open: a top-k report."""
    return money_owed(spark, sf_dir).orderBy(F.desc("open_c"), "po").limit(10)


# ---- lines, keys and scores ---------------------------------------------------------------------------------------------
def stated_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a reading that quotes an order, with the order line it fits best (0.6 or more, first on ties)."""
    reads = table(spark, sf_dir, "model_read").select("read_id", F.explode(digit_runs(F.col("po_reference"), 8)).alias("n")).select("read_id", F.concat(F.lit("PO-"), "n").alias("po"))
    lines = table(spark, sf_dir, "model_line").select("read_id", "line_no", "sku", "description").distinct()
    orders = table(spark, sf_dir, "po_line").select("po", F.col("line_no").alias("po_line_no"), F.col("sku").alias("po_sku"), F.col("description").alias("po_description")).distinct()
    pairs = lines.join(reads, "read_id").join(orders, "po").withColumn("score", F.round(T.line_match(F.col("sku"), F.col("description"), F.col("po_sku"), F.col("po_description")), 6))
    best = pairs.where("score >= 0.6").groupBy("read_id", "line_no", "po").agg(F.min_by(F.struct("po_line_no", "score"), F.struct(-F.col("score"), "po_line_no")).alias("b"))
    return best.select("read_id", "line_no", "po", "b.po_line_no", "b.score")


def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "model_read")
    return r.select("read_id", canonical_id(F.coalesce("doc_number", F.lit(""))).alias("number_id"), T.name_key(F.col("supplier_name")).alias("name_key"), T.supplier_key(F.col("supplier_name"), F.col("supplier_abn")).alias("supplier_key"), T.abn_valid(F.col("supplier_abn")).alias("abn_ok"))


def parsed_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "model_read")
    return r.select("read_id", *[money_cents(F.col(c)).alias(f"{c}_c") for c in ("subtotal", "gst", "total", "opening_balance", "closing_balance")])


def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "model_line").select("read_id", "line_no", "quantity").distinct()
    return rows.select("read_id", "line_no", "quantity", T.parse_number(F.col("quantity")).cast("double").alias("quantity_n"))


def printed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day printed on every reading, in any form ``parse_day`` reads; null where there is none."""
    return table(spark, sf_dir, "model_read").select("read_id", T.parse_day(F.col("date")).cast("string").alias("day"))


def date_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "model_read")
    return r.select("read_id", T.order_evidence(F.concat_ws(" ", "date", "due_date", "delivery_date")).alias("proof"))


def total_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per reading with lines: line amounts against subtotal, and subtotal with tax against total, in cents."""
    reads = table(spark, sf_dir, "model_read").select("read_id", money_cents(F.col("subtotal")).alias("sub_c"), money_cents(F.col("gst")).alias("gst_c"), money_cents(F.col("total")).alias("tot_c"))
    sums = table(spark, sf_dir, "model_line").select("read_id", "line_no", "description", money_cents(F.col("amount")).alias("c")).distinct().groupBy("read_id").agg(F.sum("c").cast("bigint").alias("lines_c"))
    ok = lambda a, b: (F.abs(a - b) <= 1)  # noqa: E731
    return reads.join(sums, "read_id").select("read_id", "lines_c", ok(F.col("lines_c"), F.col("sub_c")).alias("lines_ok"), ok(F.col("sub_c") + F.col("gst_c"), F.col("tot_c")).alias("total_ok"))


# ---- copies, statements, pages, titles, texts -----------------------------------------------------------------------------
def text_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the first document of the same text, and whether it is a copy."""
    marked = copies.mark_copies(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), F.col("doc_id"))
    return marked.select("doc_id", "first_seen", (F.col("first_seen") < F.col("doc_id")).alias("is_copy"))


def repeated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read more than once: type and canonical number, the first reading and how many there are."""
    r = table(spark, sf_dir, "model_read").withColumn("number_id", canonical_id(F.col("doc_number")))
    out = copies.canonical_documents(r, [F.col("doc_type"), F.col("number_id")], "read_id", "ref")
    return out.where("copies > 1").select(F.col("key_0").alias("doc_type"), F.col("key_1").alias("number_id"), "first_id", "copies", "first_ref")


def _entries(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name).select("statement_no", canonical_id(F.col("reference")).alias("ref_key")).where("ref_key <> ''").distinct()


def statement_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.statement_matches(_entries(spark, sf_dir, "stmt_read"), _entries(spark, sf_dir, "stmt_ledger"), ["statement_no", "ref_key"], "left_anti")


def statement_agreed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.statement_matches(_entries(spark, sf_dir, "stmt_read"), _entries(spark, sf_dir, "stmt_ledger"), ["statement_no", "ref_key"], "left_semi")


def statement_not_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.statement_matches(_entries(spark, sf_dir, "stmt_ledger"), _entries(spark, sf_dir, "stmt_read"), ["statement_no", "ref_key"], "left_anti")


def page_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of each file as pages, grouped into documents by type and number."""
    r = table(spark, sf_dir, "model_read")
    none = F.lit(None)
    pages = r.select(
        "read_id", "ref", "page", "doc_type", F.lit(1.0).alias("title_strength"), F.coalesce("doc_number", F.lit("")).alias("number"),
        none.cast("int").alias("page_n"), none.cast("int").alias("page_m"), none.cast("boolean").alias("continued"), none.cast("boolean").alias("continues"),
    )  # fmt: skip
    return segments.group_pages(pages, tie="read_id").select("read_id", "ref", "page", "segment")


def title_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "model_read")
    return r.select("read_id", titles.title_type(F.col("printed_title")).alias("title_type"))


def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type each document text calls itself, by all its rows."""
    cells = grids.text_cells(table(spark, sf_dir, "documents"), "doc_id", "text").where(F.size("cells") > 0)
    # Rows are counted without the blank ones; a text's rows are sorted within the text.
    rows = cells.withColumn("row_no", F.row_number().over(W.partitionBy("doc_id").orderBy("row_no")) - 1)
    flat = rows.select(F.col("doc_id"), "row_no", F.posexplode("cells").alias("cell_no", "text"))
    return titles.classify(flat, "doc_id").select("doc_id", "doc_type", "score")


def text_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and cells of each text."""
    cells = grids.text_cells(table(spark, sf_dir, "documents"), "doc_id", "text")
    return cells.groupBy("doc_id").agg(F.count_if(F.size("cells") > 0).alias("n_rows"), F.sum(F.size("cells")).cast("bigint").alias("n_cells"))


def digit_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters, digits and mean length of texts by source."""
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("source"), F.length("text").alias("n"), F.length(F.regexp_replace("text", "[^0-9]", "")).alias("d"))
    return d.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").cast("bigint").alias("n_chars"), F.sum("d").cast("bigint").alias("n_digits"))


def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field values by source and band of the confidence that their signals give."""
    f = table(spark, sf_dir, "field_value").distinct()
    score = T.signal_confidence(F.col("confidence"), F.col("grounded"), F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), F.lit(0.8))
    return f.groupBy("source", T.band(score).alias("band")).agg(F.count("*").alias("n"))


def score_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values stand as printed: in all, by field, by source."""
    f = table(spark, sf_dir, "field_value").where("value <> ''").select("field_name", "source", (F.regexp_replace(F.lower("value"), "[^a-z0-9]", "") == F.regexp_replace(F.lower(F.coalesce("printed", F.lit(""))), "[^a-z0-9]", "")).alias("same"))
    out = f.groupingSets([[], [F.col("field_name")], [F.col("source")]], F.col("field_name"), F.col("source"))
    return out.agg(F.count_if("same").alias("n_right"), F.count("*").alias("n_all"))


def field_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.field_documents(table(spark, sf_dir, "field_value"))


def ubl_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header fields of the payloads that are whole UBL documents."""
    return ubl.read_headers(table(spark, sf_dir, "raw_record").select("rec_id", "payload"))


def ubl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ubl.read_lines(table(spark, sf_dir, "raw_record").select("rec_id", "payload"), "rec_id")


QUERIES = {
    f.__name__: f
    for f in (
        goods_owed, paperwork_owed, invoiced_not_received, money_owed, register_totals, register_recall, largest_open, stated_order_lines, canonical_keys, parsed_money, parsed_numbers,
        printed_days, date_order, total_checks, text_copies, repeated_documents, statement_missing, statement_agreed, statement_not_listed, page_groups, title_types, document_titles,
        text_shapes, digit_share, confidence_bands, score_tallies, field_json, ubl_headers, ubl_lines,
    )
}  # fmt: skip

_CHAIN = """
WITH c AS (
  SELECT l_orderkey AS po, CAST(l_linenumber AS INTEGER) AS line_no,
         CAST(sum(q) AS BIGINT) AS ordered_m, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS amt_c,
         CAST(coalesce(sum(q) FILTER (l_linestatus = 'F'), 0) AS BIGINT) AS received_m,
         CAST(coalesce(sum(q) FILTER (l_returnflag IN ('A', 'R')), 0) AS BIGINT) AS invoiced_m,
         CAST(coalesce(sum(q) FILTER (l_returnflag = 'R' AND l_discount >= 0.05), 0) AS BIGINT) AS credited_m
  FROM (SELECT *, CAST(round(l_quantity * 1000) AS BIGINT) AS q FROM lineitem) GROUP BY ALL)
"""


def _open(a: str, b: str) -> str:
    return f"SELECT po, line_no, CAST({a} AS BIGINT) AS left_m, CAST({b} AS BIGINT) AS right_m, CAST(({a}) - ({b}) AS BIGINT) AS open_m, CAST(CASE WHEN ordered_m > 0 THEN (amt_c::HUGEINT * (({a}) - ({b}))) // ordered_m END AS BIGINT) AS value_c FROM c WHERE ({a}) > ({b})"


_REGISTERS = REGISTERS
_MONEY = """
WITH b AS (
  SELECT l_orderkey AS po, CAST(coalesce(sum(a) FILTER (l_returnflag IN ('A', 'R')), 0) AS BIGINT) AS invoiced_c,
         CAST(coalesce(sum(a) FILTER (l_returnflag = 'R' AND l_discount >= 0.05), 0) AS BIGINT) AS credited_c
  FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS a FROM lineitem) GROUP BY l_orderkey),
p AS (
  SELECT b.*, CAST(CASE o_orderstatus WHEN 'F' THEN invoiced_c WHEN 'P' THEN invoiced_c // 2 ELSE 0 END AS BIGINT) AS paid_c
  FROM b LEFT JOIN orders ON o_orderkey = po WHERE invoiced_c > 0)
SELECT po, invoiced_c, credited_c, paid_c, CAST(invoiced_c - credited_c - paid_c AS BIGINT) AS open_c FROM p WHERE invoiced_c - credited_c - paid_c > 0
"""


def _cents(c: str) -> str:
    figures = f"rtrim(regexp_replace(coalesce({c}, ''), '[^0-9.,]', '', 'g'), '.,')"
    padded = f"CASE WHEN regexp_matches({figures}, '[.,][0-9][0-9]$') THEN '' WHEN regexp_matches({figures}, '[.,][0-9]$') THEN '0' ELSE '00' END"
    sign = f"CASE WHEN regexp_matches({c}, '^[^0-9]*[(-]') OR regexp_matches({c}, '-[^0-9]*$') OR regexp_matches(upper({c}), '(^|[^A-Z])CR([^A-Z]|$)') THEN -1 ELSE 1 END"
    return f"CASE WHEN regexp_matches({c}, '[0-9]') THEN {sign} * TRY_CAST(regexp_replace({figures}, '[.,]', '', 'g') || {padded} AS BIGINT) END"


_LEGAL_LIST = "['ag', 'bv', 'co', 'corp', 'corporation', 'gmbh', 'inc', 'incorporated', 'kg', 'limited', 'llc', 'lp', 'ltd', 'nv', 'plc', 'proprietary', 'pty', 'pvt', 'sa', 'sarl', 'sas']"


def name_key_sql(c: str) -> str:
    words = f"regexp_extract_all(translate(lower(coalesce({c}, '')), 'áàâäãåéèêëíìîïóòôöõúùûüçñ', 'aaaaaaeeeeiiiiooooouuuucn'), '[a-z0-9]+')"
    kept = f"list_filter({words}, lambda w: NOT list_contains({_LEGAL_LIST}, w))"
    return f"array_to_string(CASE WHEN len({kept}) > 0 THEN {kept} ELSE {words} END, ' ')"


_NAME_KEY = name_key_sql("supplier_name")
_ABN_DIGITS = "regexp_replace(coalesce(supplier_abn, ''), '[^0-9]', '', 'g')"
_ABN_SUM = " + ".join(f"coalesce(TRY_CAST(substr({_ABN_DIGITS}, {i + 1}, 1) AS INTEGER), 0) * {w}" for i, w in enumerate([10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19]))
_RUN8 = r"list_distinct(list_transform(regexp_extract_all(regexp_replace(coalesce(po_reference, ''), '([^0-9\s])', '\1\1', 'g'), '(^|[^0-9])([0-9](?:\s?[0-9]){7})($|[^0-9])', 2), lambda x: regexp_replace(x, '\s', '', 'g')))"
_CODE = "regexp_replace(upper(coalesce({0}, '')), '[^A-Z0-9]', '', 'g')"
_WORDS = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'))"
_STATED = f"""
WITH r AS (SELECT read_id, 'PO-' || unnest({_RUN8}) AS po FROM model_read),
l AS (SELECT DISTINCT read_id, line_no, sku, description FROM model_line),
o AS (SELECT DISTINCT po, line_no AS po_line_no, sku AS po_sku, description AS po_description FROM po_line),
p AS (
  SELECT read_id, line_no, po, po_line_no, {_CODE.format("sku")} AS a, {_CODE.format("po_sku")} AS b, {_CODE.format("description")} AS d, {_WORDS.format("description")} AS wa, {_WORDS.format("po_description")} AS wb
  FROM l JOIN r USING (read_id) JOIN o USING (po)),
s AS (
  SELECT *, round(CASE WHEN a <> '' AND b <> '' THEN CASE WHEN a = b THEN 1.0 ELSE 0.0 END WHEN b <> '' AND contains(d, b) THEN 0.95
         WHEN len(wa) > 0 AND len(wb) > 0 THEN CAST(len(list_intersect(wa, wb)) AS DOUBLE) / len(list_distinct(list_concat(wa, wb))) ELSE 0.0 END, 6) AS score FROM p)
SELECT read_id, line_no, po, po_line_no, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY read_id, line_no, po ORDER BY score DESC, po_line_no) AS rn FROM s WHERE score >= 0.6) WHERE rn = 1
"""
_ENTRY = "SELECT DISTINCT statement_no, regexp_replace(upper(reference), '[^A-Z0-9]', '', 'g') AS ref_key FROM {0} WHERE regexp_replace(upper(reference), '[^A-Z0-9]', '', 'g') <> ''"
_SCORE = "0.22 * coalesce(confidence, 0.5) + 0.30 * CASE WHEN grounded IS NULL THEN 0.5 WHEN grounded THEN 1.0 ELSE 0.0 END + 0.18 * 0.5 + 0.12 * 0.5 + 0.08 * 0.8 + 0.10 * 0.5"

SQL = {
    **{k: _CHAIN + _open(*v) for k, v in _REGISTERS.items()},
    "money_owed": _MONEY,
    "register_totals": _CHAIN + " UNION ALL ".join(f"SELECT {i} AS place, '{k}' AS register, count(*) AS n, CAST(sum(open_m) AS BIGINT) AS open_m FROM ({_open(*v)})" for i, (k, v) in enumerate(_REGISTERS.items())),
    "register_recall": _CHAIN + "SELECT count(*) FILTER (t) AS n_true, count(*) FILTER (f) AS n_found, count(*) FILTER (t AND f) AS n_both, count(*) FILTER (t AND f) / count(*) FILTER (t) AS recall, count(*) FILTER (t AND f) / count(*) FILTER (f) AS precision FROM (SELECT invoiced_m < ordered_m AS t, received_m < ordered_m AS f FROM c)",
    "largest_open": f"SELECT * FROM ({_MONEY}) ORDER BY open_c DESC, po LIMIT 10",
    "stated_order_lines": _STATED,
    "canonical_keys": f"SELECT read_id, regexp_replace(upper(coalesce(doc_number, '')), '[^A-Z0-9]', '', 'g') AS number_id, {_NAME_KEY} AS name_key, CASE WHEN {_NAME_KEY} <> '' THEN {_NAME_KEY} ELSE {_ABN_DIGITS} END AS supplier_key, length({_ABN_DIGITS}) = 11 AND ({_ABN_SUM} - 10) % 89 = 0 AS abn_ok FROM model_read",
    "parsed_money": "SELECT read_id, " + ", ".join(f"{_cents(c)} AS {c}_c" for c in ("subtotal", "gst", "total", "opening_balance", "closing_balance")) + " FROM model_read",
    "total_checks": f"""
WITH s AS (SELECT read_id, CAST(sum(c) AS BIGINT) AS lines_c FROM (SELECT DISTINCT read_id, line_no, description, {_cents("amount")} AS c FROM model_line) GROUP BY read_id)
SELECT read_id, lines_c, abs(lines_c - {_cents("subtotal")}) <= 1 AS lines_ok, abs({_cents("subtotal")} + {_cents("gst")} - {_cents("total")}) <= 1 AS total_ok FROM model_read JOIN s USING (read_id)""",
    "text_copies": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_seen, min(doc_id) OVER (PARTITION BY text) < doc_id AS is_copy FROM documents",
    "repeated_documents": "SELECT doc_type, regexp_replace(upper(doc_number), '[^A-Z0-9]', '', 'g') AS number_id, min(read_id) AS first_id, count(DISTINCT read_id) AS copies, min(ref) AS first_ref FROM model_read WHERE doc_type <> '' AND regexp_replace(upper(doc_number), '[^A-Z0-9]', '', 'g') <> '' GROUP BY 1, 2 HAVING count(DISTINCT read_id) > 1",
    "statement_missing": f"({_ENTRY.format('stmt_read')}) EXCEPT ({_ENTRY.format('stmt_ledger')})",
    "statement_agreed": f"({_ENTRY.format('stmt_read')}) INTERSECT ({_ENTRY.format('stmt_ledger')})",
    "statement_not_listed": f"({_ENTRY.format('stmt_ledger')}) EXCEPT ({_ENTRY.format('stmt_read')})",
    "page_groups": """
WITH p AS (SELECT read_id, ref, page, doc_type, coalesce(doc_number, '') AS number FROM model_read),
c AS (
  SELECT *, CASE WHEN row_number() OVER w = 1 THEN 1 WHEN number <> lag(number) OVER w AND number <> '' AND lag(number) OVER w <> '' THEN 1
         WHEN doc_type <> lag(doc_type) OVER w AND lag(doc_type) OVER w <> 'unknown' THEN 1 ELSE 0 END AS cut
  FROM p WINDOW w AS (PARTITION BY ref ORDER BY page, read_id))
SELECT read_id, ref, page, CAST(sum(cut) OVER (PARTITION BY ref ORDER BY page, read_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM c""",
    # Titles of one or more words at the head of the list win over single words: written out, not taken from the operator.
    "title_types": """
SELECT read_id, CASE WHEN t = '' THEN 'unknown'
  WHEN regexp_matches(t, '^(credit note|credit memo|adjustment note|avoir|gutschrift)$') THEN 'credit_note'
  WHEN regexp_matches(t, '^(remittance advice|payment advice|zahlungsavis)$') THEN 'remittance'
  WHEN regexp_matches(t, '^(statement of account|account statement|statement|kontoauszug)$') THEN 'statement'
  WHEN regexp_matches(t, '^(delivery docket|delivery note|packing slip|goods received note|lieferschein|bon de livraison)$') THEN 'goods_receipt'
  WHEN regexp_matches(t, '^(purchase order|order|bestellung|bon de commande)$') THEN 'purchase_order'
  WHEN regexp_matches(t, '^(price list|price schedule|preisliste)$') THEN 'price_schedule'
  WHEN regexp_matches(t, '^(tax [il]nvoice|sales [il]nvoice|[il]nvoice|facture|rechnung)$') THEN 'supplier_invoice'
  ELSE 'unknown' END AS title_type
FROM (SELECT read_id, array_to_string(regexp_extract_all(lower(coalesce(printed_title, '')), '[a-z0-9]+'), ' ') AS t FROM model_read)""",
    "document_titles": r"""
WITH p AS (SELECT * FROM (VALUES
    ('supplier_invoice', 'invoice'), ('supplier_invoice', 'tax invoice'), ('supplier_invoice', 'sales invoice'), ('supplier_invoice', 'facture'), ('supplier_invoice', 'rechnung'),
    ('credit_note', 'credit note'), ('credit_note', 'credit memo'), ('credit_note', 'adjustment note'), ('credit_note', 'avoir'), ('credit_note', 'gutschrift'),
    ('goods_receipt', 'delivery docket'), ('goods_receipt', 'delivery note'), ('goods_receipt', 'packing slip'), ('goods_receipt', 'goods received note'), ('goods_receipt', 'lieferschein'), ('goods_receipt', 'bon de livraison'),
    ('purchase_order', 'order'), ('purchase_order', 'purchase order'), ('purchase_order', 'bestellung'), ('purchase_order', 'bon de commande'),
    ('price_schedule', 'price list'), ('price_schedule', 'price schedule'), ('price_schedule', 'preisliste'),
    ('remittance', 'remittance advice'), ('remittance', 'payment advice'), ('remittance', 'zahlungsavis'),
    ('statement', 'statement of account'), ('statement', 'account statement'), ('statement', 'statement'), ('statement', 'kontoauszug')) v(kind, phrase)),
ph AS (SELECT kind, translate(phrase, 'l', 'i') AS phrase, len(string_split(phrase, ' ')) AS n FROM p),
li AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS ln FROM (SELECT doc_id, regexp_split_to_array(text, '
|[
]') AS lines FROM documents)),
ce AS (SELECT doc_id, ln, list_filter(list_transform(regexp_split_to_array(line, '	+|\s{2,}'), lambda x: trim(x)), lambda x: x <> '') AS cells FROM li),
ro AS (SELECT doc_id, cells, row_number() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS row_no FROM ce WHERE len(cells) > 0),
fl AS (SELECT doc_id, row_no, unnest(cells) AS cell, generate_subscripts(cells, 1) AS cell_no FROM ro),
tk AS (SELECT doc_id, row_no, cell_no, regexp_extract_all(translate(lower(cell), 'l|', 'ii'), '[a-zäöüéèàç]+|[0-9]+|[:#]') AS t FROM fl),
ln AS (SELECT *, ' ' || array_to_string(t, ' ') || ' ' AS line, len(t) AS nt, regexp_replace(array_to_string(t, ''), '[^a-zäöüéèàç]', '', 'g') AS letters, len(list_filter(t, lambda x: length(x) = 1)) AS ones FROM tk),
hit AS (
  SELECT doc_id, row_no, cell_no, kind, n,
         CASE WHEN nt >= 4 AND length(letters) = ones AND letters = replace(phrase, ' ', '') THEN 1.0::DOUBLE ELSE n::DOUBLE / nt END AS share
  FROM ln JOIN ph ON (nt >= 4 AND length(letters) = ones AND letters = replace(phrase, ' ', ''))
    OR (2 * n > nt AND contains(line, ' ' || phrase || ' ') AND NOT regexp_matches(line, ' ' || phrase || ' ([:#]|no|nr|number|date|ref|reference|totai) '))),
best AS (SELECT doc_id, arg_max(kind, (s, n, -row_no, -cell_no, kind)) AS kind, max(s) AS s FROM (SELECT *, CAST(floor(share * 1000000 * 25 / (25 + row_no)) AS BIGINT) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, coalesce(kind, 'unknown') AS doc_type, coalesce(s, 0) AS score FROM (SELECT DISTINCT doc_id FROM fl) LEFT JOIN best USING (doc_id)""",
    "field_json": "SELECT read_id, to_json(list_sort(list_distinct(list(struct_pack(field_name := field_name, value := value, confidence := confidence, evidence := evidence)))))::VARCHAR AS document FROM field_value WHERE value <> '' GROUP BY read_id",
    "digit_share": "SELECT coalesce(source, '') AS source, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(length(regexp_replace(text, '[^0-9]', '', 'g'))) AS BIGINT) AS n_digits FROM documents GROUP BY 1",
    "confidence_bands": f"SELECT source, CASE WHEN s >= 0.92 THEN 'auto' WHEN s >= 0.75 THEN 'review' ELSE 'held' END AS band, count(*) AS n FROM (SELECT source, round(CASE WHEN grounded = false THEN least({_SCORE}, 0.35) ELSE {_SCORE} END, 3) AS s FROM (SELECT DISTINCT * FROM field_value)) GROUP BY ALL",
    "score_tallies": "SELECT field_name, source, count(*) FILTER (same) AS n_right, count(*) AS n_all FROM (SELECT field_name, source, regexp_replace(lower(value), '[^a-z0-9]', '', 'g') = regexp_replace(lower(coalesce(printed, '')), '[^a-z0-9]', '', 'g') AS same FROM field_value WHERE value <> '') GROUP BY GROUPING SETS ((), (field_name), (source))",
    "parsed_numbers": r"""
SELECT read_id, line_no, quantity, CASE WHEN regexp_matches(p, '^-?[0-9]*\.?[0-9]*$') AND regexp_matches(p, '[0-9]') THEN CAST(TRY_CAST(p AS DECIMAL(18, 6)) AS DOUBLE) END AS quantity_n
FROM (SELECT *, CASE WHEN contains(t, ',') AND NOT contains(t, '.') AND NOT regexp_matches(t, ',[0-9]{3}$') THEN replace(t, ',', '.') ELSE replace(t, ',', '') END AS p
      FROM (SELECT DISTINCT read_id, line_no, quantity, regexp_replace(coalesce(quantity, ''), '[^0-9.,-]', '', 'g') AS t FROM model_line))""",
    "text_shapes": r"""
SELECT doc_id, count(*) FILTER (len(cells) > 0) AS n_rows, CAST(sum(len(cells)) AS BIGINT) AS n_cells
FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(line, '\t+|\s{2,}'), lambda x: trim(x)), lambda x: x <> '') AS cells
      FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c]')) AS line FROM documents)) GROUP BY doc_id""",
    "date_order": r"""
SELECT read_id, CASE WHEN a[1] > 12 THEN 'dayfirst' WHEN a[2] > 12 THEN 'monthfirst' END AS proof
FROM (SELECT read_id, list_filter(list_transform(regexp_extract_all(concat_ws(' ', date, due_date, delivery_date), '\b([0-9]{1,2}[/.-][0-9]{1,2})[/.-][0-9]{2,4}\b', 1), lambda x: list_transform(regexp_split_to_array(x, '[/.-]'), lambda y: CAST(y AS INTEGER))),
        lambda p: (p[1] > 12 AND p[2] <= 12) OR (p[2] > 12 AND p[1] <= 12))[1] AS a FROM model_read)""",
}
