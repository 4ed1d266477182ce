"""Queries of documents, their links, lines and pages over the readings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerquarry.functions import text as T
from ledgerquarry.functions.ids import canonical_id, digit_runs
from ledgerquarry.functions.instants import MONTHS
from ledgerquarry.functions.money import money_cents, number_cents
from ledgerquarry.operators import extraction, fields, geometry, links, segments
from ledgerquarry.plans.paperwork_queries import SQL as PAPER_SQL
from ledgerquarry.plans.paperwork_queries import _cents, name_key_sql
from ledgerquarry.runtime import cut, table
from ledgerquarry.sources import sinks


# ---- documents and their orders ---------------------------------------------------------------------------------------
def canonical_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reading of each document (type and nine-digit number): doc_id and what links need."""
    r = table(spark, sf_dir, "model_read")
    rows = r.select(
        F.col("read_id").alias("doc_id"), "doc_type", F.get(digit_runs(F.col("doc_number"), 9), F.lit(0)).alias("number"), T.name_key(F.col("supplier_name")).alias("supplier_key"),
        F.transform(digit_runs(F.col("po_reference"), 8), lambda x: F.concat(F.lit("PO-"), x)).alias("numbers"), digit_runs(F.col("original_invoice"), 9).alias("originals"),
        money_cents(F.col("subtotal")).alias("net_c"), money_cents(F.col("total")).alias("total_c"), T.parse_day(F.col("date")).alias("day"),
    ).where("number is not null and doc_type is not null")
    columns = [c for c in rows.columns if c not in ("doc_type", "number")]
    first = rows.groupBy("doc_type", "number").agg(F.min_by(F.struct(*columns), "doc_id").alias("f"))
    return first.select("doc_type", "number", *[F.col("f")[c].alias(c) for c in columns])


def order_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: supplier key, value in cents and day; lines of an order that repeat exactly count once."""
    lines = order_lines(spark, sf_dir)
    return lines.groupBy("po").agg(F.max("supplier_key").alias("supplier_key"), F.sum("amount_c").cast("bigint").alias("net_c"), F.min("day").alias("day"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "po_line").where("po is not null").select("po", "line_no", "supplier_name", "date", "sku", "description", "ordered", "price").distinct()
    return p.select(
        "po", F.col("line_no").alias("po_line_no"), T.name_key(F.col("supplier_name")).alias("supplier_key"), F.to_date("date").alias("day"), F.col("sku").alias("po_sku"), F.col("description").alias("po_description"),
        F.round(F.col("ordered") * 1000).cast("bigint").alias("ordered_m"), number_cents(F.col("price")).alias("price_c"), F.floor(F.round(F.col("ordered") * 1000).cast("bigint") * number_cents(F.col("price")) / F.lit(1000)).cast("bigint").alias("amount_c"),
    )


def document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, doc_type, po, via): the order of every receipt, invoice and credit note: through the invoice it credits, else
    by the number it states, if the suppliers agree."""
    docs = cut(canonical_readings(spark, sf_dir).where("doc_type in ('supplier_invoice', 'goods_receipt', 'credit_note')"))
    stated = cut(links.stated_links(docs, order_heads(spark, sf_dir)))
    invoices = docs.where("doc_type = 'supplier_invoice'").join(stated, "doc_id", "left").select("doc_id", "number", "po")
    credited = links.credit_links(docs.where("doc_type = 'credit_note'"), invoices).select("doc_id", F.col("po").alias("by_invoice"))
    out = docs.select("doc_id", "doc_type").join(stated, "doc_id", "left").join(credited, "doc_id", "left")
    via = F.when(F.col("by_invoice").isNotNull(), "invoice").when(F.col("po").isNotNull(), "stated")
    return out.select("doc_id", "doc_type", F.coalesce("by_invoice", "po").alias("po"), via.alias("via")).where("po is not null")


def order_line_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line with what was received, billed and credited on it, how many receipts there are and the last invoice."""
    linked = cut(document_links(spark, sf_dir))
    lines = table(spark, sf_dir, "model_line").select(F.col("read_id").alias("doc_id"), "line_no", "sku", "description", T.parse_number(F.col("quantity")).alias("q")).distinct()
    order = cut(order_lines(spark, sf_dir).select("po", "po_line_no", "po_sku", "po_description", "ordered_m").dropDuplicates(["po", "po_line_no"]))
    mine = cut(lines.join(linked.select("doc_id", "doc_type", "po"), "doc_id"))
    best = links.best_order_lines(mine.select("doc_id", "po", "line_no", "sku", "description"), order.drop("ordered_m"))
    quantities = mine.groupBy("doc_id", "doc_type", "line_no").agg(F.max(F.round(F.col("q") * 1000)).cast("bigint").alias("qty_m"))
    moved = best.join(quantities, ["doc_id", "line_no"])
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("doc_type") == kind, F.col("qty_m"))), F.lit(0)).cast("bigint")
    sums = moved.groupBy("po", "po_line_no").agg(
        of("goods_receipt").alias("received_m"), of("supplier_invoice").alias("invoiced_m"), of("credit_note").alias("credited_m"),
        F.count_distinct(F.when(F.col("doc_type") == "goods_receipt", F.col("doc_id"))).alias("n_receipts"), F.max(F.when(F.col("doc_type") == "supplier_invoice", F.col("doc_id"))).alias("last_invoice"),
    )
    out = order.select("po", "po_line_no", "ordered_m").join(sums, ["po", "po_line_no"], "left")
    return out.na.fill(0, ["received_m", "invoiced_m", "credited_m", "n_receipts"])


def invoice_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices with something left after the credit notes that quote them and the remittances of their number."""
    docs = cut(canonical_readings(spark, sf_dir))
    invoices = docs.where("doc_type = 'supplier_invoice' and total_c is not null").select("doc_id", "number", "total_c")
    credits = docs.where("doc_type = 'credit_note'").select(F.get("originals", F.lit(0)).alias("number"), F.abs("total_c").alias("amount_c"))
    paid = docs.where("doc_type = 'remittance'").select("number", F.abs("total_c").alias("amount_c"))
    return links.balances(invoices, credits, paid)


def scored_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, po, score): invoices and receipts without a stated order, and the order that explains them best."""
    docs = canonical_readings(spark, sf_dir).where("doc_type in ('supplier_invoice', 'goods_receipt')")
    free = cut(docs.join(document_links(spark, sf_dir).select("doc_id"), "doc_id", "left_anti").select("doc_id", "supplier_key", "net_c", "day"))
    lines = table(spark, sf_dir, "model_line").select(F.col("read_id").alias("doc_id"), "line_no", "sku", "description").distinct().join(free.select("doc_id"), "doc_id", "left_semi")
    order = cut(order_lines(spark, sf_dir))
    return links.scored_links(free, cut(lines), cut(order_heads(spark, sf_dir)), order.select("po", "po_line_no", "po_sku", "po_description").distinct())


def same_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading that is of a document already read (same type, supplier and number), with the first reading of it."""
    r = table(spark, sf_dir, "model_read").select("read_id", "doc_type", T.name_key(F.col("supplier_name")).alias("supplier_key"), canonical_id(F.coalesce("doc_number", F.lit(""))).alias("number_id")).where("doc_type is not null and supplier_key <> '' and number_id <> ''")
    firsts = r.groupBy("doc_type", "supplier_key", "number_id").agg(F.min("read_id").alias("duplicate_of"), F.max("read_id").alias("__last")).where("duplicate_of < __last").drop("__last")
    return r.join(firsts, ["doc_type", "supplier_key", "number_id"]).where("read_id > duplicate_of").select("read_id", "duplicate_of")


def settled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of every reading, with day and month exchanged where the reading proves it, and whether it stays ambiguous."""
    r = table(spark, sf_dir, "model_read")
    proof = T.order_evidence(F.concat_ws(" ", "date", "due_date", "delivery_date"))
    settled = T.settled_day(F.col("date"), proof, F.coalesce(T.abn_valid(F.col("supplier_abn")), F.lit(False)))
    return r.select("read_id", settled["day"].cast("string").alias("day"), F.coalesce(settled["ambiguous"], F.lit(False)).alias("ambiguous"))


# ---- grids, pages, words ----------------------------------------------------------------------------------------------
PRINTED = {
    "supplier_name": "Supplier", "supplier_abn": "ABN", "buyer_name": "Bill to", "date": "Date", "due_date": "Due date", "po_reference": "Your order no", "original_invoice": "Original invoice",
    "payment_terms": "Payment terms", "delivery_date": "Delivery date", "effective_from": "Effective from", "effective_to": "Effective to",
}
PRINTED_BELOW = {"subtotal": "Subtotal", "gst": "GST", "total": "Total", "opening_balance": "Opening balance", "closing_balance": "Closing balance"}
OWN_LABEL = {"supplier_invoice": "Invoice no", "credit_note": "Credit note no", "goods_receipt": "Docket no", "purchase_order": "Order no", "remittance": "Remittance no", "statement": "Statement no", "price_schedule": "Price list no"}
HEADING = ("Code", "Description", "Qty", "Unit", "Unit price", "Amount")


def reading_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref, row_no, cells): every reading set out as the page it was read from: title, labelled fields, lines, totals."""
    r = table(spark, sf_dir, "model_read")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = F.coalesce(F.try_element_at(T.literal_map(OWN_LABEL, "string"), F.col("doc_type")), F.lit("Document no"))
    above = [F.array(text("printed_title")), F.array(own, text("doc_number")), *[F.array(F.lit(label), text(c)) for c, label in PRINTED.items()], F.array(F.lit(""))]
    below = [F.array(F.lit("")), *[F.array(F.lit(label), text(c)) for c, label in PRINTED_BELOW.items()]]
    def part(rows, start: int) -> DataFrame:
        return r.select(F.col("read_id").alias("ref"), F.posexplode(F.array(*rows)).alias("p", "cells")).select("ref", (F.col("p") + start).cast("bigint").alias("row_no"), "cells")
    lines = table(spark, sf_dir, "model_line").select("read_id", "line_no", "sku", "description", "quantity", "unit", "unit_price", "amount").distinct()
    heads = lines.select("read_id").distinct().select(F.col("read_id").alias("ref"), F.lit(99).cast("bigint").alias("row_no"), F.array(*[F.lit(h) for h in HEADING]).alias("cells"))
    place = F.row_number().over(W.partitionBy("read_id").orderBy("line_no", "sku", "description", "quantity", "unit", "unit_price", "amount"))
    body = lines.select(F.col("read_id").alias("ref"), (place + 99).cast("bigint").alias("row_no"), F.array(*[text(c) for c in ("sku", "description", "quantity", "unit", "unit_price", "amount")]).alias("cells"))
    return part(above, 0).unionByName(heads).unionByName(body).unionByName(part(below, 1 << 40))


def extracted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, field, value, evidence) found again on the pages of ``reading_grids``, without the master list."""
    out = extraction.extract(reading_grids(spark, sf_dir))
    return out.values.select(F.col("ref").alias("read_id"), "field", "value", "evidence")


def extracted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, line_no, sku, description, quantity, unit, unit_price_c, amount_c) found again on those pages."""
    out = extraction.extract(reading_grids(spark, sf_dir))
    return out.lines.select(F.col("ref").alias("read_id"), "line_no", "sku", "description", F.col("quantity").cast("double").alias("quantity"), "unit", "unit_price_c", "amount_c")


def continued_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part_id, doc_id): readings that go on with a document begun earlier in their file, by number, or by the first
    document whose number stands in their references."""
    r = table(spark, sf_dir, "model_read").select("ref", "read_id", "page", "doc_type", canonical_id(F.coalesce("doc_number", F.lit(""))).alias("number"), F.upper(F.concat_ws(" ", "po_reference", "original_invoice", "payment_terms")).alias("text")).where("ref is not null and doc_type is not null")
    heads = r.where("number <> ''").groupBy("ref", "doc_type", "number").agg(F.min(F.struct("page", "read_id")).alias("h")).select("ref", F.col("h.read_id").alias("doc_id"), F.col("h.read_id").alias("seq"), "doc_type", "number")
    heads = cut(heads)
    parts = r.join(heads.select(F.col("doc_id").alias("read_id")), "read_id", "left_anti").select("ref", F.col("read_id").alias("part_id"), "doc_type", "number", "text")
    return segments.attach_continuations(parts, heads, scope=["ref"])


def word_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and cells of each text, found again from the places of its words when set in letters of one width."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\R")).alias("row", "line"))
    tabs = F.regexp_replace("line", r"\t", "  ")
    pieces = lines.select("doc_id", "row", F.posexplode(F.split(F.regexp_replace(tabs, r"\s", " "), " ")).alias("n", "text"))
    before = W.partitionBy("doc_id", "row").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    words = pieces.withColumn("start", start).where("text <> ''").select("doc_id", (F.col("row") * F.lit(1 << 32) + F.col("n")).cast("bigint").alias("word_no"), "text", (F.col("start") * 5.0).alias("x0"), ((F.col("start") + F.length("text")) * 5.0).alias("x1"), (F.col("row") * 12.0).alias("top"), (F.col("row") * 12.0 + 6).alias("bottom"), F.lit(6.0).alias("size"))
    cells = geometry.cells_of_words(words, ["doc_id"])
    return cells.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.sum(F.size("cells")).cast("bigint").alias("n_cells"))


def page_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by document type as pages: how many hold text, how many do not, characters and digits."""
    d = table(spark, sf_dir, "documents").select(F.coalesce("doc_type", F.lit("")).alias("doc_type"), "text")
    return geometry.page_kinds(d, ["doc_type"], "text")


def gate_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per field: values accepted (reading read), flagged and held, how many are blank, and the share let through."""
    f = table(spark, sf_dir, "field_value").select("read_id", "field_name", "value").distinct()
    status = table(spark, sf_dir, "model_read").select("read_id", "status")
    filled = F.coalesce(F.trim("value"), F.lit("")) != ""
    by = f.join(status, "read_id").groupBy("field_name").agg(
        F.count_if((F.col("status") == "read") & filled).alias("accepted"), F.count_if((F.col("status") == "flagged") & filled).alias("flagged"),
        F.count_if((F.col("status") == "held") & filled).alias("held"), F.count_if(~filled).alias("blank"), F.count("*").alias("n_all"),
    )
    return by.withColumn("coverage", F.round(F.try_divide("accepted", "n_all"), 6))


def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's lines in their order: readings by status, then open money, as text."""
    r = table(spark, sf_dir, "model_read").groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("n"))
    owed = invoice_balances(spark, sf_dir).agg(F.count("*").alias("n"), F.sum("open_c").cast("bigint").alias("c"))
    return sinks.report_lines([("Readings", r, "status", "n", None), ("Money owed", owed.select(F.lit("open invoices").alias("k"), "n", "c"), "k", "n", "c")])


QUERIES = {
    f.__name__: f
    for f in (
        document_links, order_line_chain, invoice_balances, scored_links, same_documents, settled_days, extracted_fields, extracted_lines,
        continued_readings, word_cells, page_profile, gate_quality, status_report,
    )
}


# ---- SQL --------------------------------------------------------------------------------------------------------------
def _runs(c: str, n: int) -> str:
    doubled = rf"regexp_replace(coalesce({c}, ''), '([^0-9\s])', '\1\1', 'g')"
    found = rf"regexp_extract_all({doubled}, '(^|[^0-9])([0-9](?:\s?[0-9]){{{n - 1}}})($|[^0-9])', 2)"
    return rf"list_distinct(list_transform({found}, lambda x: regexp_replace(x, '\s', '', 'g')))"


def ordered_runs(c: str, n: int) -> str:
    """The same, in the order of the text (list_distinct does not keep it)."""
    doubled = rf"regexp_replace(coalesce({c}, ''), '([^0-9\s])', '\1\1', 'g')"
    found = rf"regexp_extract_all({doubled}, '(^|[^0-9])([0-9](?:\s?[0-9]){{{n - 1}}})($|[^0-9])', 2)"
    return rf"list_transform({found}, lambda x: regexp_replace(x, '\s', '', 'g'))"


_MONTH_MAP = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in MONTHS.items()) + "}"


def day_sql(c: str) -> str:
    """A printed day, by lists of words and numbers."""
    text = f"translate(lower(coalesce({c}, '')), 'áàâäãåéèêëíìîïóòôöõúùûüçñ', 'aaaaaaeeeeiiiiooooouuuucn')"
    tokens = rf"regexp_extract_all({text}, '[0-9]+|[a-z]+|[^0-9a-z\s]')"
    named = f"list_filter({tokens}, lambda t: regexp_matches(t, '^[0-9a-z]') AND t NOT IN ('st', 'nd', 'rd', 'th', 'er', 'of'))"
    date = lambda y, m, d: f"TRY_CAST(CASE WHEN length({y}) = 2 THEN '20' || {y} ELSE {y} END || '-' || lpad(CAST({m} AS VARCHAR), 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"
    k = [f"k[i + {j}]" for j in range(5)]
    short = lambda x: f"regexp_matches({x}, '^[0-9]{{1,2}}$')"
    parted = f"{k[1]} IN ('/', '.', '-') AND {k[1]} = {k[3]} AND {short(k[2])}"
    first = f"CASE WHEN {parted} AND regexp_matches({k[0]}, '^[0-9]{{4}}$') AND {short(k[4])} THEN {{'d': {date(k[0], k[2], k[4])}}} WHEN {parted} AND {short(k[0])} AND regexp_matches({k[4]}, '^([0-9]{{2}}|[0-9]{{4}})$') THEN {{'d': coalesce({date(k[4], k[2], k[0])}, {date(k[4], k[0], k[2])})}} END"
    w = [f"w[i + {j}]" for j in range(3)]
    month = lambda x: f"coalesce(({_MONTH_MAP})[{x}], CASE WHEN length({x}) > 3 THEN ({_MONTH_MAP})[substr({x}, 1, 3)] END)"
    second = f"CASE WHEN {short(w[0])} AND {month(w[1])} IS NOT NULL AND regexp_matches({w[2]}, '^([0-9]{{2}}|[0-9]{{4}})$') THEN {{'d': {date(w[2], month(w[1]), w[0])}}} WHEN {month(w[0])} IS NOT NULL AND {short(w[1])} AND regexp_matches({w[2]}, '^[0-9]{{4}}$') THEN {{'d': {date(w[2], month(w[0]), w[1])}}} END"
    pick = lambda expr, n, size: f"list_filter(list_transform(range(1, greatest(len({n}) - {size - 1}, 0) + 1), lambda i: {expr}), lambda x: x IS NOT NULL)[1]"
    return f"(SELECT coalesce({pick(first, 'k', 5)}, {pick(second, 'w', 3)}).d FROM (SELECT {tokens} AS k, {named} AS w))"


_CANON = f"""
canon AS (
  SELECT doc_type, number, min(doc_id) AS doc_id FROM (SELECT read_id AS doc_id, doc_type, {ordered_runs("doc_number", 9)}[1] AS number FROM model_read) WHERE number IS NOT NULL AND doc_type IS NOT NULL GROUP BY ALL),
docs AS (
  SELECT c.*, {name_key_sql("m.supplier_name")} AS supplier_key, {ordered_runs("m.po_reference", 8)} AS numbers, {ordered_runs("m.original_invoice", 9)} AS originals,
         {_cents("m.subtotal")} AS net_c, {_cents("m.total")} AS total_c, m.date AS printed_date
  FROM canon c JOIN model_read m ON m.read_id = c.doc_id),
pol AS (
  SELECT po, line_no AS po_line_no, {name_key_sql("supplier_name")} AS supplier_key, CAST(date AS DATE) AS day, sku AS po_sku, description AS po_description, ordered_m, price_c, CAST(ordered_m * price_c // 1000 AS BIGINT) AS amount_c
  FROM (SELECT *, CAST(round(ordered * 1000) AS BIGINT) AS ordered_m, CAST(round(price * 100) AS BIGINT) AS price_c FROM (SELECT DISTINCT po, line_no, supplier_name, date, sku, description, ordered, price FROM po_line WHERE po IS NOT NULL))),
heads AS (SELECT po, max(supplier_key) AS supplier_key, CAST(sum(amount_c) AS BIGINT) AS net_c, min(day) AS day FROM pol GROUP BY po)"""


def _supplier_score(a: str, b: str) -> str:
    wa, wb = f"list_distinct(string_split({a}, ' '))", f"list_distinct(string_split({b}, ' '))"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 1.0 ELSE CAST(len(list_intersect({wa}, {wb})) AS DOUBLE) / len(list_distinct(list_concat({wa}, {wb}))) END"


_LINKS = f"""{_CANON},
asked AS (SELECT doc_id, supplier_key, unnest(numbers) AS n, generate_subscripts(numbers, 1) AS k FROM docs WHERE doc_type IN ('supplier_invoice', 'goods_receipt', 'credit_note')),
stated AS (SELECT doc_id, arg_min(h.po, k) AS po FROM asked a JOIN heads h ON h.po = 'PO-' || a.n WHERE {_supplier_score("a.supplier_key", "h.supplier_key")} >= 0.5 GROUP BY doc_id),
inv AS (SELECT d.doc_id, d.number, s.po FROM docs d LEFT JOIN stated s USING (doc_id) WHERE doc_type = 'supplier_invoice'),
cred AS (SELECT doc_id, first(po ORDER BY k) AS by_invoice FROM (SELECT d.doc_id, unnest(originals) AS o, generate_subscripts(originals, 1) AS k FROM docs d WHERE doc_type = 'credit_note') c JOIN inv ON inv.number = c.o GROUP BY c.doc_id),
linked AS (
  SELECT d.doc_id, d.doc_type, coalesce(by_invoice, po) AS po, CASE WHEN by_invoice IS NOT NULL THEN 'invoice' ELSE 'stated' END AS via
  FROM docs d LEFT JOIN stated USING (doc_id) LEFT JOIN cred USING (doc_id) WHERE doc_type IN ('supplier_invoice', 'goods_receipt', 'credit_note') AND coalesce(by_invoice, po) IS NOT NULL)"""
_LINKS = _LINKS.replace("(SELECT d.doc_id, unnest(originals) AS o, generate_subscripts(originals, 1) AS k FROM docs d WHERE doc_type = 'credit_note') c JOIN inv ON inv.number = c.o GROUP BY c.doc_id)", "(SELECT x.doc_id, x.k, inv.po FROM (SELECT d.doc_id, unnest(originals) AS o, generate_subscripts(originals, 1) AS k FROM docs d WHERE doc_type = 'credit_note') x JOIN inv ON inv.number = x.o) GROUP BY doc_id)")

_CODE = "regexp_replace(upper(coalesce({0}, '')), '[^A-Z0-9]', '', 'g')"
_WORDS = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'))"
_FIT = f"""round(CASE WHEN {_CODE.format("sku")} <> '' AND {_CODE.format("po_sku")} <> '' THEN CASE WHEN {_CODE.format("sku")} = {_CODE.format("po_sku")} THEN 1.0 ELSE 0.0 END
  WHEN {_CODE.format("po_sku")} <> '' AND contains({_CODE.format("description")}, {_CODE.format("po_sku")}) THEN 0.95
  WHEN len({_WORDS.format("description")}) > 0 AND len({_WORDS.format("po_description")}) > 0 THEN CAST(len(list_intersect({_WORDS.format("description")}, {_WORDS.format("po_description")})) AS DOUBLE) / len(list_distinct(list_concat({_WORDS.format("description")}, {_WORDS.format("po_description")}))) ELSE 0.0 END, 6)"""
_NUMBER_SQL = r"(SELECT CASE WHEN regexp_matches(p, '^-?[0-9]*\.?[0-9]*$') AND regexp_matches(p, '[0-9]') THEN TRY_CAST(p AS DECIMAL(18, 6)) END FROM (SELECT CASE WHEN contains(t, ',') AND NOT contains(t, '.') AND NOT regexp_matches(t, ',[0-9]{{3}}$') THEN replace(t, ',', '.') ELSE replace(t, ',', '') END AS p FROM (SELECT regexp_replace(coalesce({0}, ''), '[^0-9.,-]', '', 'g') AS t)))"

_CHAIN_SQL = f"""WITH {_LINKS},
ol AS (SELECT po, po_line_no, any_value(po_sku) AS po_sku, any_value(po_description) AS po_description, any_value(ordered_m) AS ordered_m FROM pol GROUP BY po, po_line_no),
ml AS (SELECT DISTINCT read_id AS doc_id, line_no, sku, description, {_NUMBER_SQL.format("quantity")} AS q FROM model_line),
mine AS (SELECT ml.*, l.doc_type, l.po FROM ml JOIN linked l USING (doc_id)),
fit AS (SELECT doc_id, line_no, po, po_line_no, {_FIT} AS score FROM mine JOIN ol USING (po)),
best AS (SELECT doc_id, line_no, po, po_line_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no, po ORDER BY score DESC, po_line_no) AS rn FROM fit WHERE score >= 0.6) WHERE rn = 1),
q AS (SELECT doc_id, doc_type, line_no, CAST(max(round(q * 1000)) AS BIGINT) AS qty_m FROM mine GROUP BY ALL),
s AS (
  SELECT po, po_line_no, CAST(coalesce(sum(qty_m) FILTER (doc_type = 'goods_receipt'), 0) AS BIGINT) AS received_m, CAST(coalesce(sum(qty_m) FILTER (doc_type = 'supplier_invoice'), 0) AS BIGINT) AS invoiced_m,
         CAST(coalesce(sum(qty_m) FILTER (doc_type = 'credit_note'), 0) AS BIGINT) AS credited_m, count(DISTINCT doc_id) FILTER (doc_type = 'goods_receipt') AS n_receipts, max(doc_id) FILTER (doc_type = 'supplier_invoice') AS last_invoice
  FROM best JOIN q USING (doc_id, line_no) GROUP BY po, po_line_no)
SELECT po, po_line_no, ordered_m, coalesce(received_m, 0) AS received_m, coalesce(invoiced_m, 0) AS invoiced_m, coalesce(credited_m, 0) AS credited_m, coalesce(n_receipts, 0) AS n_receipts, last_invoice
FROM ol LEFT JOIN s USING (po, po_line_no)"""

_BALANCES = f"""WITH {_CANON},
c AS (SELECT originals[1] AS number, sum(abs(total_c)) AS c FROM docs WHERE doc_type = 'credit_note' AND originals[1] IS NOT NULL GROUP BY 1),
p AS (SELECT number, sum(abs(total_c)) AS p FROM docs WHERE doc_type = 'remittance' GROUP BY 1)
SELECT doc_id, number, total_c, CAST(coalesce(c, 0) AS BIGINT) AS credited_c, CAST(coalesce(p, 0) AS BIGINT) AS paid_c, CAST(total_c - coalesce(c, 0) - coalesce(p, 0) AS BIGINT) AS open_c
FROM docs LEFT JOIN c USING (number) LEFT JOIN p USING (number) WHERE doc_type = 'supplier_invoice' AND total_c - coalesce(c, 0) - coalesce(p, 0) > 0"""

_SCORED = f"""WITH {_LINKS},
free AS (SELECT doc_id, supplier_key, net_c, {day_sql("printed_date")} AS day FROM docs WHERE doc_type IN ('supplier_invoice', 'goods_receipt') AND doc_id NOT IN (SELECT doc_id FROM linked)),
fl AS (SELECT DISTINCT read_id AS doc_id, line_no, sku, description FROM model_line WHERE read_id IN (SELECT doc_id FROM free)),
ol AS (SELECT DISTINCT po, po_line_no, po_sku, po_description FROM pol),
met AS (
  SELECT f.doc_id, h.po FROM free f JOIN heads h ON f.supplier_key = h.supplier_key AND f.net_c = h.net_c WHERE f.supplier_key <> '' AND f.net_c > 0
  UNION SELECT f.doc_id, h.po FROM free f JOIN heads h ON f.supplier_key = h.supplier_key WHERE f.supplier_key <> '' AND (year(f.day) * 12 + month(f.day)) - (year(h.day) * 12 + month(h.day)) BETWEEN 0 AND 3
  UNION SELECT fl.doc_id, ol.po FROM fl JOIN ol ON {_CODE.format("fl.sku")} = {_CODE.format("ol.po_sku")} WHERE {_CODE.format("fl.sku")} <> ''),
hits AS (SELECT doc_id, po, count(DISTINCT line_no) AS hits FROM met JOIN fl USING (doc_id) JOIN ol USING (po) WHERE {_FIT} >= 0.6 GROUP BY ALL),
n AS (SELECT doc_id, count(DISTINCT line_no) AS n FROM fl GROUP BY doc_id),
s AS (
  SELECT met.doc_id, met.po, round(0.35 * ({_supplier_score("f.supplier_key", "h.supplier_key")})
    + 0.25 * CASE WHEN coalesce(f.net_c, 0) <> 0 AND coalesce(h.net_c, 0) <> 0 THEN greatest(0.0, 1 - CAST(abs(f.net_c - h.net_c) AS DOUBLE) / h.net_c) ELSE 0.0 END
    + 0.15 * CASE WHEN date_diff('day', h.day, f.day) BETWEEN 0 AND 45 THEN 1.0 WHEN date_diff('day', h.day, f.day) BETWEEN -3 AND 90 THEN 0.3 ELSE 0.0 END
    + 0.25 * coalesce(CAST(hits AS DOUBLE) / n, 0.0), 6) AS score
  FROM met JOIN free f USING (doc_id) JOIN heads h USING (po) LEFT JOIN hits USING (doc_id, po) LEFT JOIN n USING (doc_id))
SELECT doc_id, po, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, po) AS rn FROM s WHERE score >= 0.6) WHERE rn = 1"""

_SAME = f"""WITH r AS (SELECT read_id, doc_type, {name_key_sql("supplier_name")} AS k, regexp_replace(upper(coalesce(doc_number, '')), '[^A-Z0-9]', '', 'g') AS n FROM model_read)
SELECT read_id, d AS duplicate_of FROM (SELECT read_id, min(read_id) OVER (PARTITION BY doc_type, k, n) AS d FROM r WHERE k <> '' AND n <> '' AND doc_type IS NOT NULL) WHERE read_id > d"""

_PROOF = r"""(SELECT CASE WHEN a[1] > 12 THEN 'dayfirst' WHEN a[2] > 12 THEN 'monthfirst' END FROM (SELECT list_filter(list_transform(regexp_extract_all(concat_ws(' ', date, due_date, delivery_date), '\b([0-9]{1,2}[/.-][0-9]{1,2})[/.-][0-9]{2,4}\b', 1), lambda x: list_transform(regexp_split_to_array(x, '[/.-]'), lambda y: CAST(y AS INTEGER))), lambda p: (p[1] > 12 AND p[2] <= 12) OR (p[2] > 12 AND p[1] <= 12))[1] AS a))"""
_ABN = "regexp_replace(coalesce(supplier_abn, ''), '[^0-9]', '', 'g')"
_ABN_OK = f"(length({_ABN}) = 11 AND (" + " + ".join(f"coalesce(TRY_CAST(substr({_ABN}, {i + 1}, 1) AS INTEGER), 0) * {w}" for i, w in enumerate([10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19])) + " - 10) % 89 = 0)"
_SETTLED = rf"""
WITH d AS (
  SELECT read_id, {day_sql("date")} AS day, {_PROOF} AS proof, {_ABN_OK} AS au,
         list_transform(regexp_split_to_array(nullif(regexp_extract(regexp_replace(coalesce(date, ''), '([^0-9/.-])', '\1\1', 'g'), '(^|[^0-9])([0-9]{{1,2}}[/.-][0-9]{{1,2}})[/.-]([0-9]{{4}}|[0-9]{{2}})($|[^0-9])', 2), ''), '[/.-]'), lambda y: TRY_CAST(y AS INTEGER)) AS p
  FROM model_read),
o AS (SELECT *, coalesce(p[1] <= 12 AND p[2] <= 12 AND p[1] <> p[2], false) AS open_order FROM d)
SELECT read_id, CAST(CASE WHEN open_order AND proof = 'monthfirst' AND NOT au THEN make_date(year(day), day(day), month(day)) ELSE day END AS VARCHAR) AS day, day IS NOT NULL AND open_order AND NOT au AND proof IS NULL AS ambiguous
FROM o"""

_CONTINUED = r"""
WITH r AS (SELECT ref, read_id, page, doc_type, regexp_replace(upper(coalesce(doc_number, '')), '[^A-Z0-9]', '', 'g') AS number, upper(concat_ws(' ', po_reference, original_invoice, payment_terms)) AS text FROM model_read WHERE ref IS NOT NULL AND doc_type IS NOT NULL),
h AS (SELECT ref, doc_type, number, arg_min(read_id, (page, read_id)) AS doc_id FROM r WHERE number <> '' GROUP BY ALL),
p AS (SELECT * FROM r WHERE read_id NOT IN (SELECT doc_id FROM h)),
f AS (
  SELECT p.read_id AS part_id, h.doc_id, 0 AS tier FROM p JOIN h USING (ref, doc_type, number) WHERE number <> ''
  UNION ALL SELECT p.read_id, h.doc_id, 1 FROM (SELECT ref, read_id, unnest(list_distinct(regexp_extract_all(text, '[\p{L}\p{N}_](?:[\p{L}\p{N}_/.-]*[\p{L}\p{N}_])?'))) AS w FROM p WHERE number = '') p JOIN h ON h.ref = p.ref AND h.number = p.w)
SELECT part_id, arg_min(doc_id, (tier, doc_id)) AS doc_id FROM f GROUP BY part_id"""

_GATE = """
SELECT field_name, count(*) FILTER (status = 'read' AND filled) AS accepted, count(*) FILTER (status = 'flagged' AND filled) AS flagged, count(*) FILTER (status = 'held' AND filled) AS held,
       count(*) FILTER (NOT filled) AS blank, count(*) AS n_all, round(count(*) FILTER (status = 'read' AND filled) / count(*), 6) AS coverage
FROM (SELECT f.field_name, m.status, trim(coalesce(f.value, '')) <> '' AS filled FROM (SELECT DISTINCT read_id, field_name, value FROM field_value) f JOIN model_read m USING (read_id)) GROUP BY field_name"""

def _typed_sql(field: str, c: str) -> str:
    text = f"trim(coalesce({c}, ''))"
    if field in fields.MONEY_FIELDS:
        return f"CASE WHEN NOT regexp_matches({text}, '\\p{{L}}{{4,}}|\\p{{L}}\\d|\\d\\p{{L}}') THEN CAST(CAST({_cents(c)} AS DECIMAL(20, 2)) / 100 AS DECIMAL(18, 2))::VARCHAR END"
    if field in fields.DAY_FIELDS:
        return f"CAST({day_sql(c)} AS VARCHAR)"
    if field in fields.REF_FIELDS:
        words = f"list_transform(regexp_split_to_array({text}, '\\s+'), lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'))"
        return f"list_filter({words}, lambda w: regexp_matches(w, '[0-9]') AND length(w) BETWEEN 2 AND 32 AND NOT regexp_matches(w, '^[0-9]{{1,4}}[/.-][0-9]{{1,2}}[/.-][0-9]{{1,4}}$'))[1]"
    if field == "supplier_abn":
        valid = "(" + " + ".join(f"CAST(substr(x, {i + 1}, 1) AS INTEGER) * {w}" for i, w in enumerate([10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19])) + " - 10) % 89 = 0"
        return f"list_transform(list_filter({_runs(c, 11)}, lambda x: {valid}), lambda x: substr(x, 1, 2) || ' ' || substr(x, 3, 3) || ' ' || substr(x, 6, 3) || ' ' || substr(x, 9, 3))[1]"
    if field == "payment_terms":
        return f"CASE WHEN length({text}) BETWEEN 2 AND 60 THEN {text} END"
    words = f"regexp_split_to_array({text}, '\\s+')"
    return f"CASE WHEN length({text}) BETWEEN 2 AND 80 AND regexp_matches({text}, '\\p{{L}}.*\\p{{L}}') AND len({words}) <= 10 AND NOT starts_with({text}, '(') AND NOT (len({words}) > 3 AND regexp_matches(lower({text}), '\\b(please|must|should|only|not|before)\\b')) THEN {text} END"


_TITLED = "SELECT m.*, t.title_type FROM model_read m JOIN (" + PAPER_SQL["title_types"] + ") t USING (read_id) WHERE t.title_type <> 'unknown'"
_FIELDS_SQL = f"WITH titled AS ({_TITLED}) SELECT read_id, field, value, 'label' AS evidence FROM (" + " UNION ALL ".join(
    f"SELECT read_id, '{f}' AS field, {_typed_sql(f, f)} AS value FROM titled WHERE title_type IN ({', '.join(repr(k) for k, fs in fields.HEADER_OF.items() if f in fs)}) AND trim(coalesce({f}, '')) <> ''"
    for f in ("doc_number", *PRINTED, *PRINTED_BELOW)
) + ") WHERE value IS NOT NULL"

SQL = {
    "extracted_fields": _FIELDS_SQL,
    "printed_days": f"SELECT read_id, CAST({day_sql('date')} AS VARCHAR) AS day FROM model_read",
    "document_links": f"WITH {_LINKS} SELECT doc_id, doc_type, po, via FROM linked",
    "order_line_chain": _CHAIN_SQL,
    "invoice_balances": _BALANCES,
    "scored_links": _SCORED,
    "same_documents": _SAME,
    "settled_days": _SETTLED,
    "continued_readings": _CONTINUED,
    "gate_quality": _GATE,
    "page_profile": r"SELECT coalesce(doc_type, '') AS doc_type, count(*) AS pages, count(*) FILTER (n >= 40) AS text_pages, count(*) FILTER (n < 40) AS image_pages, CAST(sum(n) AS BIGINT) AS chars, CAST(sum(d) AS BIGINT) AS digits FROM (SELECT doc_type, length(regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]', '', 'g')) AS n, length(regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g')) AS d FROM documents) GROUP BY 1",
    "word_cells": r"""
SELECT doc_id, count(*) AS n_rows, CAST(sum(len(cells)) AS BIGINT) AS n_cells
FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(line, '\t+|\s{2,}'), lambda x: trim(x)), lambda x: x <> '') AS cells
      FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c]')) AS line FROM documents)) WHERE len(cells) > 0 GROUP BY doc_id""",
}
