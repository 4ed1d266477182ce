"""Header fields, tables and lines from rows of cells.

Labels are composed, not listed: a field has subjects ("invoice", "due") and nouns ("number", "date"), and every pairing
is a label; whole labels are added for what has no such form. A cell's first words are looked up in that map, the longest
label first, so a cell costs a few lookups however long the vocabulary is. A value is the rest of its label's cell, else
the next filled cell to the right, else the cell below; the first that passes the field's test is taken.

Rows: (key, row_no, cells) and, where the page gives positions, ``xs`` with the centre of each cell.

Defined cases: null cells are empty; a label without acceptable value gives nothing; among values of one field the longer
label wins, then the upper row (for the closing balance the lower); a table's heading needs two known columns, one of
them of numbers; documents without table have no lines; ties go to the left cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerquarry.functions.money import money_cents
from ledgerquarry.functions.text import bound, find_abns, literal_map, normal_label, parse_day, parse_number

NUMBER = ("number", "no", "nr", "#")
DATE = ("date", "day")
#: field: (subjects, nouns, whole labels)
GRAMMAR: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "date": (("invoice", "issue", "document", "docket", "statement", "order", "payment", "credit note"), DATE, ("date", "dated", "issued", "datum")),
    "due_date": (("due", "payment due"), DATE, ("pay by", "due", "payable by")),
    "delivery_date": (("delivery", "required"), DATE, ("deliver by", "required by")),
    "effective_from": (("effective",), ("from",), ("valid from", "prices from")),
    "effective_to": (("effective",), ("to", "until"), ("valid to", "valid until")),
    "po_reference": (("po", "purchase order", "customer order", "your order"), NUMBER + ("ref", "reference"), ("your order", "customer po", "order reference")),
    "original_invoice": (("original invoice", "credited invoice"), NUMBER, ("original invoice", "credit for invoice", "invoice credited")),
    "payment_terms": (("payment", "trading"), ("terms",), ("terms",)),
    "supplier_name": (("supplier", "vendor", "seller"), ("name",), ("supplier", "vendor", "seller", "from")),
    "buyer_name": (("buyer", "customer"), ("name",), ("buyer", "customer", "bill to", "sold to")),
    "supplier_abn": (("supplier", "vendor"), ("abn",), ("abn", "a b n")),
    "subtotal": (("net", "goods"), ("total", "amount"), ("subtotal", "sub total", "total excluding gst", "total before tax")),
    "gst": (("gst", "tax"), ("amount", "total"), ("gst", "tax", "total gst")),
    "total": (("invoice", "grand", "gross"), ("total", "amount"), ("total", "amount due", "total including gst", "total payable")),
    "opening_balance": (("opening", "previous"), ("balance",), ("balance brought forward",)),
    "closing_balance": (("closing", "new"), ("balance",), ("balance due", "balance carried forward")),
}
#: What a document's own number is called, by its type.
OWN_NUMBER: dict[str, tuple[str, ...]] = {
    "supplier_invoice": ("invoice", "tax invoice", "document"),
    "credit_note": ("credit note", "adjustment note", "credit", "document"),
    "goods_receipt": ("docket", "delivery note", "delivery", "packing slip", "document"),
    "purchase_order": ("purchase order", "order", "po", "document"),
    "remittance": ("remittance", "payment", "document"),
    "statement": ("statement",),
    "price_schedule": ("price list", "schedule", "document"),
}
COLUMNS: dict[str, tuple[str, ...]] = {
    "sku": ("code", "item code", "part no", "sku", "article"),
    "description": ("description", "goods", "particulars", "item"),
    "quantity": ("quantity", "qty", "ordered", "supplied"),
    "received": ("received", "qty received"),
    "unit": ("unit", "uom"),
    "unit_price": ("unit price", "price", "rate"),
    "amount": ("amount", "line total", "value", "net"),
    "reference": ("reference", "ref", "invoice"),
    "date": ("date", "entry date"),
    "debit": ("debit", "charge"),
    "credit": ("credit", "payment"),
    "balance": ("balance",),
}
NUMERIC_ROLES = ("quantity", "received", "unit_price", "amount", "debit", "credit")
MONEY_FIELDS = ("subtotal", "gst", "total", "opening_balance", "closing_balance")
DAY_FIELDS = ("date", "due_date", "delivery_date", "effective_from", "effective_to")
REF_FIELDS = ("doc_number", "po_reference", "original_invoice")
#: The fields a document of a type has, and those its lines have.
HEADER_OF: dict[str, tuple[str, ...]] = {
    "supplier_invoice": ("supplier_name", "supplier_abn", "buyer_name", "doc_number", "date", "po_reference", "due_date", "payment_terms", "subtotal", "gst", "total"),
    "credit_note": ("supplier_name", "supplier_abn", "buyer_name", "doc_number", "date", "original_invoice", "po_reference", "subtotal", "gst", "total"),
    "goods_receipt": ("supplier_name", "buyer_name", "doc_number", "date", "po_reference"),
    "statement": ("supplier_name", "supplier_abn", "buyer_name", "date", "opening_balance", "closing_balance"),
    "price_schedule": ("supplier_name", "doc_number", "effective_from", "effective_to"),
    "purchase_order": ("supplier_name", "buyer_name", "doc_number", "date", "delivery_date", "subtotal", "gst", "total"),
    "remittance": ("supplier_name", "buyer_name", "doc_number", "date", "total"),
}
LINE_OF: dict[str, tuple[str, ...]] = {
    **dict.fromkeys(("supplier_invoice", "credit_note", "purchase_order"), ("sku", "description", "quantity", "unit", "unit_price", "amount")),
    "goods_receipt": ("sku", "description", "quantity", "unit"),
    "statement": ("date", "reference", "description", "amount"),
    "price_schedule": ("sku", "description", "unit", "unit_price"),
    "remittance": ("reference", "amount"),
}
MOST_WORDS = 4
#: Rows that end a table: their first filled cell begins with such a word.
CLOSING_WORDS = ("subtotal", "sub", "net", "total", "gst", "tax", "amount", "balance", "closing", "grand")


def labels(grammar=None) -> dict[str, str]:
    """Label: field, in normal form."""
    out: dict[str, str] = {}
    for field, (subjects, nouns, others) in (grammar or GRAMMAR).items():
        for label in [*others, *(f"{s} {n}" for s in subjects for n in nouns)]:
            out.setdefault(label, field)
    return out


def own_number_labels(own=None) -> dict[str, set[str]]:
    """Label of a document's own number: the types that use it."""
    out: dict[str, set[str]] = {}
    for kind, subjects in (own or OWN_NUMBER).items():
        for label in (f"{s} {n}" for s in subjects for n in NUMBER):
            out.setdefault(label, set()).add(kind)
    return out


def first_reference(c: Column) -> Column:
    """The first word with a digit, 2 to 32 characters, that is no date."""
    found = F.transform(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    dated = lambda w: w.rlike(r"^\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}$") & parse_day(w).isNotNull()
    return F.get(F.filter(found, lambda w: w.rlike(r"\d") & F.length(w).between(2, 32) & ~dated(w)), F.lit(0))


def name_like(c: Column) -> Column:
    """A name: two letters, at most ten words and 80 characters, no bracket first, and no sentence that tells to do something."""
    asks = (F.size(F.split(c, r"\s+")) > 3) & F.lower(c).rlike(r"\b(please|must|should|only|not|before)\b")
    return F.length(c).between(2, 80) & c.rlike(r"\p{L}.*\p{L}") & (F.size(F.split(c, r"\s+")) <= 10) & ~c.startswith("(") & ~asks


def typed_value(field: Column, raw: Column) -> Column:
    """The value as canonical text if it passes the field's test, else null."""
    text = F.trim(raw)
    money = F.when(~text.rlike(r"\p{L}{4,}|\p{L}\d|\d\p{L}"), money_cents(text))
    return (
        F.when(text == "", None)
        .when(field.isin(*MONEY_FIELDS), (money / 100).cast("decimal(18,2)").cast("string"))
        .when(field.isin(*DAY_FIELDS), parse_day(text).cast("string"))
        .when(field.isin(*REF_FIELDS), first_reference(text))
        .when(field == "supplier_abn", F.get(find_abns(text), F.lit(0)))
        .when(field == "payment_terms", F.when(F.length(text).between(2, 60), text))
        .otherwise(F.when(name_like(text), text))
    )


def match_label(cell: Column, known: Column) -> Column:
    """struct(words, hit, rest): the longest run of first words that is a key of the map ``known``, what it stands for, and
    the text after it; null where there is none."""
    def at(words: Column, n: int) -> Column:
        hit = F.when(F.size(words) >= n, F.try_element_at(known, F.array_join(F.slice(words, 1, n), " ")))
        rest = F.trim(F.regexp_replace(cell, r"^[^\p{L}\p{N}#%]*(?:[\p{L}\p{N}_#%]+[^\p{L}\p{N}#%]+?){" + str(n - 1) + r"}(?:[\p{L}\p{N}_]+|[#%])[\s:.]*(?:-\s+)?", ""))
        return bound(hit, lambda h: F.when(h.isNotNull(), F.struct(F.lit(n).alias("words"), h.alias("hit"), rest.alias("rest"))))

    # Words of a label are letters: most cells, being values, are told by their first word and cost no lookup.
    return bound(F.split(normal_label(cell), " "), lambda words: F.when(F.get(words, F.lit(0)).rlike("^[a-z]"), F.coalesce(*[at(words, n) for n in range(MOST_WORDS, 0, -1)])))


def known_labels(grammar=None, own=None) -> Column:
    """All labels as a map: the field a label stands for, and the types whose own number it names."""
    numbers = own_number_labels(own)
    whole = {label: {"field": name, "own": sorted(numbers.get(label, ()))} for label, name in labels(grammar).items()}
    whole |= {label: {"field": None, "own": sorted(kinds)} for label, kinds in numbers.items() if label not in whole}
    return literal_map(whole, "struct<field:string,own:array<string>>")


def heading_rows(rows: DataFrame, key: str = "ref", columns=None) -> DataFrame:
    """``rows`` with ``roles`` array<string>, the role of each cell, where the row heads a table, else null.

    A known column's name is the cell, or begins it with at most eight more characters; a cell with figures names none. A role goes to one cell: the
    exact name first, then the left one. A heading has two roles, one of numbers, and knows most of its filled cells.
    """
    names = literal_map({name: {"role": role, "rank": i} for role, list_of in reversed(list((columns or COLUMNS).items())) for i, name in enumerate(list_of)}, "struct<role:string,rank:int>")
    cell = lambda c: F.coalesce(c, F.lit(""))

    def role(c: Column, n: Column) -> Column:
        def of(m: Column) -> Column:
            more = F.length(m["rest"])
            return F.when(m.isNotNull() & (more <= 8), F.struct((more > 0).cast("int").alias("longer"), m["hit"]["rank"].alias("rank"), n.alias("cell_no"), m["hit"]["role"].alias("role")))

        return F.when((F.length(F.trim(cell(c))) <= 30) & ~cell(c).rlike(r"\d"), bound(match_label(cell(c), names), of))

    def one_each(r: Column) -> Column:
        return F.transform(r, lambda x: F.when(x == F.array_min(F.filter(r, lambda y: y["role"] == x["role"])), x["role"]))

    found = rows.withColumn("__b", bound(F.transform("cells", role), one_each))
    filled = F.size(F.filter("cells", lambda c: F.trim(cell(c)) != ""))
    n = F.size(F.filter("__b", lambda x: x.isNotNull()))
    heads = (n >= 2) & F.exists("__b", lambda x: F.coalesce(x.isin(*NUMERIC_ROLES), F.lit(False))) & (n >= 0.6 * filled)
    return found.withColumn("roles", F.when(heads, F.col("__b"))).drop("__b")


def _placed(roles: Column, heads_x: Column, cells: Column, xs: Column | None) -> Column:
    """map role -> text of a row. With positions a cell belongs to the column between whose neighbours' midpoints its centre
    lies; else to the column of its number. Several cells of one column are joined."""
    if xs is None:
        pairs = F.filter(F.transform(cells, lambda c, i: F.struct(F.get(roles, i).alias("role"), F.trim(F.coalesce(c, F.lit(""))).alias("text"))), lambda p: p["role"].isNotNull() & (p["text"] != ""))
    else:
        bounds = F.transform(F.slice(heads_x, 2, F.greatest(F.size(heads_x) - 1, F.lit(0))), lambda x, i: (x + F.get(heads_x, i)) / 2)
        column = lambda i: F.size(F.filter(bounds, lambda b: b <= F.get(xs, i)))
        pairs = F.filter(F.transform(cells, lambda c, i: F.struct(F.get(roles, column(i)).alias("role"), F.trim(F.coalesce(c, F.lit(""))).alias("text"))), lambda p: p["role"].isNotNull() & (p["text"] != ""))
    distinct = F.array_distinct(F.transform(pairs, lambda p: p["role"]))
    return F.map_from_entries(F.transform(distinct, lambda r: F.struct(r.alias("k"), F.array_join(F.transform(F.filter(pairs, lambda p: p["role"] == r), lambda p: p["text"]), " ").alias("v"))))


def table_rows(rows: DataFrame, key: str = "ref", columns=None) -> DataFrame:
    """(key, row_no, head, values map<string,string>): the rows of every table.

    A table runs from its heading to the next one, to a closing row, or to the first blank row after a line. A row with a
    description and nothing else goes on with the description of the line above it.
    """
    positions = "xs" in rows.columns
    w = W.partitionBy(key).orderBy("row_no")
    heads = heading_rows(rows, key, columns)
    first = normal_label(F.coalesce(F.get(F.filter("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""), F.lit(0)), F.lit("")))
    coded = F.exists(F.slice("cells", 1, 2), lambda c: F.coalesce(c, F.lit("")).rlike(r"^\s*[A-Z]{2,}[A-Z0-9/.-]*\d"))
    head = F.when(F.col("roles").isNotNull(), F.struct(F.col("row_no").alias("head"), "roles", *(["xs"] if positions else [])))
    filled = heads.withColumn("__first", first).withColumn("__coded", coded).withColumn("__head", F.last(head, ignorenulls=True).over(w)).where("__head is not null and row_no > __head.head")
    blank = F.col("__first") == ""
    in_table = W.partitionBy(key, "__head.head").orderBy("row_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    had_line = F.coalesce(F.max(F.when(~blank, 1)).over(in_table), F.lit(0)) == 1
    closes = F.split("__first", " ")[0].isin(*CLOSING_WORDS) & ~F.col("__coded")
    live = filled.withColumn("__stop", (blank & had_line) | closes).withColumn("__over", F.max(F.col("__stop").cast("int")).over(in_table)).where("__over = 0 and __first <> ''")
    values = live.select(key, "row_no", F.col("__head.head").alias("head"), _placed(F.col("__head.roles"), F.col("__head.xs") if positions else None, F.col("cells"), F.col("xs") if positions else None).alias("values")).where(F.size("values") > 0)
    wraps = (F.size("values") == 1) & F.map_contains_key("values", "description")
    lines = values.withColumn("__wrap", wraps & (F.row_number().over(W.partitionBy(key, "head").orderBy("row_no")) > 1))
    lines = lines.withColumn("__line", F.sum(F.when(F.col("__wrap"), 0).otherwise(1)).over(W.partitionBy(key, "head").orderBy("row_no").rowsBetween(W.unboundedPreceding, 0)))
    merged = lines.groupBy(key, "head", "__line").agg(F.min("row_no").alias("row_no"), F.max("row_no").alias("last_row"), F.min_by("values", "row_no").alias("values"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__wrap"), F.struct("row_no", F.col("values")["description"].alias("d"))))), lambda x: x["d"]), " ").alias("__more"))
    whole = F.trim(F.concat_ws(" ", F.try_element_at("values", F.lit("description")), F.nullif("__more", F.lit(""))))
    values = F.when(F.col("__more") != "", F.map_concat(F.map_filter("values", lambda k, v: k != "description"), F.create_map(F.lit("description"), whole))).otherwise(F.col("values"))
    return merged.select(key, "row_no", "head", "last_row", values.alias("values"))


def typed_lines(lines: DataFrame, key: str = "ref", doc_type: str | None = "doc_type") -> DataFrame:
    """(key, line_no, sku, description, quantity, unit, unit_price_c, amount_c, reference, day): lines with the fields their
    document's type has. What was received overrides the quantity, debit less credit is the amount, balances are dropped;
    lines of statements and remittances without reference are dropped (a remittance's code is its reference)."""
    v = lambda name: F.nullif(F.trim(F.try_element_at("values", F.lit(name))), F.lit(""))
    kind = F.col(doc_type) if doc_type else F.lit(None).cast("string")
    of = lambda name, c: F.when(kind.isNull() | kind.isin(*[k for k, fs in LINE_OF.items() if name in fs]), c)
    debit, credit = money_cents(v("debit")), money_cents(v("credit"))
    amount = F.coalesce(money_cents(v("amount")), F.when(debit.isNotNull() | credit.isNotNull(), F.coalesce(debit, F.lit(0)) - F.abs(F.coalesce(credit, F.lit(0)))))
    reference = F.when(kind == "remittance", F.coalesce(v("reference"), v("sku"))).otherwise(v("reference"))
    out = lines.select(
        key, F.row_number().over(W.partitionBy(key).orderBy("row_no")).alias("line_no"), kind.alias("__kind"), of("sku", v("sku")).alias("sku"), of("description", v("description")).alias("description"),
        of("quantity", parse_number(F.coalesce(v("received"), v("quantity")))).alias("quantity"), of("unit", v("unit")).alias("unit"), of("unit_price", money_cents(v("unit_price"))).alias("unit_price_c"),
        of("amount", amount).cast("bigint").alias("amount_c"), of("reference", reference).alias("reference"), of("date", parse_day(v("date"))).alias("day"),
    )
    return out.where("coalesce(__kind, '') not in ('statement', 'remittance') or reference is not null").drop("__kind")


def label_values(rows: DataFrame, key: str = "ref", grammar=None, own=None, tables: DataFrame | None = None) -> DataFrame:
    """(key, field, value, printed, row_no): the best value of each field.

    ``rows`` may bear ``doc_type``, which decides what a document's own number is called and which fields it has. With
    ``tables`` (of ``table_rows``) amounts count only below the last table and other fields only outside of tables.
    """
    typed = "doc_type" in rows.columns
    w = W.partitionBy(key).orderBy("row_no")
    blank = F.size(F.filter("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")) == 0
    known = known_labels(grammar, own)
    marked = rows.where(~blank).withColumn("__m", F.transform("cells", lambda c: match_label(F.coalesce(c, F.lit("")), known)))
    # What stands below is a value only if it is no label itself.
    plain = F.transform("cells", lambda c, i: F.when(F.get("__m", i).isNull(), c))
    ready = marked.withColumn("__plain", plain).withColumn("below", F.array(*[F.lead("__plain", i).over(w) for i in (1, 2)]))
    cells = ready.select(key, "row_no", *(["doc_type"] if typed else []), "cells", "below", F.posexplode("__m").alias("cell_no", "m"))
    hit = cells.where("m is not null")
    is_own = F.array_contains("m.hit.own", F.col("doc_type")) if typed else F.size("m.hit.own") > 0
    field = F.when(F.coalesce(is_own, F.lit(False)), "doc_number").otherwise(F.col("m.hit.field"))
    hit = hit.withColumn("field", field).where("field is not null")
    if typed:
        belongs = F.lit(False)
        for kind, names in HEADER_OF.items():
            belongs = belongs | ((F.col("doc_type") == kind) & F.col("field").isin(*names))
        hit = hit.where(belongs)
    if tables is not None:
        ends = tables.groupBy(key).agg(F.min("head").alias("__begin"), F.max("last_row").alias("__end"))
        hit = hit.join(ends, key, "left")
        below = F.col("row_no") > F.col("__end")
        hit = hit.where(F.col("__end").isNull() | below | ((F.col("row_no") < F.col("__begin")) & ~F.col("field").isin(*MONEY_FIELDS)))
    right = F.get(F.filter(F.slice("cells", F.col("cell_no") + 2, F.size("cells")), lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""), F.lit(0))
    under = [F.when(F.col("m.rest") == "", F.get(F.get("below", F.lit(i)), F.col("cell_no"))) for i in (0, 1)]
    tries = [F.nullif("m.rest", F.lit("")), right, *under]
    tried = F.transform(F.array(*tries), lambda t: F.struct(typed_value(F.col("field"), t).alias("value"), t.alias("printed")))
    best = F.get(F.filter(tried, lambda x: x["value"].isNotNull()), F.lit(0))
    row = F.when(F.col("field") == "closing_balance", -F.col("row_no")).otherwise(F.col("row_no"))
    found = hit.select(key, "row_no", "cell_no", "field", (-F.col("m.words")).alias("rank"), row.alias("__row"), best.alias("best")).where("best is not null")
    return found.groupBy(key, "field").agg(F.min_by(F.struct("best.value", "best.printed", "row_no"), F.struct("rank", "__row", "cell_no")).alias("b")).select(key, "field", "b.value", "b.printed", "b.row_no")
